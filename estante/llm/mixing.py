"""Mixing of sources to target weights by Pfair scheduling.

Every source with text gets a quota of tokens in proportion to its weight; the
total is the largest at which no source needs a record more often than allowed.
The output is cut in blocks of BLOCK_TOKENS, whatever the size of the corpus; block
j of a source of weight w has the release time floor(j / w) and the deadline
ceil((j + 1) / w), and the earliest deadline first schedule interleaves the sources
so that at no time one deviates from its target by a block or more.  A record stands
in the block it begins in, so in tokens the deviation is less than a block and the
longest record.

The weights sum to one, so after the least common multiple of their denominators
every source has got exactly its share and the schedule repeats: one period is made
on the driver, and the slot of any block follows by arithmetic.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estante.session import reliable

BLOCK_TOKENS = 4096
#: Slots of a period at most; weights whose period is longer are taken in parts of this many.
PERIOD = 10_000
BUCKET_ROWS = 20_000


def pfair_schedule(weights: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """source, its block, slot: one block a slot, earliest deadline first among the released ones."""
    waiting = [(math.floor(0 / w), math.ceil(1 / w), s, 0) for s, w in weights.items() if blocks.get(s)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out, slot = [], 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        if not ready:
            slot = waiting[0][0]
            continue
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        slot += 1
        if j + 1 < blocks[s]:
            w = weights[s]
            heapq.heappush(waiting, (math.floor((j + 1) / w), math.ceil((j + 2) / w), s, j + 1))
    return out


def in_parts(weights: dict[str, Fraction], parts: int = PERIOD) -> dict[str, Fraction]:
    """The weights if their period has at most so many slots, else the nearest multiples of 1 / parts that sum to one."""
    if math.lcm(*(w.denominator for w in weights.values())) <= parts:
        return weights
    whole = {s: max(1, math.floor(w * parts)) for s, w in weights.items()}
    order = sorted(weights, key=lambda s: (whole[s] - weights[s] * parts, s))
    for k in range(abs(parts - sum(whole.values()))):
        whole[order[k % len(order)]] += 1
    return {s: Fraction(n, sum(whole.values())) for s, n in whole.items()}


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict:
    """Total, quotas, and the schedule of one period, from the tokens a source has and its (weight, most uses of a record)."""
    present = {s: (Fraction(str(w)), cap) for s, (w, cap) in targets.items() if w and w > 0 and cap and cap > 0 and totals.get(s)}
    if not present:
        return {"total": 0, "quota": {}, "period": 1, "schedule": []}
    whole = sum(w for w, _ in present.values())
    weights = {s: w / whole for s, (w, _) in present.items()}
    total = math.floor(min(totals[s] * present[s][1] / weights[s] for s in present))
    quota = {s: math.floor(weights[s] * total) for s in present}
    shares = in_parts(weights)
    period = math.lcm(*(w.denominator for w in shares.values()))
    return {"total": total, "quota": quota, "period": period, "schedule": pfair_schedule(shares, {s: int(w * period) for s, w in shares.items()})}


def mix(sizes: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, repeticao, n_tokens, slot, deslocamento: one row for each use of a record.

    sizes: doc_id, source, n_tokens.  targets: source, peso, max_repeticoes (a few
    rows; repeated sources count once, with the largest values).  Output order is
    (slot, deslocamento).  Rows without a source, of a source without a target, or
    without tokens are not used; the weights of targets without tokens are shared
    out among the others in proportion.  Empty tables give an empty result.
    """
    spark = sizes.sparkSession
    sizes = reliable(sizes.select("doc_id", "source", "n_tokens").where("source is not null and n_tokens > 0"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("peso").alias("peso"), F.max("max_repeticoes").alias("cap"))
    stat = sizes.join(F.broadcast(goal.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    made = plan({r["source"]: r["t"] for r in stat}, {r["source"]: (r["peso"], r["cap"]) for r in goal.collect()})
    total = {r["source"]: r["t"] for r in stat}
    quotas = spark.createDataFrame([(s, q, total[s]) for s, q in made["quota"].items()], "source string, quota bigint, has bigint")
    slots = spark.createDataFrame(made["schedule"], "source string, lugar bigint, vaga bigint")
    each = slots.groupBy("source").agg(F.count("*").alias("cada"))
    bits = max(4, min(24, math.ceil(math.log2(max(1, sum(r["n"] for r in stat)) / BUCKET_ROWS + 1))))

    # Prefix sums in three levels, so that no source stands in one task: within buckets of the hash order, and over the buckets' sums twice.
    half = bits // 2
    hashed = sizes.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("grupo", F.shiftright("bucket", half))
    before = lambda *by: Window.partitionBy("source", *by).orderBy("bucket" if by else "grupo").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "grupo").agg(F.sum("t").alias("g")).select("source", "grupo", F.coalesce(F.sum("g").over(before()), F.lit(0)).alias("antes"))
    sums = sums.withColumn("base", F.coalesce(F.sum("t").over(before("grupo")), F.lit(0))).join(groups, ["source", "grupo"]).select("source", "bucket", (F.col("base") + F.col("antes")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["source", "bucket"]).withColumn("start", F.col("base") + F.col("inner"))
    used = (
        placed.join(F.broadcast(quotas), "source")
        .withColumn("full", F.expr("quota div has"))
        .withColumn("uses", F.col("full") + F.when(F.col("start") + F.col("n_tokens") / 2 < F.col("quota") - F.col("full") * F.col("has"), 1).otherwise(0))
        .where("uses > 0")
        .withColumn("repeticao", F.explode(F.expr("sequence(cast(1 as bigint), uses)")))
    )
    at = (F.col("repeticao") - 1) * F.col("has") + F.col("start")
    return (
        used.join(F.broadcast(each), "source")
        .withColumn("block", F.floor(at / block))
        .withColumn("deslocamento", at - F.col("block") * block)
        .withColumn("lugar", F.col("block") % F.col("cada"))
        .join(F.broadcast(slots), ["source", "lugar"])
        .select("doc_id", "source", "repeticao", "n_tokens", (F.floor(F.col("block") / F.col("cada")) * made["period"] + F.col("vaga")).alias("slot"), "deslocamento")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, alvo, tokens, parte, registros, usos_max: the shares really reached, one row per target."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("registros"), F.max("repeticao").alias("usos_max"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("peso").alias("alvo"))
    return (
        goal.join(got, "source", "left")
        .join(F.broadcast(whole), how="left", on=F.lit(True))
        .select("source", "alvo", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("parte"), F.coalesce("registros", F.lit(0)).alias("registros"), F.coalesce("usos_max", F.lit(0)).alias("usos_max"))
    )
