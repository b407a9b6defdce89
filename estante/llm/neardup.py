"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

The sketch of a set has BINS coordinates.  In round i < BINS every element is
thrown into one hashed bin, with a value that begins with i; in the last rounds
every element is thrown into bin i - BINS.  A bin keeps its least value, so every
coordinate fills, after O(t log t / |A|) rounds for most sets, and two sets agree in a
coordinate with the probability of their Jaccard similarity, with concentration.
ROWS coordinates make a band; texts that share a band are compared by a short
signature and then exactly.  Copies of one text are one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.session import reliable

BINS, ROWS = 640, 5
SIGNATURE = 128
SHINGLE_WORDS = 3
SIMILARITY = 0.5
#: Copies of one text are given in all pairs up to this many; more are given as pairs with the first, which lose no link.
EXPAND_COPIES = 64
#: So many ids, of 8 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: So many texts of one band are compared with each other in one place; a larger band is cut in blocks.
BLOCK = 2000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def seed(i: int) -> np.uint64:
    """The i-th step of the sequence that tells rounds apart."""
    return np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashes of the distinct word sequences of texts; words are hashed once and kept in a bounded cache."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.n, self.known = words, {}

    def _hashes(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return [known[w] for w in words]

    def of(self, text: str | None) -> tuple[np.ndarray, int]:
        """The distinct hashes in order, and a hash of the whole sequence of words."""
        words = (text or "").lower().split()
        if len(words) < self.n:
            return np.zeros(0, np.uint64), 0
        h = np.array(self._hashes(words), np.uint64)
        s = h[: len(h) - self.n + 1].copy()
        for k in range(1, self.n):
            s = mix(s + _M1) + h[k : len(h) - self.n + 1 + k]
        return np.unique(mix(s)), xxhash.xxh64_intdigest(h.tobytes())


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of bins values for each non-empty set."""
    count = len(sets)
    out = np.full((count, bins), np.iinfo(np.uint64).max, np.uint64)
    flat, empty = out.reshape(-1), np.uint64(np.iinfo(np.uint64).max)
    doc = np.repeat(np.arange(count), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(bins):
        if not len(x):
            return out
        h = mix(x + seed(i + 1))
        at = doc * bins + (h % np.uint64(bins)).astype(np.int64)
        value = np.uint64(i) << np.uint64(40) | h >> np.uint64(24)
        free = flat[at] == empty if i else slice(None)
        np.minimum.at(flat, at[free], value[free])
        if i % 2 or i < 8:
            left = (out == empty).any(1)
            keep = left[doc]
            doc, x = doc[keep], x[keep]
    for b in range(bins):
        if not len(x):
            break
        free = out[doc, b] == empty
        value = np.uint64(bins + b) << np.uint64(40) | mix(x[free] + seed(bins + b + 1)) >> np.uint64(24)
        np.minimum.at(flat, doc[free] * bins + b, value)
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands of each sketch; the place of the band is part of the key."""
    cut = sketch.reshape(len(sketch), -1, rows)
    key = np.arange(cut.shape[1], dtype=np.uint64)[None, :] * _M1
    for r in range(rows):
        key = mix(key + cut[:, :, r])
    return key.astype(np.int64)


def _sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                sets, sums, keep = [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    s, h = made.of(value)
                    if len(s):
                        sets.append(s)
                        sums.append(h)
                        keep.append(i)
                sketch = sketches(sets)
                short = (sketch[:, :: BINS // SIGNATURE] & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(np.array(sums, np.uint64).astype(np.int64)), pa.array([r.tobytes() for r in short], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bands(sketch).reshape(-1)), BINS // ROWS).cast(pa.list_(pa.int64()))],
                    names=["id", "copia", "marca", "faixas"],
                )

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text).mapInArrow(run, "id bigint, copia bigint, marca binary, faixas array<bigint>")


def _plausible(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least the share least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIGNATURE) for k in (2, 3))
            keep = pa.array((a == b).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "marca_a", "marca_b").mapInArrow(run, "a bigint, b bigint")


def _sets(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for batch in batches:
            sets = [made.of(value)[0].astype(np.int64) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return df.mapInArrow(run, "id bigint, s array<bigint>")


def _of(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows joined with ids, which are broadcast if they are counted to be few, so that wide rows need no shuffle."""
    ids = reliable(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _meeting(unique: DataFrame) -> DataFrame:
    """a, b: the texts that share a band, each pair once.

    Bands are counted first: those of one text are dropped and those of two are a
    pair at once.  A band of more is cut in blocks of about BLOCK texts, and every
    two blocks meet under a key of their own, so that no band stands in one task.
    """
    keys = unique.select("id", F.explode("faixas").alias("faixa"))
    shared = reliable(keys.groupBy("faixa").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b"))
    many = shared.where("n > 2").select("faixa", F.ceil(F.col("n") / BLOCK).alias("blocos"))
    kept = keys.join(F.broadcast(many) if many.count() <= BROADCAST_IDS else many, "faixa").withColumn("bloco", F.pmod(F.xxhash64("id"), "blocos"))
    one = F.lit(1).cast("bigint")
    left = kept.select("faixa", "id", F.col("bloco").alias("i"), F.explode(F.sequence("bloco", F.col("blocos") - one)).alias("j")).alias("l")
    right = kept.select("faixa", "id", F.explode(F.sequence(one - one, "bloco")).alias("i"), F.col("bloco").alias("j")).alias("r")
    l, r = F.col("l.id"), F.col("r.id")
    same = (F.col("l.faixa") == F.col("r.faixa")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    pairs = left.join(right, same & ((F.col("l.i") < F.col("l.j")) & (l != r) | (l < r))).select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b"))
    return shared.where("n = 2").select("a", "b").union(pairs).distinct()


def linked_texts(df: DataFrame, key: str = "conv_id", text: str = "markdown_completo", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links a, b between the first of each set of equal texts; and membership id, primeiro, copias.

    Equal texts are those with the same sequence of words in lower case.  Texts of
    fewer words than a shingle, null or empty have no shingles and no part in
    either.  A key that occurs more than once, with the same text, counts once.
    """
    made = reliable(_sketched(df, key, text))
    first = made.groupBy("copia").agg(F.min("id").alias("primeiro"), F.count_distinct("id").alias("copias"))
    members = reliable(made.select("id", "copia").distinct().join(first, "copia").select("id", "primeiro", "copias"))
    unique = _of(made, members.where("id <> primeiro").select("id"), "left_anti")
    met = _meeting(unique)
    marks = unique.select("id", "marca")
    both = met.join(marks.select(F.col("id").alias("a"), F.col("marca").alias("marca_a")), "a").join(marks.select(F.col("id").alias("b"), F.col("marca").alias("marca_b")), "b")
    likely = reliable(_plausible(both, similarity * 0.6).distinct())
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text)
    sets = reliable(_sets(_of(texts, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "left_semi")))
    common = F.size(F.array_intersect("sa", "sb"))
    links = (
        likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .where(common >= similarity * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
        .distinct()
    )
    return links, members


def similar_pairs(df: DataFrame, key: str = "conv_id", text: str = "markdown_completo", similarity: float = SIMILARITY) -> DataFrame:
    """conv_a, conv_b: pairs of keys whose texts have that Jaccard similarity of word sequences or more, the smaller first.

    Copies of one text are given in all pairs up to EXPAND_COPIES; beyond, each is
    given with the first copy only, and links to other texts with the first copy.
    """
    links, members = linked_texts(df, key, text, similarity)
    shown = members.where((F.col("copias") <= EXPAND_COPIES) | (F.col("id") == F.col("primeiro"))).where("copias > 1").select("primeiro", "id")
    side = lambda n: shown.select(F.col("primeiro").alias(n), F.col("id").alias(f"m{n}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    few, many = members.where(F.col("copias").between(2, EXPAND_COPIES)), members.where(F.col("copias") > EXPAND_COPIES)
    l, r = few.alias("l"), few.alias("r")
    within = l.join(r, (F.col("l.primeiro") == F.col("r.primeiro")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    star = many.where("id <> primeiro").select(F.col("primeiro").alias("a"), F.col("id").alias("b"))
    return between.union(within).union(star).select(F.least("a", "b").alias("conv_a"), F.greatest("a", "b").alias("conv_b")).distinct()


def copy_classes(df: DataFrame, key: str = "conv_id", text: str = "markdown_completo", similarity: float = SIMILARITY) -> DataFrame:
    """conv_id, primeiro, copias, ligacoes: the first copy of each text, its number of copies, and of other texts like it."""
    links, members = linked_texts(df, key, text, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("primeiro")).groupBy("primeiro").agg(F.count("*").alias("ligacoes"))
    return members.join(degree, "primeiro", "left").select(F.col("id").alias("conv_id"), "primeiro", "copias", F.coalesce("ligacoes", F.lit(0)).alias("ligacoes"))
