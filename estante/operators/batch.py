"""Batches: what is pending, merging a fallback, summaries, the destination tree, restored order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(files: DataFrame, done: DataFrame, path: str = "caminho") -> DataFrame:
    """Files whose path is not completed yet. Failures count as completed."""
    return files.join(done.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_anti")


def next_batch(files: DataFrame, done: DataFrame, limit: int, path: str = "caminho") -> DataFrame:
    """The first pending files in path order; the limit applies after the filter."""
    return pending(files, done, path).orderBy(F.split(path, "/")).limit(limit)


def merge_fallback(primary: DataFrame, fallback: DataFrame | None, key: str, warned: Column) -> DataFrame:
    """One row per key of primary: its record, or the fallback's where primary failed or is warned of.

    primary and fallback: key, erro, registro (struct).  warned: a condition on
    ``registro``.  Out: key, registro, usou_fallback, erro, avisado.
    """
    p = primary.select(key, F.col("erro").alias("_pe"), F.col("registro").alias("_pr"))
    if fallback is None:
        both = p.withColumns({"_fe": F.lit(None).cast("string"), "_fr": F.when(F.lit(False), F.col("_pr")), "_has": F.lit(False)})
    else:
        both = p.join(fallback.select(key, F.col("erro").alias("_fe"), F.col("registro").alias("_fr"), F.lit(True).alias("_h")), key, "left").withColumn("_has", F.coalesce("_h", F.lit(False)))
    first = both.withColumn("registro", F.col("_pr")).withColumn("_w", F.col("_pe").isNull() & F.coalesce(warned, F.lit(False)))
    use = F.col("_has") & F.col("_fe").isNull() & (F.col("_pe").isNotNull() | F.col("_w"))
    merged = first.withColumn("usou_fallback", use).withColumn("registro", F.when(use, F.col("_fr")).otherwise(F.when(F.col("_pe").isNull(), F.col("_pr"))))
    error = F.when(F.col("_pe").isNull() | use, None).when(F.col("_has"), F.concat(F.lit("local: "), "_pe", F.lit("; fallback: "), "_fe")).otherwise(F.col("_pe"))
    return merged.withColumn("erro", error).withColumn("avisado", F.col("erro").isNull() & F.coalesce(warned, F.lit(False))).select(key, "registro", "usou_fallback", "erro", "avisado")


def provider_label(used_fallback: Column, primary: str, fallback: str | None) -> Column:
    return F.when(used_fallback, F.lit(fallback or "fallback")).otherwise(F.lit(primary))


def join_warnings(first: Column, second: Column) -> Column:
    """Both warnings in one text, or the one there is."""
    return F.when(first.isNotNull() & second.isNotNull(), F.concat(first, F.lit(" Além disso, "), second)).otherwise(F.coalesce(first, second))


def summary(results: DataFrame, planned: int | None = None, local: str = "local") -> DataFrame:
    """One row: counts of the batch, how many came from the local provider, and the exit code.

    planned: how many documents the batch was to process; then also restantes, those without a result.
    """
    ok = F.col("situacao").isin("sucesso", "simulado")
    n = lambda c: F.count_if(c)
    return results.agg(
        F.count("*").alias("total"),
        n(F.col("situacao") == "sucesso").alias("gravados"),
        n(F.col("situacao") == "simulado").alias("simulados"),
        n(F.col("situacao") == "falha").alias("falhas"),
        n(ok & (F.col("provedor_usado") == local)).alias("locais"),
        (n(ok) - n(ok & (F.col("provedor_usado") == local))).alias("pagos"),
        n(F.col("aviso").isNotNull() & (F.col("aviso") != "")).alias("avisos"),
        F.coalesce(F.bool_or("usou_fallback"), F.lit(False)).alias("algum_fallback"),
        F.coalesce(F.bool_or(F.col("situacao") == "falha"), F.lit(False)).cast("int").alias("codigo_saida"),
        *([] if planned is None else [(F.lit(planned) - F.count("*")).cast("bigint").alias("restantes")]),
    )


def in_input_order(results: DataFrame, listing: DataFrame, path: str = "caminho", ordinal: str = "ordem") -> DataFrame:
    """Results with the place of their file in the listing, in that order; files without a result drop out."""
    return results.join(listing.select(path, ordinal), path).orderBy(ordinal)


def tree(plan: DataFrame) -> DataFrame:
    """area, subarea, tipo, arquivos: the destination tree with counts on every level (null: the level above)."""
    return plan.rollup("area", "subarea", "tipo").agg(F.count("*").alias("arquivos")).where("area is not null")


def drawn(counts: DataFrame) -> list[str]:
    """The lines of a tree with counts, in order; it has one line for each folder, not for each document."""
    rows = sorted((tuple(x or "" for x in (r["area"], r["subarea"], r["tipo"])), r["arquivos"]) for r in counts.collect())
    return [f"{'  ' * sum(x != '' for x in parts[1:])}{next(x for x in reversed(parts) if x)} ({n})" for parts, n in rows]
