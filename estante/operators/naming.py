"""Destination names: file name, directory, path budget, collisions, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estante.functions import text as T
from estante.session import reliable

# Folder names of the publication types.
PLURAL = {"Livro": "Livros", "Artigo": "Artigos", "Dissertação/Tese": "Dissertações e Teses", "Apostila": "Apostilas", "Revista": "Revistas", "Capítulo de Livro": "Capítulos de Livro", "Outros": "Outros"}
REVIEW = "revisao_manual"


def plural(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in PLURAL.items() for x in pair]), c)


def author_for_name(principal: Column, authors: Column) -> Column:
    """The principal author unless missing or empty, else the first of the list."""
    return F.coalesce(F.nullif(principal, F.lit("")), F.try_element_at(authors, F.lit(1)))


def file_name(kind: Column, title: Column, subtitle: Column, author: Column, year: Column, publisher: Column) -> Column:
    """Type - title - subtitle - author - year - publisher, without the missing ones, of at most MAX_NAME characters."""
    parts = [T.sanitize(p, final=False) for p in (kind, title, subtitle, author, F.when(year != 0, year.cast("string")), publisher)]
    name = F.regexp_replace(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " - "), "[ .]+$", "")
    cut = lambda x: F.when(x == "", T.NO_VALUE).when(F.length(x) > T.MAX_NAME, F.regexp_replace(F.substring(x, 1, T.MAX_NAME), "[ .,;:-]+$", "")).otherwise(x)
    return T.let(name, cut)


def directory(root: Column, area: Column, subarea: Column, kind: Column, review: Column) -> Column:
    """root[/revisao_manual]/area/subarea/plural; a blank area has a name of its own, a blank subarea that of the area."""
    or_else = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    tail = F.coalesce(plural(kind), F.lit("Outros"))
    both = F.struct(or_else(T.sanitize(area), F.lit(T.NO_VALUE)).alias("a"), T.sanitize(subarea).alias("s"))
    return T.let(both, lambda x: F.concat_ws("/", root, F.when(review, F.lit(REVIEW)), x["a"], or_else(x["s"], x["a"]), tail))


def within_path(name: Column, folder: Column, extension: str = ".pdf") -> Column:
    """nome, erro: the name cut so that the whole path keeps MAX_PATH characters; an error where too little would be left."""
    room = T.MAX_PATH - (F.length(folder) + 1 + len(extension))
    cut = F.regexp_replace(F.substring(name, F.lit(1), room), "[ .,;:-]+$", "")
    return F.struct(
        F.when(room >= F.length(name), name).when(room >= T.MIN_CUT, cut).alias("nome"),
        F.when((room < F.length(name)) & (room < T.MIN_CUT), F.lit("caminho de destino longo demais")).alias("erro"),
    )


def collisions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with vez: which one of the rows of equal keys each is, in the order of a column.

    A name that a third of all rows share must not be numbered in one task: the rows
    are cut in ranges of the whole order column, numbered within a range, and the
    counts of the ranges before are added.
    """
    part = reliable(df.repartitionByRange(order).withColumn("_b", F.spark_partition_id()))
    counts = part.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_bb"), "_base")
    same = [part[k].eqNullSafe(counts[f"_{k}"]) for k in keys] + [part["_b"] == counts["_bb"]]
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    return part.withColumn("_r", F.row_number().over(inside)).join(counts, same).withColumn("vez", (F.col("_base") + F.col("_r")).cast("bigint")).select(*df.columns, "vez")


def suffixed(name: Column, turn: Column) -> Column:
    return F.when(turn > 1, F.concat(name, F.lit(" ("), turn.cast("string"), F.lit(")"))).otherwise(name)


def _numbered(names: DataFrame, column: str) -> DataFrame:
    """pasta, nome, n: the largest number n of the names "nome (n)" in each folder."""
    form = r"(?s)^(.*) \(([0-9]{1,15})\)\z"
    parts = names.where(F.col(column).rlike(form)).select("pasta", F.regexp_extract(column, form, 1).alias("nome"), F.regexp_extract(column, form, 2).cast("bigint").alias("n"))
    return parts.groupBy("pasta", "nome").agg(F.max("n").alias("n"))


def resolve_against(df: DataFrame, existing: DataFrame) -> DataFrame:
    """pasta, nome, caminho, vez → final name free among planned and existing ones.

    existing: pasta, nome of files already there.  A name that is taken, also by a
    document whose own name is "X (2)", gives way to the numbers after the last one
    planned or standing for it, in the order of the paths; rounds of joins go on
    until every row has a name.  Rows without folder or name collide with nothing.
    Only these columns go through the rounds; others are joined to the result.
    """
    keys = ["caminho", "pasta", "nome", "vez"]
    if set(df.columns) != set(keys):
        rest = df.select("caminho", *[x for x in df.columns if x not in keys])
        return resolve_against(df.select(*keys), existing).join(rest, "caminho").select(*df.columns, "final")
    taken = reliable(existing.select("pasta", "nome").distinct())
    done, left = [], reliable(df.withColumn("final", suffixed(F.col("nome"), F.col("vez"))))
    planned = df.select("pasta", "nome", F.col("vez").cast("bigint").alias("n"))
    last = reliable(planned.union(_numbered(taken, "nome")).union(_numbered(df.select("pasta", "nome"), "nome")).groupBy("pasta", "nome").agg(F.max("n").alias("_max")))
    while True:
        used = taken.select("pasta", F.col("nome").alias("final"), F.lit(True).alias("_t"))
        first = Window.partitionBy("pasta", "final").orderBy("vez", "caminho")
        named = F.col("pasta").isNotNull() & F.col("final").isNotNull()
        marked = reliable(left.join(used, ["pasta", "final"], "left").withColumn("_bad", named & (F.coalesce("_t", F.lit(False)) | (F.row_number().over(first) > 1))).drop("_t"))
        good = marked.where(~F.col("_bad")).select(*df.columns, "final")
        done.append(good)
        bad = marked.where("_bad")
        if bad.isEmpty():
            break
        taken = reliable(taken.union(good.select("pasta", F.col("final").alias("nome"))))
        turn = F.row_number().over(Window.partitionBy("pasta", "nome").orderBy("caminho"))
        left = bad.join(last, ["pasta", "nome"]).withColumn("vez", (F.greatest("_max", F.lit(1)) + turn).cast("bigint"))
        left = reliable(left.withColumn("final", suffixed(F.col("nome"), F.col("vez"))).select(*df.columns, "final"))
        last = reliable(last.join(left.groupBy("pasta", "nome").agg(F.max("vez").alias("_new")), ["pasta", "nome"], "left").select("pasta", "nome", F.coalesce("_new", "_max").alias("_max")))
    return reduce(DataFrame.unionByName, done)


def divergence(file: Column, title: Column, subtitle: Column, author: Column, publisher: Column) -> Column:
    """Whether a telling file name shares fewer than two words with the record."""
    of_file = T.tokens(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
    of_record = T.tokens(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(subtitle, F.lit("")), F.nullif(author, F.lit("")), F.nullif(publisher, F.lit(""))))
    return (F.size(of_file) >= 2) & (F.size(F.array_intersect(of_file, of_record)) < 2)
