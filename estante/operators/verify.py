"""Verification of records against bibliographic registries, by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estante.functions import identifiers as I
from estante.functions import text as T


def alike(a: Column, b: Column) -> Column:
    """One telling word in common; nothing to compare with counts as alike."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (a == "") | (b == "") | (F.size(F.array_intersect(T.tokens(a, 3, T.STOP_REGISTRY), T.tokens(b, 3, T.STOP_REGISTRY))) >= 1)


def latest(registry: DataFrame, kind: str) -> DataFrame:
    """One answer per key: the last given (a key may be asked more than once); partial maxima go into the shuffle."""
    best = F.max_by(F.struct("titulo", "autores", "editora", "data_publicacao", "local"), F.struct("consultado_em", "titulo"))
    return registry.where((F.col("tipo_chave") == kind) & F.col("chave").isNotNull()).groupBy("chave").agg(best.alias(kind))


def message(kind: str, value: Column, source: str, title: Column, authors: Column) -> Column:
    """What the registry knows under the identifier of a record that is about another work."""
    work = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("«"), title, F.lit("»"))).otherwise("um registro sem título")
    by = F.when(authors != "", F.concat(F.lit(" ("), authors, F.lit(")"))).otherwise("")
    return F.concat(F.lit(f"{source} guarda outra obra sob o {kind} "), value, F.lit(": "), work, by, F.lit("; título e autoria do documento precisam de conferência."))


def fill(current: Column, *others: Column) -> Column:
    return F.coalesce(F.nullif(current, F.lit("")), *[F.nullif(o, F.lit("")) for o in others])


def verify(records: DataFrame, registry: DataFrame, key: str = "registro_id") -> DataFrame:
    """records with situacao_doi, situacao_isbn, aviso_registro, editora_final, ano_final, local_final.

    The DOI is looked up first; a mismatch there ends the matter.  Rows without a key
    take no part in the join of that key, so they do not meet in one task.
    """
    d = F.nullif(I.doi_key(F.col("identificadores.doi")), F.lit(""))
    i = F.nullif(I.isbn_key(F.col("identificadores.isbn")), F.lit(""))
    keyed = records.withColumn("_d", d).withColumn("_i", i)

    def looked_up(rows: DataFrame, key: str, kind: str) -> DataFrame:
        answers = latest(registry, kind).withColumnRenamed("chave", key)
        told = rows.where(F.col(key).isNotNull()).join(answers, key, "left")
        return told.unionByName(rows.where(F.col(key).isNull()).withColumn(kind, F.lit(None).cast(answers.schema[kind].dataType)))

    joined = looked_up(looked_up(keyed, "_d", "doi"), "_i", "isbn")
    by = lambda k: F.array_join(F.coalesce(F.col(f"{k}.autores"), F.array().cast("array<string>")), " ")
    state = lambda k: F.when(F.col(k).isNull(), "ausente").when(alike(F.col("titulo"), F.col(f"{k}.titulo")) | alike(F.col("autor_principal"), by(k)), "confere").otherwise("diverge")
    s = joined.withColumn("situacao_doi", state("doi")).withColumn("situacao_isbn", F.when(F.col("situacao_doi") == "diverge", "ausente").otherwise(state("isbn")))
    ok = lambda k: F.col(f"situacao_{k}") == "confere"
    warning = F.when(F.col("situacao_doi") == "diverge", message("DOI", F.col("identificadores.doi"), "Crossref", F.col("doi.titulo"), by("doi"))).when(
        F.col("situacao_isbn") == "diverge", message("ISBN", F.col("identificadores.isbn"), "Open Library", F.col("isbn.titulo"), by("isbn"))
    )
    year = lambda k: F.when(ok(k), I.year_in(F.col(f"{k}.data_publicacao")))
    return (
        s.withColumn("aviso_registro", warning)
        .withColumn("editora_final", fill(F.col("editora_ou_periodico"), F.when(ok("doi"), F.col("doi.editora")), F.when(ok("isbn"), F.col("isbn.editora"))))
        .withColumn("ano_final", F.coalesce(F.nullif(F.col("ano"), F.lit(0)), year("doi"), year("isbn")))
        .withColumn("local_final", fill(F.col("local"), F.when(ok("isbn"), F.col("isbn.local"))))
        .select(*records.columns, "situacao_doi", "situacao_isbn", "aviso_registro", "editora_final", "ano_final", "local_final")
    )
