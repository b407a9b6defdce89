"""The surviving value of each field in a group of duplicate records.

Records are ranked by trust and recency among those whose value is usable, with a
deterministic tie-break, and the top one per group is kept.  The ranking is a
row_number() = 1 window, which Spark cuts down to one row per group and task
before the shuffle, so a group with a third of all rows costs one row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fillers that people and models type where a publisher is unknown, folded.
FILLERS = [
    "", "-", "--", "---", "?", "??", "???", ".", "..", "...", "0", "x", "xx", "xxx", "n/a", "na", "n.a.", "n/d", "nd", "n.d.", "n/i", "ni", "s/n", "sn", "s.n.", "s.n", "[s.n.]", "s/e", "s.e.", "s/d", "s.d.", "s.l.", "none", "null", "nan", "nil", "nenhum", "nenhuma", "nao informado", "nao informada", "nao consta", "nao disponivel",
    "nao identificado", "nao identificada", "nao se aplica", "nao ha", "nao tem", "sem informacao", "sem editora", "sem nome", "sem dados", "desconhecido", "desconhecida", "editora desconhecida", "editora nao informada", "ignorado", "ignorada", "indefinido", "indefinida", "indisponivel", "a definir", "a confirmar", "a preencher", "a verificar", "ver capa", "vazio", "unknown", "not available", "not informed", "publisher", "editora", "teste", "tbd", "todo", "outro", "outros", "varios", "diversos",
]
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def _folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"(?U)[\s​﻿]+", " "))


def _weighted(digits: Column, weights: list[int]) -> Column:
    """The sum of digits times weights, X as the last being 10."""
    parts = [F.when(F.substring(digits, i + 1, 1) == "X", 10).otherwise(F.substring(digits, i + 1, 1).try_cast("int")) * w for i, w in enumerate(weights)]
    return reduce(lambda a, b: a + b, parts)


def isbn_valid(c: Column) -> Column:
    """Ten or thirteen digits with the right check digit; prefix, separators and case are free."""
    core = F.regexp_replace(F.upper(c), r"(?U)[\s\-‐‑‒–—−.­​]", "")
    core = F.regexp_replace(core, r"^(?:URN:)?(?:E-?)?ISBN(?:-?1[03])?:?(?=[0-9])", "")
    ten = core.rlike("^[0-9]{9}[0-9X]$") & (_weighted(core, [10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)
    thirteen = core.rlike("^97[89][0-9]{10}$") & (_weighted(core, [1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1]) % 10 == 0)
    zeros = core.rlike("^(.)\\1*$")
    return F.coalesce((ten | thirteen) & ~zeros, F.lit(False))


def issn_valid(c: Column) -> Column:
    """Eight digits, the last maybe X, with the right check digit."""
    core = F.regexp_replace(F.upper(c), r"(?U)[\s\-‐‑‒–—−.­​]", "")
    core = F.regexp_replace(core, r"^(?:URN:)?(?:E-?|P-?)?ISSN(?:-?L)?:?(?=[0-9])", "")
    good = core.rlike("^[0-9]{7}[0-9X]$") & (_weighted(core, [8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)
    return F.coalesce(good & ~core.rlike("^0+$"), F.lit(False))


def doi_valid(c: Column) -> Column:
    """10., a registrant of four digits or more, a slash and a suffix without white space."""
    core = F.regexp_replace(F.trim(c), r"(?iU)^\s*(?:<)?(?:https?://)?(?:(?:dx\.|www\.)?doi\.org/|(?:urn:|info:)?doi\s*[:=/]?\s*)", "")
    return F.coalesce(core.rlike(r"^10\.[0-9]{4,9}(?:\.[0-9]+)*/[^\s]+$") & ~core.rlike(r"(?i)/(?:x+|\.+|-+|\?+|n/?[ad])$"), F.lit(False))


def usable_values(records: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """also, registro_id, fonte, extraido_em, recebido_em, campo, valor for each usable value."""
    publisher = _folded(F.col("editora_ou_periodico"))
    year = F.col("ano")
    fields = [
        ("isbn", F.col("identificadores.isbn"), isbn_valid(F.col("identificadores.isbn"))),
        ("issn", F.col("identificadores.issn"), issn_valid(F.col("identificadores.issn"))),
        ("doi", F.col("identificadores.doi"), doi_valid(F.col("identificadores.doi"))),
        ("ano", year.cast("string"), F.coalesce(year.between(1000, 9999) & (year <= F.year("extraido_em")), F.lit(False))),
        ("editora_ou_periodico", F.col("editora_ou_periodico"), F.coalesce(publisher.rlike(r"\p{L}") & ~publisher.isin(FILLERS) & ~F.regexp_replace(publisher, r"[\[\]().]", "").isin(FILLERS), F.lit(False))),
    ]
    each = F.array(*[F.when(ok, F.struct(F.lit(name).alias("campo"), value.alias("valor"))) for name, value, ok in fields])
    keys = [*also, "registro_id", "fonte", "extraido_em", "recebido_em"]
    return records.select(*keys, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.campo", "x.valor")


def survivors(groups: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """grupo_id, campo, registro_id, valor: per group and field the record whose value survives.

    Order: confianca of the source (sources without one last), extraido_em,
    recebido_em, then the smaller registro_id and value.  A record delivered twice
    or listed twice counts once in effect.  Groups without a usable value in a
    field have no row for it; null keys and empty tables give nothing.
    """
    trust = sources.where("fonte is not null").groupBy("fonte").agg(F.max("confianca").alias("confianca"))
    members = groups.select("grupo_id", "registro_id").where("grupo_id is not null and registro_id is not null").distinct()
    # Only the records of a group are validated, after the join.
    told = members.join(records.select("registro_id", "fonte", "extraido_em", "recebido_em", "identificadores", "ano", "editora_ou_periodico"), "registro_id")
    values = usable_values(told, ("grupo_id",)).join(F.broadcast(trust), "fonte", "left")
    best = Window.partitionBy("grupo_id", "campo").orderBy(F.desc_nulls_last("confianca"), F.desc_nulls_last("extraido_em"), F.desc_nulls_last("recebido_em"), "registro_id", "valor")
    return values.withColumn("posto", F.row_number().over(best)).where("posto = 1").select("grupo_id", "campo", "registro_id", "valor")


def golden_records(groups: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """grupo_id, isbn, issn, doi, ano, editora_ou_periodico, completo: the record built field by field."""
    names = ["isbn", "issn", "doi", "ano", "editora_ou_periodico"]
    kept = survivors(groups, records, sources).groupBy("grupo_id").pivot("campo", names).agg(F.first("valor"))
    return kept.select("grupo_id", "isbn", "issn", "doi", F.col("ano").cast("int").alias("ano"), "editora_ou_periodico", reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("bigint") for n in names]).alias("completo"))
