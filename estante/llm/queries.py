"""The queries of the ten problems, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estante.llm import canonical, lookalike, mixing, names, neardup, readability, scan_noise, subjects, survivor, tokens
from estante.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "nomes"), table(spark, d, "metadados"))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "nomes"), table(spark, d, "metadados"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_list(table(spark, d, "metadados"), table(spark, d, "areas"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched(table(spark, d, "metadados"), table(spark, d, "areas"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "convertidos"), table(spark, d, "metadados"), table(spark, d, "areas"), table(spark, d, "rotulos_area"))


def p3_composition(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("area_id").agg(F.count("*").alias("conversoes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "grupos_duplicados"), table(spark, d, "metadados"), table(spark, d, "fontes")).select("grupo_id", "campo", "registro_id")


def p4_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivor.golden_records(table(spark, d, "grupos_duplicados"), table(spark, d, "metadados"), table(spark, d, "fontes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_lookalikes(table(spark, d, "metadados"))


def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalise_records(table(spark, d, "metadados"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "convertidos"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.copy_classes(table(spark, d, "convertidos"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.scan_noise(table(spark, d, "convertidos"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(table(spark, d, "convertidos"), beginning="markdown_inicial")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trip(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mix(sizes, table(spark, d, "alvos_mistura"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "alvos_mistura"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_level(table(spark, d, "documents"), table(spark, d, "rotulos_nivel"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return p10_found(spark, d).groupBy("nivel").agg(F.count("*").alias("documentos"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_entities, p2_found, p2_unmatched, p3_found, p3_composition, p4_found, p4_golden, p5_found, p5_normalised,
        p6_found, p6_classes, p7_found, p7_repaired, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_profile,
    )
}


_SEP = "[\\s\\x{A0}\\x{2000}-\\x{200B}\\x{3000}\\x{AD}\\x{2010}-\\x{2014}\\x{2212}.-]"
_digit = lambda c, i: f"(CASE WHEN {c}[{i}] = 'X' THEN 10 ELSE try_cast({c}[{i}] AS int) END)"
_sum = lambda c, w: "(" + " + ".join(f"{_digit(c, i + 1)} * {x}" for i, x in enumerate(w)) + ")"
_fold = f"trim(regexp_replace(translate(lower(editora_ou_periodico), '{survivor.ACCENTED}', '{survivor.PLAIN}'), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200B}}\\x{{3000}}]+', ' ', 'g'))"
_fillers = ", ".join(f"'{x}'" for x in survivor.FILLERS)
#: The survivor of a group in plain SQL; the other problems need a model, a sketch or a statistic of the corpus.
ORACLE_SQL: dict[str, str] = {
    "p4_found": f"""WITH r AS (SELECT registro_id, fonte, extraido_em, recebido_em, ano, editora_ou_periodico, {_fold} AS ed, identificadores.isbn AS isbn, identificadores.issn AS issn, identificadores.doi AS doi,
regexp_replace(regexp_replace(upper(identificadores.isbn), '{_SEP}', '', 'g'), '^(URN:)?E?ISBN(1[03])?:?', '') AS bc, regexp_replace(regexp_replace(upper(identificadores.issn), '{_SEP}', '', 'g'), '^(URN:)?[EP]?ISSNL?:?', '') AS sc,
regexp_replace(trim(identificadores.doi), '(?i)^\\s*<?(https?://)?((dx\\.|www\\.)?doi\\.org/|(urn:|info:)?doi\\s*[:=/]?\\s*)', '') AS dc FROM metadados),
v AS (SELECT *, 'isbn' AS campo, isbn AS valor FROM r WHERE (regexp_full_match(bc, '[0-9]{{9}}[0-9X]') AND {_sum('bc', range(10, 0, -1))} % 11 = 0 OR regexp_full_match(bc, '97[89][0-9]{{10}}') AND {_sum('bc', [1, 3] * 6 + [1])} % 10 = 0) AND replace(bc, bc[1], '') <> ''
UNION ALL SELECT *, 'issn', issn FROM r WHERE regexp_full_match(sc, '[0-9]{{7}}[0-9X]') AND {_sum('sc', range(8, 0, -1))} % 11 = 0 AND NOT regexp_full_match(sc, '0+')
UNION ALL SELECT *, 'doi', doi FROM r WHERE regexp_full_match(dc, '10\\.[0-9]{{4,9}}(\\.[0-9]+)*/\\S+') AND NOT regexp_matches(dc, '(?i)/(x+|\\.+|-+|\\?+|n/?[ad])$')
UNION ALL SELECT *, 'ano', cast(ano AS varchar) FROM r WHERE ano BETWEEN 1000 AND 9999 AND ano <= year(extraido_em)
UNION ALL SELECT *, 'editora_ou_periodico', editora_ou_periodico FROM r WHERE regexp_matches(ed, '\\p{{L}}') AND ed NOT IN ({_fillers}) AND regexp_replace(ed, '[\\[\\]().]', '', 'g') NOT IN ({_fillers}))
SELECT grupo_id, campo, registro_id FROM (SELECT g.grupo_id, v.*, row_number() OVER (PARTITION BY g.grupo_id, campo ORDER BY f.confianca DESC NULLS LAST, extraido_em DESC NULLS LAST, recebido_em DESC NULLS LAST, v.registro_id, valor) AS k
FROM (SELECT DISTINCT grupo_id, registro_id FROM grupos_duplicados) g JOIN v ON g.registro_id = v.registro_id LEFT JOIN fontes f ON v.fonte = f.fonte) x WHERE k = 1"""
}
