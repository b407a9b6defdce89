"""Extractor answers: JSON schema sent out, and validation of what comes back, as data and not as exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Publication types and the fields that an answer must have.
TYPES = ["Livro", "Artigo", "Dissertação/Tese", "Apostila", "Revista", "Capítulo de Livro", "Outros"]
REQUIRED = ["tipo_publicacao", "area_principal", "subarea", "titulo", "referencia_abnt"]
ANSWER = """tipo_publicacao string, area_principal string, subarea string, titulo string, subtitulo string, autores array<string>, autor_principal string,
editora_ou_periodico string, ano string, local string, identificadores struct<isbn:string,issn:string,doi:string>, referencia_abnt string, _corrupt_record string"""


def validated(answer: Column) -> Column:
    """registro, erro: the record of a JSON answer, or why it is none.

    The year is read as text, so "2019" and 2019.0 count; extra keys are ignored;
    a missing list of authors is empty.
    """
    r = F.from_json(answer, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    year = F.regexp_replace(r["ano"], r"\.0+$", "").try_cast("int")
    missing = F.array_join(F.filter(F.array(*[F.when(r[f].isNull(), F.lit(f)) for f in REQUIRED]), lambda x: x.isNotNull()), ", ")
    broken = answer.isNull() | r["_corrupt_record"].isNotNull() | ~F.coalesce(answer, F.lit("")).rlike(r"^\s*\{")
    error = (
        F.when(broken, "JSON inválido")
        .when(missing != "", F.concat(F.lit("faltam campos: "), missing))
        .when(~r["tipo_publicacao"].isin(TYPES), F.concat(F.lit("tipo desconhecido: "), r["tipo_publicacao"]))
        .when(r["ano"].isNotNull() & year.isNull(), F.concat(F.lit("ano inválido: "), r["ano"]))
    )
    empty = F.lit(None).cast("string")
    record = F.struct(
        *[r[f].alias(f) for f in ("tipo_publicacao", "area_principal", "subarea", "titulo", "subtitulo")],
        F.coalesce(r["autores"], F.array().cast("array<string>")).alias("autores"),
        *[r[f].alias(f) for f in ("autor_principal", "editora_ou_periodico")], year.alias("ano"), r["local"].alias("local"),
        F.coalesce(r["identificadores"], F.struct(empty.alias("isbn"), empty.alias("issn"), empty.alias("doi"))).alias("identificadores"), r["referencia_abnt"].alias("referencia_abnt"),
    )
    return F.struct(F.when(error.isNull(), record).alias("registro"), error.alias("erro"))


def strict_schema() -> dict:
    """The JSON schema an extractor is asked to keep to: every field required, nothing else allowed."""
    text, maybe = {"type": "string"}, {"type": ["string", "null"]}
    closed = lambda props: {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}
    return closed(
        {
            "tipo_publicacao": {"type": "string", "enum": TYPES}, "area_principal": text, "subarea": text, "titulo": text, "subtitulo": maybe, "autores": {"type": "array", "items": text}, "autor_principal": maybe,
            "editora_ou_periodico": maybe, "ano": {"type": ["integer", "null"]}, "local": maybe, "identificadores": closed({"isbn": maybe, "issn": maybe, "doi": maybe}), "referencia_abnt": text,
        }
    )
