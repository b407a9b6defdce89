"""Bibliographic registries asked online, as a table of answers; whatever goes wrong is no answer."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.functions import identifiers as I

# Addresses of the registries.
DOI_URL = "https://api.crossref.org/works/{}"
ISBN_URL = "https://openlibrary.org/api/books?bibkeys=ISBN:{}&jscmd=data&format=json"
TIMEOUT = 8
ANSWERS = "chave string, tipo_chave string, titulo string, autores array<string>, editora string, partes array<array<array<int>>>, data string, local string"


def get(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as response:
        return json.load(response)


def _doi(key: str, fetch: Callable[[str], dict]) -> dict | None:
    found = fetch(DOI_URL.format(urllib.parse.quote(key, safe="/"))).get("message")
    if not found:
        return None
    parts = [(found.get(k) or {}).get("date-parts") for k in ("published", "published-print", "published-online")]
    people = [f"{a.get('given', '')} {a.get('family', '')}".strip() for a in found.get("author") or []]
    return {"titulo": " ".join(found.get("title") or []), "autores": people, "editora": found.get("publisher"), "partes": [p or [] for p in parts]}


def _isbn(key: str, fetch: Callable[[str], dict]) -> dict | None:
    found = fetch(ISBN_URL.format(urllib.parse.quote(key))).get(f"ISBN:{key}")
    if not found:
        return None
    first = lambda name: next((x.get("name") for x in found.get(name) or []), None)
    return {"titulo": found.get("title"), "autores": [a.get("name", "") for a in found.get("authors") or []], "editora": first("publishers"), "data": found.get("publish_date"), "local": first("publish_places")}


def lookup(records: DataFrame, fetch: Callable[[str], dict] = get) -> DataFrame:
    """A table of registry answers for the identifiers of records: chave, tipo_chave, titulo, autores, editora, data_publicacao, local, consultado_em.

    Each key is asked once.  No answer, or one that cannot be read, has no row.  The
    result is not deterministic: persist it before it branches.
    """
    keys = records.select(F.explode(F.array(F.struct(F.lit("doi").alias("tipo_chave"), I.doi_key(F.col("identificadores.doi")).alias("chave")), F.struct(F.lit("isbn").alias("tipo_chave"), I.isbn_key(F.col("identificadores.isbn")).alias("chave")))).alias("k")).select("k.*").where("chave <> ''").distinct()
    columns = [c.strip().split(" ")[0] for c in ANSWERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, key in zip(batch["tipo_chave"], batch["chave"]):
                try:
                    found = (_doi if kind == "doi" else _isbn)(key, fetch)
                except Exception:  # noqa: BLE001 - a registry out of reach tells nothing
                    found = None
                if found:
                    rows.append(dict.fromkeys(columns) | {"chave": key, "tipo_chave": kind} | found)
            yield pd.DataFrame(rows, columns=columns)

    year = I.year_of_parts(*[F.try_element_at("partes", F.lit(n)) for n in (1, 2, 3)]).cast("string")
    return keys.mapInPandas(run, ANSWERS).select("chave", "tipo_chave", "titulo", "autores", "editora", F.coalesce("data", year).alias("data_publicacao"), "local", F.current_timestamp().alias("consultado_em"))
