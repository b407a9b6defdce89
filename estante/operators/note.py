"""The catalogue note: front matter and body."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from estante.functions import text as T
from estante.operators.naming import author_for_name


def body(title: Column, citation: Column, content: Column) -> Column:
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    cited = trim(F.coalesce(citation, F.lit("")))
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n## Referência Bibliográfica (ABNT)\n\n> "), F.when(cited == "", T.NO_VALUE).otherwise(cited), F.lit("\n\n---\n\n## Conteúdo\n\n"), trim(F.coalesce(content, F.lit(""))), F.lit("\n"))


def tags(area: Column, subarea: Column, kind: Column) -> Column:
    return F.array(F.concat(F.lit("area/"), T.slug(area)), F.concat(F.lit("subarea/"), T.slug(subarea)), F.concat(F.lit("tipo/"), T.slug(kind)))


def notes(df: DataFrame, today: str, provider: Column, fallback: Column) -> DataFrame:
    """df with nota: 20 keys of front matter and the body. today is given, so that a run can be repeated."""
    fields = F.struct(
        *[F.col(c) for c in ("tipo_publicacao", "area_principal", "subarea", "titulo", "subtitulo")],
        F.to_json("autores").alias("autores"),
        author_for_name(F.col("autor_principal"), F.col("autores")).alias("autor_principal"),
        F.col("editora_ou_periodico"), F.col("ano").cast("string").alias("ano"), F.col("local"),
        *[F.col(f"identificadores.{k}").alias(k) for k in ("isbn", "issn", "doi")],
        F.col("referencia_abnt"), F.to_json(tags(F.col("area_principal"), F.col("subarea"), F.col("tipo_publicacao"))).alias("tags"),
        F.element_at(F.split("caminho", "/"), -1).alias("arquivo_origem"), F.col("total_paginas").cast("string").alias("total_paginas"),
        F.lit(today).alias("catalogado_em"), provider.alias("provedor_extracao"), fallback.cast("string").alias("extraido_via_fallback"),
    )
    return df.withColumn("nota", F.concat(F.lit("---\n"), _front(fields), F.lit("\n---\n\n"), body(F.col("titulo"), F.col("referencia_abnt"), F.col("markdown_completo"))))


@F.pandas_udf(StringType())
def _front(fields: pd.DataFrame) -> pd.Series:
    import json

    import yaml

    def typed(k, v):
        if v is None or isinstance(v, float) and v != v:
            return [] if k in ("autores", "tags") else None
        return json.loads(v) if k in ("autores", "tags") else int(v) if k in ("ano", "total_paginas") else v == "true" if k == "extraido_via_fallback" else v

    return pd.Series([yaml.dump({k: typed(k, v) for k, v in row.items()}, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), allow_unicode=True, sort_keys=False, default_flow_style=False).rstrip() for row in fields.to_dict("records")], dtype="object")
