"""The whole chain from converted documents to a plan of destinations, with failures as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.functions import identifiers as I
from estante.operators import batch, excerpt, naming, note, verify
from estante.session import reliable
from estante.sources.extractors import extract

WARNING = "o título ou autor extraído quase não tem palavras em comum com o nome do arquivo"


def catalogue(
    documents: DataFrame, extractor, destination: str, today: str, fallback=None, registry: DataFrame | Callable[[DataFrame], DataFrame] | None = None, provider: str = "ollama", fallback_provider: str | None = None,
    pages: int = excerpt.PAGES, characters: int = excerpt.BUDGET, note_folder: str | None = None,
) -> DataFrame:
    """caminho, titulo, pasta, nome, vez, nota, aviso, erro, etapa, fatal, usou_fallback, provedor_usado from converted documents.

    documents: caminho, nome_arquivo, markdown_completo, paginas, total_paginas,
    metadados_embutidos, and erro of the conversion if they have it.  registry: a
    table of answers, or what makes one of records.  A fatal answer of the provider
    has fatal set: its document, and those not sent after it, are not processed.  The
    text is joined to the notes at the end and stands in no intermediate table.
    """
    c = F.col
    if "erro" in documents.columns:
        broken, documents = documents.where("erro is not null").select("caminho", "erro"), documents.where("erro is null").drop("erro")
    else:
        broken = documents.select("caminho", F.lit(None).cast("string").alias("erro")).limit(0)
    shown = excerpt.excerpts(documents, c("paginas"), pages, characters).withColumn("pedido", excerpt.user_prompt(c("nome_arquivo"), c("total_paginas"), c("metadados_embutidos"), c("trecho")))
    shown = reliable(shown.select("caminho", "trecho", "pedido"))
    r = c("registro")
    warned = naming.divergence(F.element_at(F.split("caminho", "/"), -1), r["titulo"], r["subtitulo"], r["autor_principal"], r["editora_ou_periodico"])
    first = reliable(extract(shown, extractor))
    second, stopped = None, first.where("fatal").select("caminho", "erro")
    if fallback is not None:
        again = first.where(~c("fatal") & (c("erro").isNotNull() | warned)).select("caminho")
        second = reliable(extract(shown.join(again, "caminho", "left_semi"), fallback))
        stopped = stopped.union(second.where("fatal").select("caminho", "erro"))
        second = second.where("not fatal")
    merged = batch.merge_fallback(first.join(stopped.select("caminho"), "caminho", "left_anti"), second, "caminho", warned)
    flat = merged.where("registro is not null").select("caminho", "usou_fallback", "avisado", "registro.*").join(shown.select("caminho", "trecho"), "caminho")
    upper = flat.withColumn("referencia_abnt", I.surnames_upper(c("referencia_abnt"), c("autores")))
    ids = I.discard_unconfirmed(*[c(f"identificadores.{k}") for k in ("isbn", "issn", "doi")], c("referencia_abnt"), c("trecho"))
    clean = upper.withColumn("_i", ids).withColumn("referencia_abnt", c("_i.referencia")).withColumn("identificadores", F.struct("_i.isbn", "_i.issn", "_i.doi")).drop("_i", "trecho")
    clean = clean.withColumn("aviso", F.when(c("avisado"), F.lit(WARNING)))
    if callable(registry):
        registry = reliable(registry(clean))
    if registry is not None:
        clean = verify.verify(clean, registry, "caminho")
        clean = clean.withColumn("aviso", batch.join_warnings(c("aviso"), c("aviso_registro"))).withColumn("editora_ou_periodico", c("editora_final")).withColumn("ano", c("ano_final")).withColumn("local", c("local_final"))
    label = batch.provider_label(c("usou_fallback"), provider, fallback_provider)
    placed = clean.withColumn("provedor_usado", label).withColumn("pasta", naming.directory(F.lit(destination), c("area_principal"), c("subarea"), c("tipo_publicacao"), F.coalesce(c("aviso") != "", F.lit(False))))
    # The note's folder is never above the document's, so a name that fits there fits both.
    deepest = F.concat(c("pasta"), F.lit("/" + note_folder)) if note_folder else c("pasta")
    named = placed.withColumn("_n", naming.file_name(c("tipo_publicacao"), c("titulo"), c("subtitulo"), naming.author_for_name(c("autor_principal"), c("autores")), c("ano"), c("editora_ou_periodico"))).withColumn("_p", naming.within_path(c("_n"), deepest)).withColumn("nome", c("_p.nome")).withColumn("erro", c("_p.erro")).drop("_n", "_p")
    good = naming.collisions(named.where("erro is null"), ["pasta", "nome"], "caminho")
    noted = note.notes(good.join(documents.select("caminho", "markdown_completo", "total_paginas"), "caminho"), today, c("provedor_usado"), c("usou_fallback"))
    keep = ["caminho", "titulo", "pasta", "nome", "vez", "nota", "aviso", "erro", "usou_fallback", "provedor_usado"]
    of = lambda df, stage: df.withColumn("etapa", F.lit(stage)).withColumn("fatal", F.lit(False))
    made = of(noted.select(*keep), None).withColumn("etapa", F.lit(None).cast("string"))
    for failed in (of(named.where("erro is not null").select("caminho", "titulo", "erro", "usou_fallback", "provedor_usado"), "organizacao"), of(merged.where("registro is null").select("caminho", "erro", "usou_fallback"), "extracao"), of(broken, "conversao"), of(stopped, "extracao").withColumn("fatal", F.lit(True))):
        made = made.unionByName(failed, allowMissingColumns=True)
    return made
