"""Listing of documents and reading of PDF files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONVERTED = "caminho string, nome_arquivo string, markdown_completo string, paginas array<string>, total_paginas int, metadados_embutidos map<string,string>, erro string"
#: Folders above this depth are named on the driver; what is below each is walked by a task.
SPLIT_DEPTH = 2


def wanted(name: str, suffix: str = ".pdf") -> bool:
    """Whether a file is a document: the suffix in any case, and no hidden name of its own."""
    return name.lower().endswith(suffix) and not name.startswith(".")


def _folders(root: str, depth: int) -> Iterator[tuple[str, bool]]:
    """Folders to list, and whether with everything below; each file is under exactly one."""
    if depth == 0:
        yield root, True
        return
    yield root, False
    with os.scandir(root) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield from _folders(entry.path, depth - 1)


def list_files(spark: SparkSession, root: str, recursive: bool = True, suffix: str = ".pdf") -> DataFrame:
    """caminho, nome_arquivo, ordem: in the order of the parts of their paths.

    Hidden files are skipped, hidden folders are not; Spark's own file source would
    skip names and folders that begin with an underscore or a dot.  The driver names
    the uppermost folders, and tasks walk what is below.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top, deep in zip(batch["pasta"], batch["fundo"]):
                for folder, _, names in os.walk(top):
                    yield pd.DataFrame([(os.path.join(folder, n), n) for n in names if wanted(n, suffix)], columns=["caminho", "nome_arquivo"])
                    if not deep:
                        break

    starts = list(_folders(root, SPLIT_DEPTH)) if recursive else [(root, False)]
    found = spark.createDataFrame(starts, "pasta string, fundo boolean").repartition(min(len(starts), 1000)).mapInPandas(run, "caminho string, nome_arquivo string")
    return numbered(found)


def numbered(found: DataFrame) -> DataFrame:
    """found with ordem, counted from 0 in the order of the parts of caminho: ranges are numbered by themselves, and their sizes added."""
    from estante.session import reliable

    ranged = reliable(found.repartitionByRange(F.split("caminho", "/")).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    bases, so_far = [], 0
    for p in sorted(sizes):
        bases.append((p, so_far))
        so_far += sizes[p]
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.split("caminho", "/")))
    base = found.sparkSession.createDataFrame(bases, "_p int, _base bigint")
    return ranged.withColumn("_r", inside).join(F.broadcast(base), "_p").select(*found.columns, (F.col("_base") + F.col("_r") - 1).alias("ordem"))


@lru_cache(maxsize=1)
def markdown_converter() -> Callable | None:
    """(document, page) → Markdown by the optional library, which must never recognise characters; None without it."""
    try:
        import pymupdf4llm
    except ImportError:
        return None
    options = {"show_progress": False}
    try:
        from pymupdf4llm.ocr import OCRMode

        options["use_ocr"] = OCRMode.NEVER
    except ImportError:
        pass
    return lambda document, k: pymupdf4llm.to_markdown(document, pages=[k], **options)


def page_text(document, k: int, markdown: Callable | None) -> str:
    """A page as Markdown, else as plain text, else empty."""
    if markdown is not None:
        try:
            return markdown(document, k)
        except Exception:  # noqa: BLE001 - the plain text is tried next
            pass
    try:
        return document[k].get_text("text")
    except Exception:  # noqa: BLE001 - an unreadable page is left out
        return ""


def convert_pdf(path: str, opener: Callable, markdown: Callable | None = None) -> dict:
    """One document as a row; what goes wrong stands in erro and is never raised. opener: path → object of the PDF library."""
    row = {"caminho": path, "nome_arquivo": os.path.basename(path), "markdown_completo": None, "paginas": None, "total_paginas": None, "metadados_embutidos": None, "erro": None}
    try:
        document = opener(path)
        if getattr(document, "needs_pass", False):
            return row | {"erro": "PDF protegido por senha"}
        pages = [page_text(document, k, markdown) for k in range(document.page_count)]
        if not pages:
            return row | {"erro": "PDF sem páginas"}
        text = "\n\n".join(p for p in pages if p)
        if not text.strip():
            return row | {"erro": "PDF sem texto (provavelmente digitalizado; OCR não é feito)"}
        return row | {"markdown_completo": text, "paginas": pages, "total_paginas": len(pages), "metadados_embutidos": {k: str(v) for k, v in (document.metadata or {}).items() if v}}
    except Exception as problem:  # noqa: BLE001
        return row | {"erro": f"{type(problem).__name__}: {problem}"}


def convert(files: DataFrame, opener: Callable | None = None, markdown: Callable | None = None) -> DataFrame:
    """Converted documents of a listing; needs the optional PDF library unless an opener is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use, pages = opener, markdown or (markdown_converter() if opener is None else None)
        if use is None:
            import pymupdf

            use = pymupdf.open
        for batch in batches:
            for path in batch["caminho"]:
                yield pd.DataFrame([convert_pdf(path, use, pages)], columns=[c.strip().split(" ")[0] for c in CONVERTED.split(", ")])

    return files.select("caminho").mapInPandas(run, CONVERTED)


def names_in(folders: DataFrame) -> DataFrame:
    """pasta, nome: the documents already standing in each of the distinct folders, without their suffix; listed by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["pasta"]:
                names = os.listdir(folder) if os.path.isdir(folder) else []
                yield pd.DataFrame([(folder, n[:-4]) for n in names if n.lower().endswith(".pdf")], columns=["pasta", "nome"])

    return folders.select("pasta").where("pasta is not null").distinct().mapInPandas(run, "pasta string, nome string")
