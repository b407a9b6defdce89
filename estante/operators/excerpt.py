"""The excerpt that an extractor is shown: first pages, the cataloguing page found further on, and a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs of a cataloguing page, how far it is looked for, and its share of the budget.
CIP = r"(?i)isbn|issn|\bdoi\b|ficha catalogr[áa]fica|catalogac?[aã]o na publicac?[aã]o|dados internacionais de catalogac?[aã]o|cip[\s-]brasil"
SEARCH_PAGES, SHARE = 25, 3
PAGES, BUDGET = 6, 15_000
SEPARATOR = "\n\n[...]\n\n"


def pages_of(text: Column, size: int) -> Column:
    """Pages of a fixed number of characters, for texts that come without page marks."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def cip_page(pages: Column, first: int = PAGES) -> Column:
    """The index of the first page from first on, within SEARCH_PAGES, with a sign of the cataloguing page; null if none."""
    seen = F.transform(F.slice(pages, first + 1, max(SEARCH_PAGES - first, 0)), lambda p, i: F.when(p.rlike(CIP), i + first))
    return F.array_min(F.filter(seen, lambda x: x.isNotNull()))


def combine(main: Column, extra: Column, budget: int = BUDGET) -> Column:
    """Main and extra within the budget: extra gets a third of it at most, main the rest."""
    for_extra = F.least(F.length(extra), F.lit(max(budget // SHARE, 1)))
    kept = F.regexp_replace(F.substring(main, F.lit(1), F.greatest(F.lit(budget) - for_extra, F.lit(0))), r"(?U)\s+$", "")
    both = F.concat(kept, F.lit(SEPARATOR), F.substring(extra, F.lit(1), for_extra))
    blank = F.coalesce(extra, F.lit("")).rlike(r"(?U)^\s*$")
    return F.substring(F.when(blank, F.substring(main, 1, budget)).otherwise(both), 1, budget)


def excerpts(df: DataFrame, pages: Column, first: int = PAGES, budget: int = BUDGET) -> DataFrame:
    """df with pagina_ficha and trecho; within the row, without exploding the pages."""
    with_pages = df.withColumn("_p", pages).withColumn("pagina_ficha", cip_page(F.col("_p"), first))
    main = F.array_join(F.slice("_p", 1, first), "")
    extra = F.coalesce(F.when(F.col("pagina_ficha").isNotNull(), F.array_join(F.slice("_p", F.col("pagina_ficha") + 1, F.lit(2)), "")), F.lit(""))
    return with_pages.withColumn("trecho", combine(main, extra, budget)).drop("_p")


def useful_embedded(c: Column) -> Column:
    """Of embedded metadata the six known keys with a value, trimmed."""
    # The keys kept.
    keys = ["title", "author", "subject", "keywords", "creator", "producer"]
    clean = F.transform_values(F.map_filter(c, lambda k, v: k.isin(keys) & v.isNotNull()), lambda k, v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
    return F.map_filter(clean, lambda k, v: v != "")


def user_prompt(file_name: Column, pages: Column, embedded: Column, excerpt: Column) -> Column:
    """The prompt of one document: file name, page count, embedded metadata, excerpt."""
    lines = F.transform(F.array_sort(F.map_entries(F.coalesce(useful_embedded(embedded), F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", F.concat(F.lit("Arquivo: "), file_name), F.concat(F.lit("Páginas: "), pages.cast("string")), F.when(F.size(lines) > 0, F.lit("Metadados embutidos:")), lines, F.lit(""), excerpt)
