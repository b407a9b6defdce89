"""Identifiers and citations as column expressions (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estante.functions.text import let

SEPARATORS = r"[\s\-–—]"
# Prefixes of a DOI, of which the first that fits is cut.
DOI_PREFIX = r"(?i)^(https://doi\.org/|http://doi\.org/|http://dx\.doi\.org/|doi:)"
DOI_IN_TEXT = r"10\.\d{4,9}/[^\s,;\"'）)]+"
YEAR_IN_TEXT = r"(?:19|20)\d{2}"


def escaped(c: Column) -> Column:
    """The text as a pattern that matches it: every sign that is no letter or digit is escaped."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def bare(text: Column) -> Column:
    """The text that confirmed() searches first: in lower case, without separators."""
    return F.lower(F.regexp_replace(text, rf"(?U){SEPARATORS}", ""))


def confirmed(value: Column, text: Column, plain: Column | None = None) -> Column:
    """Whether the code stands in the text on its own, whatever separators are between its characters.

    A plain search in the text without separators, which must succeed first, spares
    most rows the pattern built for their own value.  plain: bare(text), where it is
    at hand because many codes are looked for in one text.
    """
    core = F.regexp_replace(value, rf"(?U){SEPARATORS}", "")
    pattern = F.concat(F.lit(r"(?iU)\b"), F.array_join(F.transform(F.split(core, ""), lambda x: escaped(x)), rf"{SEPARATORS}*"), F.lit(r"\b"))
    maybe = F.contains(bare(text) if plain is None else plain, F.lower(core))
    return F.coalesce(F.when(core == "", False).when(maybe, F.regexp_like(text, pattern)).otherwise(False), F.lit(False))


def confirmed_sql(value: str, text: str) -> str:
    core = f"regexp_replace({value}, '{SEPARATORS}', '', 'g')"
    return f"coalesce({core} <> '' AND regexp_matches({text}, '(?i)\\b' || array_to_string(list_transform(string_split({core}, ''), lambda x: regexp_escape(x)), '{SEPARATORS}*') || '\\b'), false)"


def _first_out(text: Column, pattern: Column) -> Column:
    """The text without the first match."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?siU)^(.*?)"), pattern), F.lit("$1"))


def _without(text: Column, label: str, value: Column) -> Column:
    """The citation without the first mention of the value: labelled, as an address, or bare."""
    v = escaped(value)
    options = [
        F.concat(F.lit(rf"\s*\b{label}\b:?\s*\b"), v, F.lit(r"\b\.?")),
        F.concat(F.lit(r"\s*\bhttps?://(?:dx\.|www\.)?doi\.org/"), v, F.lit(r"\b\.?")),
        F.concat(F.lit(r"\s*\b"), v, F.lit(r"\b\.?")),
    ]

    def first_change(t: Column) -> Column:
        last = _first_out(t, options[2])
        later = let(_first_out(t, options[1]), lambda c: F.when(c != t, c).otherwise(last))
        return let(_first_out(t, options[0]), lambda c: F.when(c != t, c).otherwise(later))

    return let(text, first_change)


def without_sql(text: str, label: str, value: str) -> str:
    v = f"regexp_escape({value})"
    cut = [
        f"regexp_replace({text}, '(?i)\\s*\\b{label}\\b:?\\s*\\b' || {v} || '\\b\\.?', '')",
        f"regexp_replace({text}, '(?i)\\s*\\bhttps?://(?:dx\\.|www\\.)?doi\\.org/' || {v} || '\\b\\.?', '')",
        # Here \\b knows ASCII only: a value of signs alone stands between two word characters of any script.
        f"(CASE WHEN regexp_matches({value}, '[A-Za-z0-9]') THEN regexp_replace({text}, '(?i)\\s*\\b' || {v} || '\\b\\.?', '') ELSE regexp_replace({text}, '([\\p{{L}}\\p{{N}}_])' || {v} || '([\\p{{L}}\\p{{N}}_])', '\\1\\2') END)",
    ]
    return f"(CASE WHEN {cut[0]} <> {text} THEN {cut[0]} WHEN {cut[1]} <> {text} THEN {cut[1]} ELSE {cut[2]} END)"


def doi_in(text: Column) -> Column:
    """The first DOI in a text, without dots at its end; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(text, f"({DOI_IN_TEXT})", 1), r"\.+$", "")
    return F.when(found != "", found)


def discard_unconfirmed(isbn: Column, issn: Column, doi: Column, citation: Column, text: Column, plain: Column | None = None) -> Column:
    """isbn, issn, doi, referencia: codes that the text does not hold are nulled and leave the citation, one after the other.

    plain: bare(text), where it is at hand.
    """
    filled = lambda c: F.when(c != "", c)
    codes = F.struct(filled(isbn).alias("isbn"), filled(issn).alias("issn"), F.coalesce(filled(doi), doi_in(citation)).alias("doi"), (bare(text) if plain is None else plain).alias("p"))
    names = ("isbn", "issn", "doi")
    tidy = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")

    def dropped(left: Column, x: Column, n: str) -> Column:
        return let(left, lambda t: F.when(x[n].isNotNull() & ~x[f"{n}_ok"], _without(t, n.upper(), x[n])).otherwise(t))

    def judged(x: Column) -> Column:
        left = citation
        for n in names:
            left = dropped(left, x, n)
        return F.struct(*[F.when(x[f"{n}_ok"], x[n]).alias(n) for n in names], let(left, lambda t: F.when(t != citation, tidy(t)).otherwise(citation)).alias("referencia"))

    checked = lambda x: F.struct(*[x[n].alias(n) for n in names], *[confirmed(x[n], text, x["p"]).alias(f"{n}_ok") for n in names])
    return let(let(codes, checked), judged)


def surnames_upper(citation: Column, authors: Column) -> Column:
    """The citation with the family names of "Surname, Rest" authors in capitals where they stand literally."""

    def step(text: Column, author: Column) -> Column:
        family, rest = F.trim(F.substring_index(author, ",", 1)), F.trim(F.substring(author, F.instr(author, ",") + 1, F.length(author)))
        plain, capital = F.concat(family, F.lit(", "), rest), F.concat(F.upper(family), F.lit(", "), rest)
        return F.when(author.contains(",") & (family != "") & (rest != "") & ~F.contains(text, capital), F.replace(text, plain, capital)).otherwise(text)

    return F.aggregate(F.coalesce(authors, F.array().cast("array<string>")), citation, lambda a, x: F.coalesce(step(a, x), a))


def doi_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), DOI_PREFIX, "")


def isbn_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s-]", "")


def year_in(c: Column) -> Column:
    """The first year of the last or this century in a free date."""
    return F.regexp_extract(c, f"({YEAR_IN_TEXT})", 1).try_cast("int")


def year_of_parts(*dates: Column) -> Column:
    """Of several lists of date parts, the first usable year (element 0 of element 0)."""
    return F.coalesce(*[F.nullif(F.get(F.get(d, 0), 0), F.lit(0)) for d in dates])
