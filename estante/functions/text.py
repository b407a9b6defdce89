"""Text rules as column expressions, and the SQL of the same rules for comparison."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that identify no document, for file names and for registries.
STOP_FILE = """de da do das dos em no na nos nas para com sem por que uma um sobre entre the and for with from
pdf livro livros artigo artigos revista capitulo final versao version copy copia documento scan download original
analise estudo estudos abordagem reflexao reflexoes consideracoes aspectos introducao panorama revisao ensaio
perspectiva perspectivas questao questoes problema problemas tema temas caso presente trabalho pesquisa
investigacao historia sociedade conceito evolucao constituicao""".split()
STOP_REGISTRY = "de da do das dos e a o as os um uma para com sem em no na nos nas por que the and of in on to".split()
# File name rules.
INVALID = r'[\\/:*?"<>|]'
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
MAX_SEGMENT, MAX_NAME, MAX_PATH, MIN_CUT = 120, 180, 240, 20
NO_VALUE = "Sem informação"
#: White space of Unicode, written out for engines whose \s is ASCII.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose compatibility decomposition is one ASCII character, these, and those with more, by rule."""
    one, more = {}, {}
    for cp in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(cp)] = plain
        elif plain and unicodedata.category(chr(cp)) in ("Ll", "Lu") and cp >= 0xFB00:
            more[chr(cp)] = plain
    return "".join(one), "".join(one.values()), tuple(more.items())


def fold(c: Column) -> Column:
    """Compatibility decomposition cut down to ASCII: what has no counterpart vanishes."""
    source, target, more = fold_table()
    for a, b in more:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")


def fold_sql(x: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    source, target, more = fold_table()
    for a, b in more:
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace(translate({x}, {quote(source)}, {quote(target)}), '[^\\x00-\\x7F]', '', 'g')"


def tokens(c: Column, least: int = 4, stop: list[str] = STOP_FILE) -> Column:
    """The distinct words of at least so many letters that are no stop words, in order; null has none."""
    found = F.regexp_extract_all(F.lower(fold(c)), F.lit(f"([a-z]{{{least},}})"), 1)
    return F.coalesce(F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))), F.array().cast("array<string>"))


def tokens_sql(x: str, least: int = 4, stop: list[str] = STOP_FILE) -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"coalesce(list_sort(list_distinct(list_filter(regexp_extract_all(lower({fold_sql(x)}), '[a-z]{{{least},}}'), lambda w: w NOT IN ({words})))), [])"


def slug(c: Column) -> Column:
    """Lower-case ASCII with hyphens; what leaves nothing is called indefinido."""
    made = F.regexp_replace(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "indefinido").otherwise(made)


def slug_sql(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({fold_sql(f'''coalesce({x}, '')''')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'indefinido')"


def let(c: Column, use) -> Column:
    """use(c) with c computed once, however often use refers to it."""
    return F.element_at(F.transform(F.array(c), use), 1)


#: A character that composition may change: none below the combining marks, nor common dashes and quotes.
COMPOSABLE = r"[^\x{0}-\x{2FF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]"


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(c: Column) -> Column:
    """Composed form; only values with a character that may compose reach Python."""
    return F.coalesce(_nfc(F.when(c.rlike(COMPOSABLE), c)), c)


def sanitize(c: Column, longest: int = MAX_SEGMENT, final: bool = True, composed: bool = False) -> Column:
    """A safe path segment; null and blank give the empty string. composed: the text is known to be in composed form."""
    clean = F.regexp_replace(F.coalesce(c if composed else nfc(c), F.lit("")), INVALID, " ")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\p{C}", " "), r"(?U)\s+", " ")
    clean = F.regexp_replace(clean, "^ | $", "")
    if final:
        clean = F.regexp_replace(clean, "[ .]+$", "")
    cut = let(clean, lambda x: F.when(F.length(x) > longest, F.regexp_replace(F.substring(x, 1, longest), "[ .,;:-]+$", "")).otherwise(x))
    return let(cut, lambda x: F.when(F.length(x).between(3, 4) & F.upper(x).isin(RESERVED), F.concat(F.lit("_"), x)).otherwise(x))


def sanitize_sql(x: str, longest: int = MAX_SEGMENT, final: bool = True) -> str:
    clean = f"regexp_replace(coalesce(nfc_normalize({x}), ''), '{INVALID}', ' ', 'g')"
    clean = f"regexp_replace(regexp_replace({clean}, '\\p{{C}}', ' ', 'g'), '{SPACE}+', ' ', 'g')"
    clean = f"regexp_replace({clean}, '^ | $', '', 'g')"
    if final:
        clean = f"regexp_replace({clean}, '[ .]+$', '')"
    clean = f"(CASE WHEN length({clean}) > {longest} THEN regexp_replace(substring({clean}, 1, {longest}), '[ .,;:-]+$', '') ELSE {clean} END)"
    reserved = ", ".join(f"'{r}'" for r in RESERVED)
    return f"(CASE WHEN upper({clean}) IN ({reserved}) THEN '_' || {clean} ELSE {clean} END)"

