"""Noise in text from scanned pages: where it is, and continuous paragraphs without it.

The words of the whole corpus are counted, apart for scanned files and others.  A
word is a misreading of another if an anagram hash difference of one or two known
confusions leads from it to a word far more frequent, the confusion really gives
the one from the other, and it does not occur in files that were not scanned.  The
hash of a word is a sum of powers of its characters, so a confusion is one number,
and rare words meet their frequent variants by an equality join.

Page numbers and running headers are found at the edges of pages; a hyphen at the
end of a line is a cut if the corpus knows the word without it better than with it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estante.session import reliable

# What was printed and what a scanner reads instead.
CONFUSIONS = [
    ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("o", "0"), ("a", "á"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("n", "ri"), ("s", "5"), ("u", "ii"), ("m", "rn"), ("d", "cl"), ("g", "9"), ("v", "y"), ("ã", "á"), ("õ", "ó"), ("ó", "6"), ("b", "6"), ("h", "li"), ("h", "b"), ("u", "ti"), ("z", "2"), ("b", "8"), ("q", "9"), ("w", "vv"), ("ç", "c"), ("rn", "m"), ("cl", "d"), ("ê", "é"), ("é", "ê"), ("í", "i"), ("i", "í"), ("nn", "m"), ("o", "c"), ("ç", "c,"),
]
#: Confusions that also arise by typing; alone they are no evidence of a scan.
TYPED = {("ç", "c"), ("í", "i"), ("i", "í"), ("é", "ê"), ("ê", "é"), ("o", "c")}

RATIO = 15
#: The longest line of a page, and the share of a text that stands in lines cut at such a width if it was scanned.
WIDTH, CUT_SHARE = 130, 0.3
#: A word with this share of all words is trusted unless it is a misreading: there are at most 1 / TRUSTED_SHARE such words.
TRUSTED_SHARE = 2e-6
MOD = (1 << 61) - 1
HYPHENS = "-‐‑\xad¬"
STRIP = "¡¿.,;:!?…\"“”‘’'()[]{}<>«»*_#/|\\–—" + HYPHENS
ENCLITIC = frozenset("se me te lo la los las lhe lhes nos vos o a os as".split())
NUMBER = re.compile(r"^\s*(?:(?P<plain>[\dlIoO]{1,4})|-\s*(?P<dash>[\dlIoO]{1,4})\s*-|[–—]\s*(?P<long>[\dlIoO]{1,4})\s*[–—]|p(?:[áa]g(?:ina)?)?\s*\.?\s*(?P<p>[\dlIoO]{1,4})|\[\s*(?P<box>[\dlIoO]{1,4})\s*\])\s*$", re.I)
TAILED = re.compile(r"^\s*(?:(?P<a>\S.*?)\s{2,}[\[\-–(]?\s*[\dlIoO]{1,4}\s*[\]\-–)]?|[\[\-–(]?[\dlIoO]{1,4}[\]\-–)]?\s{2,}(?P<b>\S.*?))\s*$")
CUT = re.compile(rf"[^\W_][{HYPHENS}]$")
BROKEN = re.compile(rf"\S+[{HYPHENS}][ \t]*\n\s*\S+")
NAMED = re.compile(r"^[^\W\d_][^.;!?]{2,60}, [^.;!?]{2,60} [—–-] \S")
CARD = re.compile(r"(?i)^\W*(ficha catalogr|dados internacionais de cataloga|cataloga[cç][aã]o na (fonte|publica))")
DIGITS = re.compile(r"^(?=.*\d)(?=.*[lioIO])[\dlioIO]{2,}$")
FOLD = str.maketrans({"l": "i", "1": "i", "í": "i", "!": "i", "0": "o", "c": "e", "f": "t", "5": "s", "9": "g", "y": "v", "6": "o"} | dict(zip("áàâãäéêèóôõòúûü", "aaaaaeeeoooouuu")) | {"ç": "e"})


@lru_cache(maxsize=1 << 20)
def letter(c: str) -> int:
    return pow(ord(c), 5, MOD)


def anagram_hash(word: str) -> int:
    """A number that depends on the characters but not on their order."""
    return sum(map(letter, word)) % MOD


def misreads(seen: str, printed: str, most: int = 2) -> tuple[int, bool] | None:
    """How many confusions turn printed into seen and whether a scanner's is among them; None if they don't."""
    if seen == printed:
        return 0, False
    if not most or not seen or not printed:
        return None
    i = 0
    while i < len(seen) and i < len(printed) and seen[i] == printed[i]:
        i += 1
    best = None
    # A confusion may begin before the first difference, as "rn" for "n" does not but "ri" for "n" after "r" may.
    for at in range(max(0, i - 1), i + 1):
        for a, b in CONFUSIONS:
            if printed.startswith(a, at) and seen.startswith(b, at):
                rest = misreads(seen[at + len(b) :], printed[at + len(a) :], most - 1)
                if rest is not None and (best is None or rest[0] + 1 < best[0]):
                    best = rest[0] + 1, rest[1] or (a, b) not in TYPED
    return best


def fold(line: str) -> str:
    """A form in which misread and right characters are the same."""
    return re.sub(r"[\W\d_]+", "", line.lower().replace("rn", "m").replace("ri", "n").replace("ii", "u").replace("cl", "d").replace("li", "h").translate(FOLD))


def wrapped(text: str) -> bool:
    """Whether lines are cut at a width: lines of a width that go on in the next, and hold a good part of the text.

    A line beyond the width counts as one of that width, so a long heading, address
    or row of a table among cut lines does not hide them.
    """
    lines = text.split("\n")
    sizes = list(map(len, lines))
    cut = [n for n, m, x in zip(sizes, sizes[1:], lines) if 28 < n <= WIDTH and 0 < m <= WIDTH and x[-1] not in ".!?"]
    return len(cut) > 1 and sum(cut) >= CUT_SHARE * sum(n if n < WIDTH else WIDTH for n in sizes)


def scanned(text: str) -> bool:
    """Whether layout and misreadings are looked for at all."""
    return wrapped(text)


def outline(lines: list[str]) -> list[str]:
    """For each line "" if blank, "#" if of a heading or a cataloguing card, else "texto"."""
    kind = ["" if not x.strip() else "#" if x.startswith("#") else "texto" for x in lines]
    card = False
    for i, x in enumerate(lines):
        card = bool(x.strip()) and (card or len(x) < 45 and CARD.match(x) is not None)
        if card:
            kind[i] = "#"
    return kind


class Page:
    """The lines of one text with what each is: "#" heading, "" blank, "pagina", "cabecalho" or "texto"."""

    def __init__(self, text: str):
        self.lines = lines = text.split("\n")
        self.kind = outline(lines)
        full = [i for i, k in enumerate(self.kind) if k]
        place = {i: n for n, i in enumerate(full)}
        title = next((lines[i].lstrip("# ").strip() for i in full if lines[i].startswith("#")), "")
        after = next((lines[i] for i in full if self.kind[i] != "#"), "")
        author = after if len(after) < 60 and ("," in after or "autores" in after.lower()) and not re.search(r"[.!?]$", after) else ""
        self.known = [fold(x) for x in (title, author, f"{author}{title}", f"{title}{author}") if len(fold(x)) > 4]
        heads = {fold(lines[i]) for i in full if lines[i].startswith("#")}
        repeated = Counter(fold(lines[i]) for i in full if len(lines[i]) < 110 and self.kind[i] == "texto")
        self.heads = heads

        numbers: dict[int, tuple[str, int]] = {}
        for i in full:
            if m := NUMBER.match(lines[i]):
                style, digits = next((k, v) for k, v in m.groupdict().items() if v)
                digits = re.sub("[lI]", "1", re.sub("[oO]", "0", digits))
                if any(c.isdigit() for c in m.group()) and digits.isdigit():
                    numbers[i] = style + ("+" if lines[i][:1] == " " else ""), int(digits)
        # A list of years stands under a heading of its own, one number after the other.
        listed = set()
        for i in numbers:
            n = place[i]
            near = [full[m] for m in (n - 1, n + 1) if 0 <= m < len(full)]
            if numbers[i][0] == "plain" and any(j in numbers and abs(j - i) == 1 for j in near):
                listed.add(i)
        for i, (style, value) in numbers.items():
            if i in listed:
                continue
            if style != "plain" or self._paged(i, value, numbers, listed) or self._edge(i, full, place, repeated):
                self.kind[i] = "pagina"
        pages = [i for i in full if self.kind[i] == "pagina"]
        beside = set()
        for i in pages:
            for step in (1, -1):
                j = i + step
                while 0 <= j < len(lines) and not lines[j].strip() and abs(j - i) < 4:
                    j += step
                if 0 <= j < len(lines) and self.kind[j] == "texto":
                    beside.add(j)
        for i in full:
            if self.kind[i] == "texto" and i != full[0] and not (author and lines[i] is after):
                if i in beside and self._header(lines[i], repeated) or (m := TAILED.match(lines[i])) and self._header(m["a"] or m["b"], repeated, sure=True):
                    self.kind[i] = "cabecalho"
        # A header that stands without a page number is known by the others.
        sure = Counter(fold(TAILED.match(lines[i])["a"] or TAILED.match(lines[i])["b"] or "") if TAILED.match(lines[i]) else fold(lines[i]) for i in full if self.kind[i] == "cabecalho")
        for i in full:
            if self.kind[i] == "texto" and i != full[0] and len(lines[i]) < 110 and not (author and lines[i] is after):
                f = fold(lines[i])
                if len(f) > 4 and (f in sure and (lines[i].isupper() or self._like(f)) or repeated[f] > 1 and self._like(f)):
                    self.kind[i] = "cabecalho"

    @staticmethod
    def _paged(i: int, value: int, numbers: dict, listed: set) -> bool:
        return any(j not in listed and j != i and numbers[j][0].startswith("plain") and abs(numbers[j][1] - value) == 1 and (numbers[j][1] - value) * (j - i) > 0 for j in numbers)

    def _edge(self, i: int, full: list[int], place: dict[int, int], repeated: Counter) -> bool:
        """A lone number: a page number if a header stands beside it or it breaks a sentence."""
        n = place[i]
        before, behind = (full[n - 1] if n else None), (full[n + 1] if n + 1 < len(full) else None)
        if any(j is not None and self.kind[j] == "texto" and self._header(self.lines[j], repeated) for j in (before, behind)):
            return True
        if before is not None and self.kind[before] == "texto" and len(self.lines[before]) > 28:
            return True
        return before is None or behind is None

    def _like(self, f: str) -> bool:
        return any(f == k or len(f) >= 8 and (k.startswith(f) or k.endswith(f)) or abs(len(f) - len(k)) <= 4 and SequenceMatcher(None, f, k, autojunk=False).ratio() > 0.86 or len(f) >= 8 and len(k) > len(f) and SequenceMatcher(None, f, k[: len(f)], autojunk=False).ratio() > 0.88 for k in self.known)

    def _header(self, line: str, repeated: Counter, sure: bool = False) -> bool:
        f = fold(line)
        if len(line) > 110 or len(f) < 3:
            return False
        letters = [c for c in line if c.isalpha()]
        capital = len(letters) > 3 and sum(c.isupper() for c in letters) >= 0.9 * len(letters)
        return self._like(f) or capital or NAMED.match(line) is not None or repeated[f] > 1 or sure and f in self.heads


def corpus_words(df: DataFrame, text: str = "markdown_completo") -> DataFrame:
    """w, limpo, lido: how often each word stands in files that were not, and were, scanned; cut words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            sums: dict[str, list[int]] = {}
            for k in (0, 1):
                for raw, n in counts[k].items():
                    w = raw.strip(STRIP)
                    if w:
                        sums.setdefault(w, [0, 0])[k] += n
                counts[k].clear()
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([a for a, _ in sums.values()], pa.int64()), pa.array([b for _, b in sums.values()], pa.int64())], names=["w", "limpo", "lido"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                read = scanned(value)
                counts[read].update((BROKEN.sub(" ", value) if read else value).lower().split())
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
        yield out()

    return df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "w string, limpo bigint, lido bigint").groupBy("w").agg(F.sum("limpo").alias("limpo"), F.sum("lido").alias("lido"))


def misread_words(words: DataFrame) -> DataFrame:
    """w, certo: each word that is a misreading, and the word printed."""
    singles = [((anagram_hash(b) - anagram_hash(a)) % MOD, set(b)) for a, b in CONFUSIONS]
    deltas = sorted({(d, "".join(sorted(s))) for d, s in singles} | {((d + e) % MOD, "".join(sorted(s | t))) for d, s in singles for e, t in singles})

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes, of = batch.column(0).to_pylist(), [], []
            for n, w in enumerate(words):
                own, h = set(w), anagram_hash(w)
                made = {(h - d) % MOD for d, need in deltas if own.issuperset(need)}
                hashes += made
                of += [n] * len(made)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(hashes, pa.int64())], names=["w", "limpo", "lido", "h"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(anagram_hash, batch.column(0).to_pylist())), pa.int64())], names=["certo", "n", "h"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [misreads(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = pa.array([m is not None and m[1] for m in made])
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pa.array([m[0] for m in made if m is not None and m[1]], pa.int64())], names=["w", "certo", "n", "passos"])

    known = words.where(F.col("w").rlike(r"^[\p{L}\-]+$") & (F.col("limpo") > 0) & (F.col("limpo") + F.col("lido") >= RATIO)).select(F.col("w").alias("certo"), (F.col("limpo") + F.col("lido")).alias("n"))
    # No confusion adds more than a character, so longer words than these are no misreading of any.
    longest = (known.agg(F.max(F.length("certo")).alias("n")).first()["n"] or 0) + 2
    # In files that were not scanned a misreading does not occur, but for a stray one in many.
    rare = words.where((F.col("lido") > 0) & (F.col("limpo") * 20 <= F.col("lido")) & (F.length("w") <= longest) & F.col("w").rlike(r"\p{L}|^[0-9]$")).mapInArrow(expand, "w string, limpo bigint, lido bigint, h bigint")
    right = known.mapInArrow(hashed, "certo string, n bigint, h bigint")
    met = rare.join(right, "h").where((F.col("n") >= RATIO * (F.col("limpo") + F.col("lido"))) & (F.col("w") != F.col("certo"))).select("w", "certo", "n")
    best = Window.partitionBy("w").orderBy("passos", F.desc("n"), "certo")
    return met.mapInArrow(verify, "w string, certo string, n bigint, passos bigint").withColumn("k", F.row_number().over(best)).where("k = 1").select("w", "certo")


def _next_text(page: Page, i: int) -> int | None:
    j = i + 1
    while j < len(page.lines) and page.kind[j] in ("", "pagina", "cabecalho"):
        j += 1
    return j if j < len(page.lines) and page.kind[j] == "texto" else None


def line_facts(page: Page, trusted: dict[str, bool]) -> Iterator[tuple[int, str, str | None, str | None]]:
    """line, what, word, word with its hyphen: sure findings have no word; the others depend on the corpus.

    what: a type, "palavra" (misread if word is a misreading) or "corte" (a cut if the corpus knows word better than the other).
    """
    split: dict[int, str] = {}
    for i, (line, kind) in enumerate(zip(page.lines, page.kind)):
        if kind in ("cabecalho", "pagina"):
            yield i + 1, kind, None, None
        if kind != "texto":
            continue
        tokens = line.split()
        skip_first, skip_last = i in split, False
        if tokens and CUT.search(tokens[-1]) and (j := _next_text(page, i)) is not None and (following := page.lines[j].split()):
            one, two = tokens[-1].lower().lstrip(STRIP)[:-1] + "-", following[0].lower().rstrip(STRIP)
            if two[:1].isalpha() or two[:1].isdigit():
                skip_last, split[j] = True, one
                whole, apart = one[:-1] + two, one + two
                known, own = trusted.get(whole, False), trusted.get(apart, False)
                if known and not own:
                    yield i + 1, "hifen", None, None
                elif not (own and not known):
                    yield i + 1, "corte", whole, apart
                if not known:
                    # The misread part stands in the line where the words first differ.
                    yield i + 1, f"inteira:{len(one) - 1}:{j + 1}", whole, apart
        for n, raw in enumerate(tokens):
            if n == 0 and skip_first or n == len(tokens) - 1 and skip_last:
                continue
            w = raw.lower().strip(STRIP)
            if not w or trusted.get(w, False):
                continue
            if DIGITS.match(w) and not w.isalpha():
                yield i + 1, "caractere", None, None
            elif any(c.isalpha() for c in w) or len(w) == 1:
                yield i + 1, "palavra", w, None
                if "-" in w:
                    for part in w.split("-"):
                        if part and not trusted.get(part, False):
                            yield i + 1, "palavra", part, None


def _context(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame, dict[str, bool]]:
    words = reliable(corpus_words(df, text))
    wrong = reliable(misread_words(words))
    total = words.agg(F.sum(F.col("limpo") + F.col("lido")).alias("n")).first()["n"] or 0
    least = max(3, total * TRUSTED_SHARE)
    # At most 1 / TRUSTED_SHARE words reach that share.
    sure = words.where(F.col("limpo") + F.col("lido") >= least).join(wrong, "w", "left_anti").select("w")
    return words, wrong, {r["w"]: True for r in sure.toLocalIterator()}


def _facts(df: DataFrame, key: str, text: str, context: tuple, whole: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of the lines; misread words; sure cuts and those the corpus decides.

    A text is also searched if the text it is a part of, in the column whole, is scanned.
    """
    words, wrong, trusted = context
    share = df.sparkSession.sparkContext.broadcast(trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in batches:
            rows: list[tuple] = []
            for k, value, full in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if scanned(value) or full is not None and scanned(full):
                    rows += {(k, *fact) for fact in line_facts(Page(value), known)}
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], names=["conv_id", "linha", "o_que", "w", "inteira"])

    facts = reliable(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), text, (F.col(whole) if whole else F.lit(None).cast("string")).alias("_inteiro")).mapInArrow(run, "conv_id bigint, linha bigint, o_que string, w string, inteira string"))
    count = lambda n: words.select(F.col("w").alias(n), (F.col("limpo") + F.col("lido")).alias(f"n_{n}"))
    tail, lead = F.element_at(F.split("inteira", "-"), -1), F.element_at(F.split("inteira", "-"), -2)
    cuts = (
        facts.where(F.col("o_que") == "corte")
        .join(wrong.select(F.col("w"), F.lit(True).alias("lida")), "w", "left")
        .join(count("w"), "w", "left")
        .join(count("inteira"), "inteira", "left")
        .withColumn("com", F.coalesce("n_inteira", F.lit(0)))
        .withColumn("sem", F.coalesce("n_w", F.lit(0)))
        .where(F.coalesce(F.col("lida"), F.lit(False)) | (F.col("sem") > F.col("com")) | (F.col("sem") == 0) & (F.col("com") == 0) & ~(tail.isin(*ENCLITIC) & lead.isNotNull()))
        .select("conv_id", "linha", F.lit("hifen").alias("tipo"))
    )
    return facts, wrong, facts.where("w is null").select("conv_id", "linha", F.col("o_que").alias("tipo")).union(cuts)


def scan_noise(df: DataFrame, key: str = "conv_id", text: str = "markdown_completo") -> DataFrame:
    """conv_id, linha bigint, tipo: the lines with scanning noise, counted from 1.

    Null and empty texts, and texts whose lines are not cut at a width, have none.
    Repeated rows of one key count once.
    """
    facts, wrong, sure = _facts(df, key, text, _context(df, text))
    misread = facts.where(F.col("o_que") == "palavra").join(wrong, "w").select("conv_id", "linha", F.lit("caractere").alias("tipo"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, what, seen, printed in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                _, cut, other = what.split(":")
                first = next((n for n, (a, b) in enumerate(zip(seen, printed)) if a != b), 0)
                out.append(line if first < int(cut) else int(other))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["conv_id", "linha"])

    halves = facts.where(F.col("o_que").startswith("inteira")).join(wrong, "w").select("conv_id", "linha", "o_que", "w", "certo").mapInArrow(place, "conv_id bigint, linha bigint").withColumn("tipo", F.lit("caractere"))
    return sure.union(misread).union(halves).distinct()


def repaired(df: DataFrame, key: str = "conv_id", text: str = "markdown_completo", beginning: str | None = None) -> DataFrame:
    """conv_id, texto[, inicial]: the texts in continuous paragraphs, one row for every row of df with a key.

    Page numbers and headers are left out, cut words joined, misread words replaced
    by the word printed, and the lines of a paragraph joined.  Texts that are not
    scanned come out as they are; null stays null.  inicial is the column beginning,
    which may hold a page of its own, repaired by the words of the whole texts.
    """
    context = _context(df, text)
    columns = [(text, "texto", None)] + ([(beginning, "inicial", text)] if beginning else [])
    whole = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), *[F.col(source).alias(name) for source, name, _ in columns])
    for source, name, of in columns:
        facts, wrong, sure = _facts(df, key, source, context, of)
        right = facts.where((F.col("o_que") == "palavra") | F.col("o_que").startswith("inteira")).select("conv_id", "w").distinct().join(wrong, "w").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "certo"))).alias(f"certos_{name}"))
        lines = sure.distinct().groupBy("conv_id").agg(F.collect_list(F.struct("linha", "tipo")).alias(f"achados_{name}"))
        whole = whole.join(right, "conv_id", "left").join(lines, "conv_id", "left")
    names = [name for _, name, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, of = [], batch.column(1).to_pylist()
            for n in range(len(names)):
                made.append([
                    value if value is None or not (scanned(value) or full is not None and scanned(full)) else continuous(value, dict(words or []), {(x["linha"], x["tipo"]) for x in found or []})
                    for full, value, words, found in zip(of, *(batch.column(3 * n + k).to_pylist() for k in (1, 2, 3)))
                ])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(texts, pa.string()) for texts in made)], names=["conv_id", *names])

    order = [c for name in names for c in (name, f"certos_{name}", f"achados_{name}")]
    return whole.select("conv_id", *order).mapInArrow(run, ", ".join(["conv_id bigint", *(f"{name} string" for name in names)]))


def continuous(text: str, right: dict[str, str], found: set[tuple[int, str]]) -> str:
    """The paragraphs of a scanned text without its noise."""

    def word(m: re.Match) -> str:
        new = right.get(m.group().lower())
        return m.group() if new is None else new.upper() if m.group().isupper() and len(m.group()) > 1 else new.capitalize() if m.group()[:1].isupper() else new

    # What is a header or a page number stands in found, so the lines need no second judgement.
    lines, out, at, cut = text.split("\n"), [], "", False
    drop = {n for n, kind in found if kind in ("cabecalho", "pagina")}
    dropped = False
    for i, (line, kind) in enumerate(zip(lines, outline(lines))):
        if i + 1 in drop:
            dropped = True
            continue
        if not kind or kind == "#":
            # A blank line beside a dropped one is no end of a paragraph while the sentence goes on.
            if kind or at and not cut and not (dropped and at[-1:] not in ".!?:"):
                if at:
                    out.append(at)
                at = ""
            if kind:
                out.append(line)
            continue
        # A cut word goes on without its hyphen, a word with a hyphen of its own with it.
        at = at + line.strip() if cut or CUT.search(at) else f"{at} {line.strip()}".strip()
        cut = (i + 1, "hifen") in found
        if cut:
            at = at[:-1]
        dropped = False
    return re.sub(r"[\w-]+", word, "\n\n".join([*out, at] if at else out))
