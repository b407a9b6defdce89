"""Reading level of running prose by regularised ordinal regression.

The features of a document are statistics over its sentences: length, word length,
lexical diversity, rarity of the words in the whole corpus, connectives, and
subordination marks as a proxy of clause depth.  A proportional-odds model with an
L2 penalty is fitted to a bounded sample of graded documents and gives the level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.session import reliable

#: Words of this share of all words, of which there are at most 1 / KNOWN_SHARE, have a rarity of their own; the others are all as rare as that.
KNOWN_SHARE = 2e-6
MAX_LABELS = 20_000
PENALTY = 0.02

# Connectives of argument and subordinators, Portuguese, Spanish and English.
CONNECTIVES = frozenset(
    """que porque quando embora enquanto conforme segundo portanto contudo todavia entretanto outrossim destarte porquanto tampouco ademais assim porém pois cujo cuja cujos cujas qual quais
    aunque cuando mientras según porque sino cuyo cuya cual cuales además tampoco asimismo
    although because while whereas however nevertheless therefore hence which whose albeit insofar thereby unlike whom moreover""".split()
)
# First lines of attached lists and cards, folded.
LIST_HEADS = re.compile(r"(?i)^\W*(refer[eê]ncias?(?: bibliogr[aá]ficas?)?|referencias?|references|bibliograf[ií]a|bibliography|works cited|obras citadas|[ií]ndice|index|sum[aá]rio|contents|cronologia|datas citadas|quadro de anos|fechas|dates)\s*:?\s*$")
CARD_HEADS = re.compile(r"(?i)^\W*(ficha catalogr[aá]fica|cataloga[cç][aã]o na (?:publica[cç][aã]o|fonte)|dados internacionais de cataloga[cç][aã]o|cip[- ]brasil|cataloging[- ]in[- ]publication)")
STOCK = re.compile(r"(?i)^\W*(esta obra foi preparada pel|cataloga[cç][aã]o na fonte elaborada)")
ENTRY = re.compile(r"^\s*(?:[-*•\[\d]|[A-ZÀ-Þ'-]{3,}, |ISBN|ISSN|CDD|CDU|DOI|\S{1,20}:\s)")
FRONT = re.compile(r"\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
BLANK = re.compile(r"\n[ \t]*\n")
ENDING = re.compile(r"[.!?…]")
PUNCTUATION, CLOSING, ENDS = "¡¿.,;:!?…\"“”‘’'()[]{}<>«»*_#/|\\–—-", "\"”’')]»", (".", "!", "?", "…")
FEATURES = 14
RAREST = -math.log(KNOWN_SHARE)


def prose(text: str | None) -> str:
    """The running prose of a text: no front matter, lists, cards, headings or stock notes."""
    if not text:
        return ""
    if "---" in text:
        text = FRONT.sub("", text, count=1)
    out = []
    for block in BLANK.split(text):
        lines = [x for x in block.split("\n") if x.strip()]
        for i, x in enumerate(lines):
            if len(x) < 400 and (CARD_HEADS.match(x) and not STOCK.match(x) or len(x) < 60 and LIST_HEADS.match(x)):
                del lines[i:]
                break
        kept = [x for x in lines if not (x[0] == "#" or STOCK.match(x))]
        if kept and (len(kept) == 1 or sum(bool(ENTRY.match(x)) for x in kept) * 2 <= len(kept)) and any(x.count(" ") > 1 or ENDING.search(x) for x in kept):
            out.append(" ".join(kept))
    return " . ".join(out)


class _Lexicon:
    """What a worker knows of each token between white space, in rows by the token's number.

    A row holds the number of the word within (punctuation stripped), whether there
    is a word, its length, rarity and whether it is a connective, the marks of
    subordination (commas, colons, semicolons), and whether a sentence ends.
    """

    LIMIT = 400_000

    def __init__(self, rarity: dict[str, float] | None):
        self.rarity = rarity
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 7))

    def numbers(self, tokens: list[str]) -> list[int]:
        known = self.number
        try:
            return [known[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = len(self.rows)
                    w = t.strip(PUNCTUATION)
                    is_word = any(c.isalpha() for c in w)
                    rare = self.rarity.get(w, RAREST) if is_word and self.rarity is not None else 0.0
                    self.rows.append((self.words.setdefault(w, len(self.words)), is_word, len(w) * is_word, rare, w in CONNECTIVES, sum(map(t.count, ",;:")), t.rstrip(CLOSING)[-1:] in ENDS))
            return [known[t] for t in tokens]

    def columns(self) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, dtype=float)
        return self.table


def _medians(value: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The median of value in each run of equal doc."""
    ordered = value[np.lexsort((value, doc))]
    return (ordered[start + (size - 1) // 2] + ordered[start + size // 2]) / 2


def features(texts: list[str | None], lexicon: _Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The places of the texts with running prose, and a row of features for each."""
    if len(lexicon.rows) > lexicon.LIMIT:
        lexicon.clear()
    ids: list[int] = []
    counts: list[int] = []
    for text in texts:
        tokens = prose(text).lower().split()
        ids += lexicon.numbers(tokens)
        counts.append(len(tokens))
    none = np.zeros(0, int), np.zeros((0, FEATURES))
    if not ids:
        return none
    token = np.array(ids)
    doc = np.repeat(np.arange(len(texts)), counts)
    word, is_word, length, rare, link, mark, end = lexicon.columns()[token].T
    # A sentence ends at its mark or with its text.
    last = end.astype(bool)
    last[np.cumsum(counts)[np.array(counts) > 0] - 1] = True
    at = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    size = np.add.reduceat(is_word, at)
    real = size > 0
    per = lambda v: np.add.reduceat(v, at)[real]
    sdoc, size = doc[at][real], size[real]
    if not len(sdoc):
        return none
    chars, long, longer, rarity, links, mark = per(length), per((length >= 9).astype(float)), per((length >= 12).astype(float)), per(rare), per(link), per(mark)
    keep, start = np.unique(sdoc, return_index=True)
    n = np.diff(np.append(start, len(sdoc)))
    total = lambda v: np.add.reduceat(v, start)
    mid = lambda v: _medians(v, sdoc, start, n)
    words = total(size)
    base = len(lexicon.words) + 1
    pairs = np.unique((doc * base + word.astype(np.int64))[is_word > 0])
    kinds = np.bincount(pairs // base, minlength=len(texts))[keep]
    x = [
        np.log(mid(size)), np.log(words / n), mid(chars / size), total(chars) / words, mid(long / size), total(long) / words, mid(longer / size), total(longer) / words,
        mid(mark), total(mark) / n, total(links / size) / n, kinds / np.sqrt(2 * words), mid(rarity / size), total(rarity / size) / n,
    ]
    return keep, np.column_stack(x)


def word_rarity(df: DataFrame, text: str = "text") -> dict[str, float]:
    """-log of each known word's share of all words of the corpus, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for token, n in tokens.items():
                w = token.strip(PUNCTUATION)
                if any(c.isalpha() for c in w):
                    words[w] += n
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["w", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                tokens.update(value.lower().split())
            if len(tokens) > 200_000:
                yield out()
        yield out()

    counted = reliable(df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 1
    return {r["w"]: -math.log(r["n"] / total) for r in counted.where(F.col("n") >= KNOWN_SHARE * total).toLocalIterator()}


class OrdinalModel:
    """P(level <= k) = sigmoid(cut_k - w . x), fitted by full-batch descent with an L2 penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 3000):
        self.levels = np.unique(y)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        cls = np.searchsorted(self.levels, y)
        k = len(self.levels) - 1
        self.w, self.cuts = np.zeros(x.shape[1]), np.linspace(-1.5, 1.5, max(k, 0))
        if not k:
            return
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        # Each document counts by the inverse of its level's frequency, half way, so that rare levels are learned too.
        weight = np.sqrt(len(cls) / np.bincount(cls, minlength=k + 1))[cls]
        weight /= weight.sum()
        m, v = np.zeros(len(self.w) + k), np.zeros(len(self.w) + k)
        for step in range(1, steps + 1):
            s = z @ self.w
            upper = np.where(cls < k, sigmoid(np.append(self.cuts, 0)[np.minimum(cls, k - 1)] - s), 1.0)
            lower = np.where(cls > 0, sigmoid(self.cuts[np.maximum(cls - 1, 0)] - s), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) * (cls < k), lower * (1 - lower) * (cls > 0)
            grad_s = weight * (du - dl) / p
            grad_c = np.zeros(k)
            np.add.at(grad_c, np.minimum(cls, k - 1), -weight * du / p)
            np.add.at(grad_c, np.maximum(cls - 1, 0), weight * dl / p)
            grad = np.concatenate([z.T @ grad_s + penalty * self.w / 10, grad_c])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            self.w -= move[: len(self.w)]
            self.cuts = np.sort(self.cuts - move[len(self.w) :])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.cuts, ((x - self.mean) / self.scale) @ self.w)]


def _feature_rows(df: DataFrame, rarity: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(rarity.value)
        for batch in batches:
            keep, x = features(batch.column(1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return df.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


def fit(df: DataFrame, labels: DataFrame, rarity: Broadcast, max_labels: int = MAX_LABELS) -> OrdinalModel | None:
    """The model of a sample of at most max_labels graded documents, taken by hash; None without any."""
    sample = labels.where("doc_id is not null and nivel is not null").groupBy("doc_id").agg(F.max("nivel").alias("nivel")).orderBy(F.xxhash64("doc_id")).limit(max_labels)
    graded = _feature_rows(df.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"), rarity).join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    return OrdinalModel(np.array(graded["x"].tolist()), graded["nivel"].to_numpy()) if len(graded) else None


def reading_level(df: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, nivel bigint: one row for each document with running prose.

    df: doc_id, text; labels: doc_id, nivel.  Documents that are null, blank, or
    only lists, cards and front matter have no row.  Repeated rows stay repeated.
    Without any graded document nothing can be calibrated and the result is empty.
    """
    rarity = df.sparkSession.sparkContext.broadcast(word_rarity(df))
    model = fit(df, labels, rarity, max_labels)
    if model is None:
        return df.sparkSession.createDataFrame([], "doc_id bigint, nivel bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(rarity.value)
        for batch in batches:
            keep, x = features(batch.column(1).to_pylist(), lexicon)
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(model.predict(x).astype(np.int64))], names=["doc_id", "nivel"])

    return df.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, nivel bigint")
