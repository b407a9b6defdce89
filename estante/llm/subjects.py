"""Subject mixtures of documents by anchored non-negative factorisation.

The document-term matrix is factored in W (terms x areas) and H (documents x areas)
by alternating multiplicative updates for the generalised Kullback-Leibler
divergence.  W is seeded: the terms that stand far more often in documents hinted
to be of an area than elsewhere anchor its component, and a zero in W stays zero.
The hints are doubtful, one by one, but anchors come from the counts over all
documents.  Rows of H, each component being an area, are the subject mixtures.

What is gathered on the driver is bounded: a term is kept if it occurs in at least
MIN_DF of all documents, and the matrix W has one column per area.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estante.session import reliable

MIN_DF, MAX_DF = 0.0004, 0.6
MIN_DOCS = 4
ROUNDS, STEPS = 4, 25
LIFT = 2.5
#: So many labelled documents are broadcast with their areas; more are joined by a shuffle.
BROADCAST_DOCS = 200_000
STRIP = "¡¿.,;:!?…\"“”‘’'()[]{}<>«»*_#/|\\–—-‐\xad¬"


class Terms:
    """Terms of texts: words in lower case without the punctuation around them."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def of(self, text: str) -> list[str]:
        text = text.lower()
        for cut in ("-\n", "‐\n", "\xad\n", "¬\n"):
            if cut in text:
                text = text.replace(cut, "")
        tokens = text.split()
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            for t in tokens:
                if t not in known:
                    w = t.strip(STRIP)
                    known[t] = w if len(w) > 2 and not any(c.isdigit() for c in w) else ""
            return [known[t] for t in tokens]


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """t, n: in how many rows each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = Terms(), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["t", "n"])
            counts.clear()
            return made

        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(set(terms.of(value)))
            if len(counts) > 300_000:
                yield out()
        yield out()

    return df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "t string, n bigint").where("t <> ''").groupBy("t").agg(F.sum("n").alias("n"))


def compact(df: DataFrame, key: str, path: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """conv_id, caminho, ids, ns, palavras: the rows of the document-term matrix, sparse, and the number of words."""
    share = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, number = Terms(), share.value
        for batch in batches:
            ids, ns, ends, words = [], [], [0], []
            for value in batch.column(2).to_pylist():
                every = terms.of(value)
                found, n = np.unique([number[t] for t in every if t in number], return_counts=True)
                words.append(len(every))
                ids.append(found)
                ns.append(n)
                ends.append(ends[-1] + len(found))
            offsets = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32))) for x in (ids, ns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(words, pa.int64())], names=["conv_id", "caminho", "ids", "ns", "palavras"])

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), F.col(path).alias("caminho"), text).mapInArrow(run, "conv_id bigint, caminho string, ids array<int>, ns array<int>, palavras bigint")


def _sparse(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each entry of the lists in columns first and first + 1."""
    size = batch.column(first).value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(batch)), size), batch.column(first).flatten().to_numpy(zero_copy_only=False), batch.column(first + 1).flatten().to_numpy(zero_copy_only=False).astype(float)


def hints(records: DataFrame, areas: DataFrame) -> DataFrame:
    """caminho, dica: the area named most often, letter by letter, by the records of a file."""
    names = areas.where("nivel = 'area' and nome is not null").groupBy("nome").agg(F.min("area_id").alias("dica"))
    told = records.where("caminho is not null").select("caminho", F.col("area_principal").alias("nome")).join(F.broadcast(names), "nome").groupBy("caminho", "dica").agg(F.count("*").alias("n"))
    most = Window.partitionBy("caminho").orderBy(F.desc("n"), "dica")
    return told.withColumn("k", F.row_number().over(most)).where("k = 1").select("caminho", "dica")


def anchors(counts: np.ndarray, docs: np.ndarray, lift: float = LIFT) -> np.ndarray:
    """Terms x areas, the seeds of W: how much more often a term stands in the documents of an area than in others.

    counts: documents with the term by hinted area; docs: documents by hinted area.
    """
    total, whole = counts.sum(1, keepdims=True), docs.sum()
    rate = (counts + 0.5 * docs / max(whole, 1)) / np.maximum(docs, 1)
    overall = (total + 0.5) / max(whole, 1)
    # Against the documents of all other areas, so that an area with a third of the documents has anchors too.
    ratio = rate / ((total - counts + 0.5) / np.maximum(whole - docs, 1))
    # The excess must be beyond chance: a normal bound on the count.
    expected = overall * docs
    beyond = counts > expected + 3 * np.sqrt(expected + 1)
    seed = np.where((ratio >= lift) & beyond, counts - expected, 0.0)
    # An area with less than half of the excess of a term's best area has it from documents of both.
    seed[seed < 0.5 * seed.max(1, keepdims=True)] = 0
    return seed


class Entries:
    """The entries of a batch of documents by the areas their terms have weight in: a term has few, as a zero in W stays zero."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, size: int, w: np.ndarray):
        rows, self.k = np.nonzero(w), w.shape[1]
        each = np.bincount(rows[0], minlength=len(w))
        keep = each[term] > 0
        doc, term, self.n, self.size = doc[keep], term[keep], n[keep], size
        many = each[term]
        self.of = np.repeat(np.arange(len(term)), many)
        first = (np.cumsum(each) - each)[term] - (np.cumsum(many) - many)
        at = np.arange(len(self.of)) + first[self.of]
        self.weight = w[rows][at]
        self.cell, self.term_cell = doc[self.of] * self.k + rows[1][at], term[self.of] * self.k + rows[1][at]
        self.mass = np.bincount(doc, self.n, size)

    def shares(self, h: np.ndarray) -> np.ndarray:
        """How much of its count each entry gives each of its areas."""
        part = self.weight * h[self.cell]
        fit = np.bincount(self.of, part, len(self.n)) + 1e-12
        return part * (self.n / fit)[self.of]

    def mixtures(self, steps: int) -> np.ndarray:
        """H for given W, flat: multiplicative updates of all documents at once; the sum of a row is the number of its terms."""
        h = np.ones(self.size * self.k)
        for _ in range(steps):
            h = np.bincount(self.cell, self.shares(h), len(h))
        return h


def mixtures(doc: np.ndarray, term: np.ndarray, n: np.ndarray, size: int, w: np.ndarray, steps: int = STEPS) -> np.ndarray:
    return Entries(doc, term, n, size, w).mixtures(steps).reshape(size, w.shape[1])


def _summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    got = rows.groupBy("t", "a").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(shape)
    out[got["t"].to_numpy(int), got["a"].to_numpy(int)] = got["v"].to_numpy(float)
    return out


def _entries(m: np.ndarray) -> pa.RecordBatch:
    t, a = np.nonzero(m)
    return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(m[t, a])], names=["t", "a", "v"])


def factor(matrix: DataFrame, areas: list[int], size: int, rounds: int = ROUNDS) -> np.ndarray:
    """W (terms x areas, columns summing to one) from the rows conv_id, ids, ns, dica of all documents."""
    k, place = len(areas), {a: i for i, a in enumerate(areas)}

    def hinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((size + 1, k))
        for batch in batches:
            doc, term, _ = _sparse(batch, 0)
            area = np.array([place[a] for a in batch.column(2).to_pylist()], int)
            np.add.at(counts, (term, area[doc]), 1)
            np.add.at(counts, (np.full(len(area), size), area), 1)
        yield _entries(counts)

    counts = _summed(matrix.where(F.col("dica").isin(areas)).select("ids", "ns", "dica").mapInArrow(hinted, "t int, a int, v double"), (size + 1, k))
    w = anchors(counts[:-1], counts[-1])
    w = w / np.maximum(w.sum(0), 1e-12)

    for _ in range(rounds):
        share = matrix.sparkSession.sparkContext.broadcast(w)

        def update(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            now = share.value
            sums = np.zeros(now.size)
            for batch in batches:
                every = Entries(*_sparse(batch, 0), len(batch), now)
                sums += np.bincount(every.term_cell, every.shares(every.mixtures(STEPS)), now.size)
            yield _entries(sums.reshape(now.shape))

        w = _summed(matrix.select("ids", "ns").mapInArrow(update, "t int, a int, v double"), w.shape)
        w = w / np.maximum(w.sum(0), 1e-12)
    return w


def subject_mixtures(df: DataFrame, records: DataFrame, areas: DataFrame, key: str = "conv_id", path: str = "caminho", text: str = "markdown_completo") -> DataFrame:
    """conv_id, area_id, parte, densidade: the share of each area in each document, and of subject terms in its words.

    Shares under 0.02 have no row, and documents without any subject term have none.
    Null texts have no row; repeated rows of a key stay repeated.
    """
    codes = sorted(r["area_id"] for r in areas.where("nivel = 'area' and area_id is not null").select("area_id").distinct().collect())
    n_docs = df.where(F.col(text).isNotNull()).count()
    least = max(MIN_DOCS, MIN_DF * n_docs)
    terms = sorted(r["t"] for r in document_frequencies(df, text).where(F.col("n").between(least, max(least, MAX_DF * n_docs))).collect())
    empty = df.sparkSession.createDataFrame([], "conv_id bigint, area_id bigint, parte double, densidade double")
    if not terms or not codes:
        return empty
    rows = compact(df, key, path, text, {t: i for i, t in enumerate(terms)})
    matrix = reliable(rows.join(hints(records, areas), "caminho", "left").select("conv_id", "ids", "ns", "palavras", "dica"))
    w = factor(matrix, codes, len(terms))
    if not w.any():
        return empty

    fitted = df.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = Entries(*_sparse(batch, 1), len(batch), fitted.value)
            h, mass = every.mixtures(STEPS).reshape(len(batch), -1), every.mass
            share = h / np.maximum(h.sum(1, keepdims=True), 1e-12)
            share[mass == 0] = 0
            d, a = np.nonzero(share >= 0.02)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(np.array(codes, np.int64)[a]), pa.array(share[d, a]), pa.array((mass / np.maximum(batch.column(3).to_numpy(), 1))[d])], names=["conv_id", "area_id", "parte", "densidade"])

    return matrix.select("conv_id", "ids", "ns", "palavras").mapInArrow(run, "conv_id bigint, area_id bigint, parte double, densidade double")


def _quantile(values: DataFrame, q: float) -> float:
    """The exact quantile of the column v, linear between two values.

    Equal values are counted and cut in ranges; only the range with the rank is put in order, and no range comes to the driver.
    """
    ranges = reliable(values.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("_b", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in ranges.groupBy("_b").agg(F.sum("n")).collect())
    last = sum(n for _, n in sizes) - 1
    upto = Window.partitionBy("_b").orderBy("v")

    def at(rank: int) -> float:
        for b, n in sizes:
            if rank < n:
                break
            rank -= n
        return ranges.where(F.col("_b") == b).withColumn("_s", F.sum("n").over(upto)).where(F.col("_s") > rank).agg(F.min("v")).first()[0]

    low = int(q * last)
    return float(np.interp(q * last, [low, low + 1], [at(low), at(min(low + 1, last))]))


def calibrated(mixture: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[float, float]:
    """The least share of an area, and the least density of subject terms, learned from all labelled documents.

    The share agrees best (F1) with the labels; the density is three quarters of what nearly all labelled documents have.
    Pairs are counted where they are: the driver has their numbers by steps of the share.
    """
    names = areas.where("nivel = 'area'").select("area_id").distinct()
    truth = labels.where("conv_id is not null").join(F.broadcast(names), "area_id", "left_semi")
    truth = reliable(truth.groupBy("conv_id").agg(F.collect_set(F.col("area_id").cast("bigint")).alias("certas")))
    docs, true = truth.agg(F.count("*"), F.sum(F.size("certas"))).first()
    if not docs:
        return 0.2, 0.03
    met = mixture.join(F.broadcast(truth) if docs <= BROADCAST_DOCS else truth, "conv_id")
    right = F.max(F.array_contains("certas", F.col("area_id")).cast("int"))
    pairs = reliable(met.groupBy("conv_id", "area_id").agg(F.max("parte").alias("parte"), F.min("densidade").alias("densidade"), right.alias("certo")))
    shares = [float(x) for x in np.arange(0.08, 0.36, 0.01)]
    step = sum(((F.col("parte") >= x).cast("int") for x in shares), F.lit(0))
    steps = pairs.groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.sum("certo").alias("certos")).collect()
    if not steps:
        return 0.2, 0.03
    best = (-1.0, 0.2)
    for i, share in enumerate(shares):
        said, both = (sum(r[c] for r in steps if r["k"] > i) for c in ("n", "certos"))
        best = max(best, (2 * both / max(1, said + true) - abs(share - 0.2) * 0.01, share))
    return best[1], _quantile(pairs.groupBy("conv_id").agg(F.min("densidade").alias("v")), 0.02) * 0.75


def subjects(df: DataFrame, records: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """conv_id, area_id: the one or two areas each document is about, largest share first taken."""
    mixture = reliable(subject_mixtures(df, records, areas))
    share, least = calibrated(mixture, labels, areas)
    top = Window.partitionBy("conv_id").orderBy(F.desc("parte"), "area_id")
    return mixture.where((F.col("parte") >= share) & (F.col("densidade") >= least)).withColumn("k", F.row_number().over(top)).where("k <= 2").select("conv_id", "area_id")
