"""One consistent form for text that looks the same but is made of other characters.

Arrow strings are copied to one numpy array of code points per batch.  Lookup
tables give each code point a class and a replacement of zero, one or more code
points; expansion offsets place the replacements; combining marks are composed by a
search in a sorted table of (base, mark) pairs.  No string call is made per row.

Greek and Cyrillic letters are replaced only in words that hold a Latin letter
or consist of look-alikes alone, so words really written in another script stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 0x110000
# Letters of the Greek and Cyrillic scripts and the Latin letters they look like.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυϲϳ", "ABEZHIKMNOPTYXaiKvopucj")) | {"κ": "k", "ɑ": "a"}
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХӀҮԚԜаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXIYQWaesijopcyxhdqw")) | {"ӏ": "l", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
LATIN_ODD = {"ı": "i", "ſ": "s", "ꞌ": "'", "ⅼ": "l"}
#: Kept as they are although a compatibility decomposition exists.
ORDINARY = "ªº¹²³⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉™℠…№¼½¾µ€´¨¯¸·"
PLAIN, ZERO, SPACE, WIDE, MARK, OTHER = 0, 1, 2, 3, 4, 5
LATIN_LETTER, OTHER_LETTER = 1, 2


class Tables:
    """Class, replacement and script of every code point, built from the Unicode data by rule."""

    def __init__(self) -> None:
        self.kind = np.zeros(TOP, np.uint8)
        self.script = np.zeros(TOP, np.uint8)
        self.twin = np.zeros(TOP, np.int32)
        expand: dict[int, str] = {}
        for cp in range(0x80, TOP):
            if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xF900 or 0x10000 <= cp < 0x1D400 or 0x20000 <= cp < 0xE0000 or cp >= 0xE1000:
                continue
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x2800):
                self.kind[cp] = ZERO
                expand[cp] = ""
            elif cat in ("Zs", "Zl", "Zp"):
                self.kind[cp] = SPACE
                expand[cp] = " "
            elif cat == "Mn" and (0x0300 <= cp <= 0x036F or 0x1AB0 <= cp <= 0x1AFF or 0x1DC0 <= cp <= 0x1DFF or 0x20D0 <= cp <= 0x20FF):
                self.kind[cp] = MARK
            elif cat[0] in "LNPS":
                flat = unicodedata.decomposition(c)
                if flat.startswith("<") and c not in ORDINARY and flat.split(">")[0][1:] in ("wide", "narrow", "compat", "font", "circle", "square"):
                    if flat.startswith(("<wide", "<narrow", "<font")) or 0xFB00 <= cp <= 0xFB06 or 0x2000 <= cp <= 0x206F and cp not in (0x2033, 0x2034) or 0x2160 <= cp <= 0x217F or 0x132 <= cp <= 0x149 or 0x1C4 <= cp <= 0x1F3:
                        self.kind[cp] = WIDE
                        expand[cp] = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c))
                elif flat and not flat.startswith("<") and " " not in flat:
                    # A singleton decomposition: the ångström sign and its like.
                    self.kind[cp] = OTHER
                    expand[cp] = unicodedata.normalize("NFC", c)
            name = unicodedata.name(c, "")
            if cat[0] == "L":
                if name.startswith("LATIN") or "FULLWIDTH LATIN" in name:
                    self.script[cp] = LATIN_LETTER
                elif name.startswith(("GREEK", "CYRILLIC", "CHEROKEE", "ARMENIAN")):
                    self.script[cp] = OTHER_LETTER
        self.script[[*range(65, 91), *range(97, 123)]] = LATIN_LETTER
        for c, o in LATIN_ODD.items():
            self.kind[ord(c)], expand[ord(c)] = OTHER, o
        for cp in (0x00, *range(0x01, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F):
            self.kind[cp], expand[cp] = ZERO, ""
        for twins in (GREEK, CYRILLIC):
            for c, o in twins.items():
                self.twin[ord(c)] = ord(o)
        # Precomposed Greek letters whose base looks Latin stay letters of their script only.
        self.length = np.ones(TOP, np.uint8)
        self.offset = np.zeros(TOP, np.int32)
        pool: list[int] = []
        for cp, text in expand.items():
            self.length[cp], self.offset[cp] = len(text), len(pool)
            pool += map(ord, text)
        self.pool = np.array(pool or [0], np.int32)
        self.replaced = np.zeros(TOP, bool)
        self.replaced[list(expand)] = True
        # Primary composites, from the Unicode data.
        pairs = {}
        for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
            parts = unicodedata.decomposition(chr(cp)).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(int(parts[0], 16)) + chr(int(parts[1], 16))) == chr(cp):
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
        # Canonical order of marks, and the full decompositions of the composites.
        self.rank = np.zeros(TOP, np.uint8)
        for cp in np.flatnonzero(self.kind == MARK):
            self.rank[cp] = unicodedata.combining(chr(cp))
        self.parts = np.ones(TOP, np.uint8)
        self.apart = np.zeros(TOP, np.int32)
        single: list[int] = []
        for cp in pairs.values():
            flat = unicodedata.normalize("NFD", chr(cp))
            self.parts[cp], self.apart[cp] = len(flat), len(single)
            single += map(ord, flat)
        self.single = np.array(single or [0], np.int32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair, self.composed = keys, np.array([pairs[k] for k in keys], np.int32)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings in one array, and the end of each string; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    text = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(text, np.uint8)[offsets[0] : offsets[-1]] if text is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[offsets - offsets[0]]


def to_strings(points: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The inverse of code_points."""
    raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
    starts = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(starts[ends].astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())


def _words(points: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point, whether it is a look-alike to replace; words end where no letter, mark or invisible character stands."""
    script = t.script[points]
    inner = (script > 0) | (t.kind[points] == MARK) | (t.kind[points] == ZERO)
    edge = np.ones(len(points), bool)
    edge[1:] = (inner[1:] != inner[:-1]) | (row[1:] != row[:-1])
    word = np.cumsum(edge) - 1
    n = int(word[-1]) + 1 if len(word) else 0
    latin = np.bincount(word, script == LATIN_LETTER, n) > 0
    twin = t.twin[points]
    foreign = np.bincount(word, (script == OTHER_LETTER) & (twin == 0), n) > 0
    return (twin > 0) & (latin | ~foreign)[word], twin, word


def _hangul(out: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Syllables for a leading consonant and a vowel, then for these and a final consonant, by arithmetic."""
    for last in (False, True):
        first, second = out[:-1], out[1:]
        if last:
            joins = (first >= 0xAC00) & (first < 0xD7A4) & ((first - 0xAC00) % 28 == 0) & (second > 0x11A7) & (second < 0x11C3)
        else:
            joins = (first >= 0x1100) & (first < 0x1113) & (second >= 0x1161) & (second < 0x1176)
        at = np.flatnonzero(joins & (row[:-1] == row[1:]))
        if len(at):
            out[at] = out[at] + out[at + 1] - 0x11A7 if last else 0xAC00 + ((out[at] - 0x1100) * 21 + out[at + 1] - 0x1161) * 28
            keep = np.ones(len(out), bool)
            keep[at + 1] = False
            out, row = out[keep], row[keep]
    return out, row


def _composed(out: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, each joined with the character it belongs to where a composed one exists."""
    if len(out) < 2 or not len(t.pair):
        return out, row
    mark = t.kind[out] == MARK
    if not mark.any():
        return out, row
    # A composed letter before a mark is taken apart, for the mark may belong before its own.
    lone = np.ones(len(out), np.int64)
    before = np.flatnonzero(mark[1:] & (row[1:] == row[:-1]))
    lone[before] = t.parts[out[before]]
    start = np.cumsum(lone) - lone
    source = np.repeat(np.arange(len(out)), lone)
    within = np.arange(len(source)) - start[source]
    out, row = np.where(lone[source] > 1, t.single[np.minimum(t.apart[out[source]] + within, len(t.single) - 1)], out[source]), row[source]
    rank = np.where(t.kind[out] == MARK, t.rank[out], 0)
    head = rank == 0
    head[0] = True
    head[1:] |= row[1:] != row[:-1]
    group = np.cumsum(head) - 1
    order = np.lexsort((np.arange(len(out)), rank, group))
    out, rank = out[order], rank[order]
    base = np.flatnonzero(head)
    place = np.arange(len(out)) - base[group]
    keep, last = np.ones(len(out), bool), np.zeros(len(base), np.uint8)
    by_place = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    for k in range(1, len(ends)):
        at = by_place[ends[k - 1] : ends[k]]
        g = group[at]
        key = out[base[g]].astype(np.int64) << 21 | out[at]
        found = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        # A mark of the same rank between them keeps two apart.
        hit = (t.pair[found] == key) & (last[g] != rank[at])
        out[base[g[hit]]] = t.composed[found[hit]]
        keep[at[hit]] = False
        last[g[~hit]] = rank[at[~hit]]
    return out[keep], row[keep]


def normalise(column: pa.Array) -> pa.Array:
    """Strings in one consistent form; null stays null, and nothing but look-alikes changes."""
    t = tables()
    points, ends = code_points(column)
    count = len(ends) - 1
    if not len(points):
        return column.cast(pa.string())
    row = np.repeat(np.arange(count), np.diff(ends))
    alike, twin, _ = _words(points, row, t)
    # Expansion: each code point has a length; the start of its output is the sum of those before.
    length = t.length[points].astype(np.int64)
    start = np.cumsum(length) - length
    source = np.repeat(np.arange(len(points)), length)
    within = np.arange(len(source)) - start[source]
    cp = points[source]
    out = np.where(t.replaced[cp], t.pool[np.minimum(t.offset[cp] + within, len(t.pool) - 1)], np.where(alike[source], twin[source], cp))
    row = row[source]
    out, row = _composed(*_hangul(out, row), t)
    made = to_strings(out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=count))]).astype(np.int64))
    return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), made)


def suspects(column: pa.Array) -> np.ndarray:
    """For each string, whether it comes out otherwise; null does not."""
    return pc.fill_null(pc.not_equal(normalise(column), column), False).to_numpy(zero_copy_only=False)


#: Any character outside printable ASCII, the Latin letters of western Europe, ordinals, superscripts, quotes and dashes: without one, nothing is to be done.
MAYBE = "[^\\n\\r\\t -~ªº²³¹°§«»À-ÖØ-öø-ÿŒœŠšŽž‐-‛“-‟…€]"


def find_lookalikes(df: DataFrame, key: str = "registro_id") -> DataFrame:
    """key, campo: the rows whose titulo or an element of autores comes out of the normalisation otherwise.

    A key delivered more than once counts once per campo.  Null and empty values,
    null elements and empty lists are no cases; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    values = df.select(key, F.explode(F.concat(F.array(F.struct(F.lit("titulo").alias("campo"), F.col("titulo").alias("v"))), F.coalesce(F.transform("autores", lambda a: F.struct(F.lit("autores").alias("campo"), a.alias("v"))), F.array().cast("array<struct<campo:string,v:string>>")))).alias("x")).select(key, "x.campo", "x.v").where(F.col("v").rlike(MAYBE) & F.col(key).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(suspects(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=[key, "campo"])

    return values.mapInArrow(run, f"`{key}` {kind}, campo string").distinct()


def normalise_records(df: DataFrame, key: str = "registro_id") -> DataFrame:
    """key, titulo, autores in one consistent form: one row for every row of df, nulls kept."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(2)
            flat = normalise(names.flatten()) if len(names) else names.flatten()
            sizes = pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=names.is_null()) if len(names) else names
            yield pa.RecordBatch.from_arrays([batch.column(0), normalise(batch.column(1)), lists], names=[key, "titulo", "autores"])

    return df.select(key, "titulo", "autores").mapInArrow(run, f"`{key}` {kind}, titulo string, autores array<string>")
