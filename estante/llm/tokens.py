"""Encoding of a corpus with a public byte-level BPE tokenizer, by monoid tree reduction.

A text is cut in halves until the pieces are leaves, leaves are encoded, and two
neighbours are joined by encoding only a window around their seam again.  The
pre-tokenizer never puts a character that is no white space and the white space
after it into one piece, and has no look-behind: such a place is a token boundary
whatever stands left or right of it.  The window therefore grows, doubling, until
it reaches such a place on both sides (or the end of the half); the tokens outside
are then the tokens of the whole text.  The operation is associative, and the
empty text is its neutral element.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 1024
WINDOW_CHARS = 32

_SEAM = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \n])")


class TreeEncoder:
    """Encodes texts with a rank file of byte-level BPE."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self._encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = {i: token for token, i in ranks.items()}
        self._len = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self._len[i] = len(token)
        self.leaf_chars = max(2, leaf_chars)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self._encode(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of left + right from the ids of both."""
        i, j, width = 0, len(right), WINDOW_CHARS
        while width < len(left):
            if found := [m.end() for m in _SEAM.finditer(left[-width:])]:
                i = len(left) - width + found[-1]
                break
            width *= 2
        width = WINDOW_CHARS
        while width < len(right):
            if found := _SEAM.search(right[: width + 1]):
                j = found.end()
                break
            width *= 2
        keep_left, rest = len(left_ids), len(left[i:].encode())
        while rest > 0:
            keep_left -= 1
            rest -= self._len[left_ids[keep_left]]
        drop_right, rest = 0, len(right[:j].encode())
        while rest > 0:
            rest -= self._len[right_ids[drop_right]]
            drop_right += 1
        return left_ids[:keep_left] + self._encode(left[i:] + right[:j]) + right_ids[drop_right:]

    def decode(self, ids: list[int]) -> str:
        """Concatenation of the tokens' bytes."""
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str | None = None, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder per worker process. path: the rank file; None means the installed public one."""
    import public_tokenizers

    return TreeEncoder(path or public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, leaf_chars)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """key, ids: one row for every row of df.

    Null and empty texts have the empty list.  Repeated rows stay repeated; other
    columns of df are not read.  Texts of any length are encoded whole.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf_chars)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch.column(1).to_pylist():
                flat.extend(enc.encode(value))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keys, n_tokens bigint: the size of each row in tokens; 0 for null and empty texts."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = pa.array([len(enc.encode(x)) for x in batch.column(len(keys)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], sizes], names=[*keys, "n_tokens"])

    return df.select(*keys, F.col(text)).mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, intact: whether decoding the ids gives the text back (null counts as empty)."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [enc.encode(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([enc.decode(i) == (t or "") for i, t in zip(ids, texts)])],
                names=[key, "n_tokens", "intact"],
            )

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
