"""Suffix-array dedup: bytes of later copies go, the first copy stays.

In each shard a suffix array orders the suffixes of the pieces that share anchors (prefix doubling from packed words of
eight bytes). For each suffix the previous and the next one in that order that belong to a smaller document are found, and the
longer of the common prefixes with both is its entry in the array of longest previous factors: the longest match that
starts in an earlier document. A window of `width` bytes is covered where that factor reaches `width`. The factors are
whole within their pieces; a longer match goes on in the next pieces.
Everything before the shards (who may match whom) is in earlier_windows.py.

Cases: null counts as empty; texts of fewer than `width` bytes keep all; rows that repeat a doc_id are not earlier than
each other, and each row is cut by its own text; a null doc_id counts as the smallest; empty tables give no rows; further
columns are ignored. Kept bytes need not be valid UTF-8, so keep_text() replaces broken characters."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_arrow, utf8
from .earlier_windows import covered_spans, keyed, spans_of, with_spans


#: Ends a piece: no text has this byte, since it does not occur in UTF-8.
END = 0xFF


def suffix_ranks(text: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The eight bytes from each place on as one number, and (size, ranks of the `size` bytes from each place on) from
    8 bytes by doubling up to more than `longest`. Ends are padded by END."""
    padded = np.concatenate([text, np.full(8, END, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(text)]
    ranks, size, key = [], 8, words
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        ranks.append((size, rank))
        if size > longest:
            return words, ranks
        nxt = np.concatenate([rank[size:], np.full(min(size, len(rank)), rank.max() + 1)])
        key, size = rank * (rank.max() + 2) + nxt, 2 * size


def common_prefix(words: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common (less than twice the largest size)."""
    n, size = len(words), np.zeros(len(a), np.int64)
    for step, rank in reversed(ranks):
        x, y = a + size, b + size
        on = (x < n) & (y < n)
        on[on] = rank[x[on]] == rank[y[on]]
        size[on] += step
    x, y = np.minimum(a + size, n - 1), np.minimum(b + size, n - 1)
    differ = words[x] ^ words[y]
    for i in range(1, 8):  # equal bytes before the first that differs
        size += differ < np.uint64(1) << np.uint64(64 - 8 * i)
    return size


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For the suffixes at `starts` (left: bytes to the end of their piece, doc: their document): the longest common prefix
    with one of them of a smaller document."""
    words, ranks = suffix_ranks(text, int(left.max(initial=0)))
    order = np.argsort(ranks[-1][1][starts], kind="stable")
    at, rest, docs = starts[order], left[order], doc[order]
    factor = np.zeros(len(order), np.int64)
    before, after = smaller_before(docs), len(order) - 1 - smaller_before(docs[::-1])[::-1]
    for other, some in ((before, before >= 0), (after, after < len(order))):
        i, j = np.flatnonzero(some), other[some]
        factor[i] = np.maximum(factor[i], np.minimum(common_prefix(words, ranks, at[i], at[j]), np.minimum(rest[i], rest[j])))
    out = np.empty(len(order), np.int64)
    out[order] = factor
    return out


def earlier_by_suffixes(text: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each window of the pieces whether its longest previous factor reaches the width."""
    off = np.cumsum(size + 1) - size - 1  # each piece and its end mark
    local = np.full(int((size + 1).sum()), END, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    local[np.repeat(off, size) + within] = text[np.repeat(first, size) + within]
    n = size - width + 1
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return longest_previous_factors(local, np.repeat(off, n) + number, np.repeat(size, n) - number, np.repeat(doc, n)) >= width


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller entry before each one, -1 if none; pointers jump along found answers."""
    n = len(values)
    out = np.arange(-1, n - 1)
    todo = np.flatnonzero((out >= 0) & (values[np.maximum(out, 0)] >= values))
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[(out[todo] >= 0) & (values[np.maximum(out[todo], 0)] >= values[todo])]
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets)."""
    rows, ids = keyed(docs, F.coalesce(F.col(text_col), F.lit("")), id_col)
    spans = covered_spans(rows, ids, earlier_by_suffixes, width, "bytes", k=20)

    def apply(batches):
        for batch in batches_by_bytes(batches, "text", 1 << 20):
            raw, ends = utf8(batch.column(1))
            out = []
            for i, blob in enumerate(batch.column(2).to_pylist()):
                text = raw[ends[i] : ends[i + 1]]
                pairs = spans_of(blob, len(text)) if len(text) >= width else np.zeros((0, 2), np.int64)
                digest, at = hashlib.sha256(), 0
                for a, b in pairs.tolist():
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((len(text), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), digest.hexdigest(), [{"start": a, "stop": b} for a, b in pairs.tolist()]))
            cols = list(zip(*out))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return map_arrow(with_spans(rows.select("doc_id", "key", "text"), spans).select("doc_id", "text", "spans"), apply, SCHEMA)


def keep_text(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of remove_repeats cut out of the text (one row per doc_id in both)."""

    def apply(batches):
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, at, kept = (text or "").encode(), 0, b""
                for p in pairs or []:
                    kept, at = kept + raw[at : p["start"]], p["stop"]
                out.append((kept + raw[at:]).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=[id_col, text_col])

    return map_arrow(docs.select(id_col, text_col).join(spans.select(F.col("doc_id").alias(id_col), "spans"), id_col), apply, f"{id_col} long, {text_col} string")
