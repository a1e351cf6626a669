"""Substring dedup: a compressed FM-index per shard tells which windows of words start in an earlier document.

A shard's pieces (earlier_windows.py) are joined with end marks, their words numbered, and the suffix array's last column
is kept in a wavelet matrix of packed bits with counts per 64 bits. The documents' pieces are streamed against it, from each
word to the left: each step narrows an interval of the suffix order by two ranks per level of the matrix, and the search of a
word goes on while some suffix of the interval belongs to a smaller document (a range minimum over the suffixes' documents).
So matching_statistics() gives, for each word of a document, the length of the longest match that ends there and also stands
in an earlier document, up to the threshold; intervals of `width` words that reach it are reported.

Cases: null has no words; documents of fewer than `width` words keep all; words are runs of characters other than
[\\x20\\x09-\\x0D], compared by 64-bit hashes of their bytes; rows that repeat a doc_id are not earlier than each other, and
each row is cut by its own text; a null doc_id counts as the smallest; very long texts are cut into pieces like any others;
empty tables give no rows; further columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batches_by_bytes, map_arrow, utf8
from .earlier_windows import covered_spans, keyed, spans_of, with_spans
from .windows import word_symbols


class Wavelet:
    """Rank queries over a sequence of small integers: rank(c, i) counts c among the first i."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.leaf = np.searchsorted(_reversed_bits(values, self.levels), _reversed_bits(np.arange(1 << self.levels), self.levels))

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d in range(self.levels):
            word = i >> 6
            ones = self.counts[d][word] + np.bitwise_count(self.words[d][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> (self.levels - 1 - d)) & 1, self.zeros[d] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.descend(c, i) - self.leaf[c]


def _reversed_bits(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(n):
        out |= ((x >> i) & 1) << (n - 1 - i)
    return out


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; the last symbol must be unique and least."""
    n = len(ranks)
    rank, size = ranks.astype(np.int64), 1
    while True:
        nxt = np.concatenate([rank[size:] + 1, np.zeros(min(size, n), np.int64)])
        key = rank * np.int64(n + 2) + nxt
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        size *= 2
        if rank.max() == n - 1 or size > 2 * n:
            return order


class FMIndex:
    """text: small integers from 2; 1 ends a piece, 0 ends the text. owner: the document of each place of the text."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        order = suffix_array(text)
        self.n, top = len(text), int(text.max())
        self.wavelet = Wavelet(text[order - 1], top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.docs, ranks = np.unique(owner, return_inverse=True)
        self.least = [ranks[order].astype(np.int32)]  # least[i][j]: least document of 2**i suffixes from j on
        while 2 << (len(self.least) - 1) <= self.n:
            x, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(x[:-half], x[half:]))

    def step(self, c, lo, hi):
        return self.less[c] + self.wavelet.rank(c, lo), self.less[c] + self.wavelet.rank(c, hi)

    def least_document(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rank of the least document among the suffixes of each interval (none is empty)."""
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int32)
        for i in np.unique(level):
            on = level == i
            out[on] = np.minimum(self.least[i][lo[on]], self.least[i][hi[on] - (1 << i)])
        return out

    def matching_statistics(self, pattern: np.ndarray, stops: np.ndarray, limit: int, doc: np.ndarray) -> np.ndarray:
        """For each stop in a document `doc`: how many symbols before it occur in a row in a smaller document (at most limit)."""
        lo, hi, length = np.zeros(len(stops), np.int64), np.full(len(stops), self.n, np.int64), np.zeros(len(stops), np.int64)
        before = np.searchsorted(self.docs, doc)
        on = np.arange(len(stops))
        for d in range(1, limit + 1):
            on = on[stops[on] >= d]
            on = on[pattern[stops[on] - d] > 1]  # an end mark ends a match
            a, b = self.step(pattern[stops[on] - d], lo[on], hi[on])
            some = a < b
            some[some] = self.least_document(a[some], b[some]) < before[on[some]]
            on = on[some]
            if not len(on):
                break
            lo[on], hi[on], length[on] = a[some], b[some], d
        return length


def earlier_by_index(sym: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each window of the pieces whether the matching statistics at its end reach the width."""
    total = int(size.sum())
    off = np.cumsum(size) - size
    _, ranks = np.unique(sym[np.repeat(first - off, size) + np.arange(total)], return_inverse=True)
    shifted = np.arange(total) + np.repeat(np.arange(len(size)), size)  # one end mark after each piece
    text = np.ones(total + len(size) + 1, np.int64)
    text[shifted] = ranks + 2
    text[-1] = 0
    index = FMIndex(text, np.append(np.repeat(doc, size + 1), np.iinfo(np.int64).max))
    n = size - width + 1
    starts = np.repeat(off + np.arange(len(size)) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return index.matching_statistics(text, starts + width, width, np.repeat(doc, n)) >= width


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space, spans (word numbers)."""
    text = F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "), F.lit(" "))
    rows, ids = keyed(docs, text, id_col)
    spans = covered_spans(rows, ids, earlier_by_index, width, "words", k=20)

    def apply(batches):
        for batch in batches_by_bytes(batches, "text", 1 << 20):
            raw, ends = utf8(batch.column(1))
            _, words, start, stop = word_symbols(raw, ends)
            out = []
            for i, blob in enumerate(batch.column(2).to_pylist()):
                a, b = int(words[i]), int(words[i + 1])
                pairs = spans_of(blob, b - a) if b - a >= width else np.zeros((0, 2), np.int64)
                digest, at, some = hashlib.sha256(), a, False
                for x, y in [*(pairs + a).tolist(), (b, b)]:
                    if x > at:  # kept words lie together, one space between two
                        digest.update((b" " if some else b"") + raw[start[at] : stop[x - 1]].tobytes())
                        some = True
                    at = max(at, y)
                out.append((b - a, int((pairs[:, 1] - pairs[:, 0]).sum()), digest.hexdigest(), [{"start": x, "stop": y} for x, y in pairs.tolist()]))
            cols = list(zip(*out))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string()), pa.array(cols[3], kind)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return map_arrow(with_spans(rows.select("doc_id", "key", "text"), spans).select("doc_id", "text", "spans"), apply, SCHEMA)
