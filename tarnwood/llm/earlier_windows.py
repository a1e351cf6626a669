"""Spans of documents covered by windows that also start in a document with a smaller id (see windows.py).

1. Exact copies are found by digest; all but the one of least id are covered whole and go no further.
2. Anchors of all other documents: (hash, document, place). Hashes of two or more documents are kept (counts are summed
   before the shuffle) and joined back, which gives each document the places of its repeated anchors.
3. Only the pieces of text at these places are cut out; equal pieces are combined to one with the least document.
4. Pieces that share an anchor meet in one shard. The operator's index tells for each window of each piece whether its content
   also starts in a document smaller than the piece's least one. An anchor with one piece needs no comparison.
5. These answers are joined to all documents that hold the piece: in its least document the windows that were told are
   covered, in any other document all windows are.

Sizes: a hot passage is one piece with a count, not a list; joins on hashes are shuffled joins that Spark may split where a
key is hot; per-document lists are bounded by the document. A shard keeps the different pieces of one anchor in memory. Very long texts are
cut into pieces like any others; memory for one text grows with its length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_arrow, small_side, stage, unstage, utf8
from .windows import BYTE, pieces, word_symbols

_NO_ID = -(2**63)
#: Symbols of different pieces that one index is built over.
CHUNK = {"bytes": 1 << 19, "words": 1 << 17}
#: Low bits of a place that hold its number of windows.
_COUNT = 24

#: (symbols, starts, sizes, documents, width) -> per window in order of pieces: does it start in a smaller document, too?
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _symbols(raw, ends, unit):
    """Hashes, offsets in symbols, byte start and stop of each symbol."""
    if unit == "bytes":
        at = np.arange(len(raw))
        return BYTE[raw], ends, at, at + 1
    return word_symbols(raw, ends)


def keyed(docs: DataFrame, text: Column, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, doc: null as least, key, text) and their digests (doc, key, sha). key is doc, or a hash of doc and
    text if some doc_id stands for two texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), text.alias("text"))
    ids = stage(rows.select("doc", F.sha2("text", 256).alias("sha")), "digests")
    twice = ids.groupBy("doc").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a < b")
    if twice.isEmpty():
        return rows.withColumn("key", F.col("doc")), ids.withColumn("key", F.col("doc"))
    return rows.withColumn("key", F.xxhash64("doc", F.sha2("text", 256))), ids.withColumn("key", F.xxhash64("doc", "sha"))


def covered_spans(rows: DataFrame, ids: DataFrame, index: Index, width: int = 50, unit: str = "bytes", k: int = 20) -> DataFrame:
    """rows and ids as keyed() gives them. Returns (key, spans): merged, disjoint spans of symbols in order as pairs of int32 in a binary."""
    if not k <= width < 1 << _COUNT:
        raise ValueError(f"width must be from {k} to {(1 << _COUNT) - 1}")
    spark = rows.sparkSession
    least = ids.groupBy("sha").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "least")
    copies = small_side(ids.join(least, "sha").filter("doc > least").select("key").distinct(), "copies")
    single = rows.join(copies, "key", "left_anti").select("doc", "key", "text")  # a repeated row is cut twice, alike

    def anchors(batches):
        for batch in batches_by_bytes(batches, "text", 1 << 19):
            raw, ends = utf8(batch.column(2))
            sym, ends, _, _ = _symbols(raw, ends, unit)
            row, first, count, h, _ = pieces(sym, ends, width, k)
            ids, at = pa.array(row), (first - ends[row]).astype(np.int32)
            yield pa.record_batch([pa.array(h.view(np.int64)), batch.column(0).take(ids), batch.column(1).take(ids), pa.array(at), pa.array(count.astype(np.int32))], names=["h", "doc", "key", "first", "n"])

    found = stage(map_arrow(single, anchors, "h long, doc long, key long, first int, n int"), "anchors")
    # staged by itself: its shuffle files go before the join needs room, and Spark can split the join where a hash is hot
    again = stage(found.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h"), "again")
    at = F.shiftleft(F.col("first").cast("long"), _COUNT).bitwiseOR(F.col("n").cast("long")).alias("at")
    places = stage(found.select("h", "key", at).join(again.hint("shuffle_hash"), "h").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("places")), "places")
    unstage(found)
    unstage(again)

    def cut(batches):
        for batch in batches_by_bytes(batches, "text", 1 << 19):
            raw, ends = utf8(batch.column(2))
            _, soff, start, stop = _symbols(raw, ends, unit)
            lists = batch.column(3)
            flat = lists.flatten()
            n = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(batch.num_rows), n)
            at = np.asarray(flat.field(0))
            first, count = at >> _COUNT, at & ((1 << _COUNT) - 1)
            a = start[soff[row] + first]
            b = stop[soff[row] + first + count + width - 2]
            size = b - a
            off = np.concatenate([[0], np.cumsum(size)])
            data = raw[np.repeat(a - off[:-1], size) + np.arange(off[-1])]
            content = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            ids = pa.array(row)
            yield pa.record_batch([flat.field(1), batch.column(0).take(ids), batch.column(1).take(ids), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), content], names=["h", "doc", "key", "first", "n", "content"])

    text = single.join(places, "key").select("doc", "key", "text", "places")
    parts = stage(map_arrow(text, cut, "h long, doc long, key long, first int, n int, content binary").withColumn("sig", F.xxhash64("content")), "pieces")
    unique = parts.groupBy("h", "sig", "content").agg(F.min("doc").alias("doc"))

    def shard(batches):
        held, total = [], 0
        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            if total >= 1 << 15:  # what may continue in the next batch stays
                table = pa.Table.from_batches(held).combine_chunks()
                h = np.asarray(table.column("h"))
                cut_at = int(np.searchsorted(h, h[-1]))
                if cut_at:
                    yield from _answers(table.slice(0, cut_at), index, width, unit)
                    held, total = table.slice(cut_at).to_batches(), table.num_rows - cut_at
        if held:
            yield from _answers(pa.Table.from_batches(held).combine_chunks(), index, width, unit)

    shards = unique.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "doc", "sig")
    answers = stage(map_arrow(shards, shard, "h long, sig long, least long, runs array<struct<a:int,b:int>>"), "answers")
    hit = parts.select("h", "sig", "doc", "key", "first", "n").join(answers.hint("shuffle_hash"), ["h", "sig"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    hit = hit.select("key", "first", F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("runs")).alias("runs")).filter("size(runs) > 0")
    spans = hit.select("key", F.explode("runs").alias("r"), "first").select("key", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") + (width - 1)).alias("b")).alias("s"))
    lists = spans.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("s"))
    # all windows of an exact copy start in the document of least id; the end is past any text
    whole = copies.select("key", F.expr("unhex('00000000FFFFFF7F')").alias("spans"))
    return stage(map_arrow(lists, _merged, "key long, spans binary").unionByName(whole), "spans")


def _answers(table: pa.Table, index: Index, width: int, unit: str):
    """Runs of windows that start in a smaller document, too, per piece; pieces of one anchor stand together."""
    h, doc = np.asarray(table.column("h")), np.asarray(table.column("doc"))
    head = np.flatnonzero(np.diff(h, prepend=h[0] ^ 1))
    alone = np.repeat(np.diff(np.append(head, len(h))) == 1, np.diff(np.append(head, len(h))))
    content = table.column("content").combine_chunks().cast(pa.large_binary())
    raw, ends = utf8(content.view(pa.large_string()))
    sym = raw
    if unit == "words":
        sym, ends, _, _ = word_symbols(raw, ends)
    size = np.diff(ends)
    windows = size - width + 1
    n_before = np.concatenate([[0], np.cumsum(windows)])
    found = np.zeros(int(n_before[-1]), bool)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    many = np.flatnonzero(~alone)
    chunk = np.cumsum(size[many]) // CHUNK[unit]
    chunk = np.maximum.accumulate(chunk[np.searchsorted(group[many], group[many])]) if len(many) else chunk  # an anchor is not divided
    for c in np.unique(chunk):
        rows = many[chunk == c]
        got = index(sym, ends[rows], size[rows], doc[rows], width)
        found[np.repeat(n_before[rows] - np.concatenate([[0], np.cumsum(windows[rows])[:-1]]), windows[rows]) + np.arange(windows[rows].sum())] = got
    piece = np.repeat(np.arange(len(h)), windows)
    cut = np.flatnonzero((np.diff(piece, prepend=-1) != 0) | (np.diff(found.astype(np.int8), prepend=-1) != 0))
    stop = np.append(cut[1:], len(piece))
    cut, stop = cut[found[cut]], stop[found[cut]]
    base = n_before[piece[cut]]
    runs = pa.StructArray.from_arrays([pa.array((cut - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))], names=["a", "b"])
    offsets = np.searchsorted(piece[cut], np.arange(len(h) + 1))
    cols = [pa.array(h), table.column("sig").combine_chunks(), pa.array(doc), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)]
    yield from pa.table(cols, names=["h", "sig", "least", "runs"]).to_batches(max_chunksize=1 << 14)


def _merged(batches):
    """Overlapping and touching spans become one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        flat, n = lists.flatten(), np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(n)), n)
        a, b = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
        step = np.int64(1) << 32
        a, b = a + row * step, b + row * step
        reach = np.maximum.accumulate(b)
        new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
        last = np.append(new[1:], len(a)) - 1
        pairs = np.stack([a[new] - row[new] * step, reach[last] - row[new] * step], 1).astype("<i4")
        count = np.bincount(row[new], minlength=len(n))
        off = np.concatenate([[0], np.cumsum(count * 8)]).astype(np.int32)
        yield pa.record_batch([batch.column(0), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(pairs.tobytes())])], names=["key", "spans"])


def spans_of(blob: bytes | None, size: int) -> np.ndarray:
    """Pairs clipped to the text."""
    if not blob:
        return np.zeros((0, 2), np.int64)
    return np.minimum(np.frombuffer(blob, "<i4").reshape(-1, 2).astype(np.int64), size)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Left join by key, shuffled at every size."""
    return rows.join(spans.hint("merge"), "key", "left")
