"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to `order` bytes. In a context seen `n` times with `d` different next
bytes, a next byte seen c times costs -log2(c / (n + d)) bits and an escape to the next shorter context
-log2(d / (n + d)) (method C, without exclusion, frozen statistics); a context that was never seen escapes for nothing,
and below the empty context every byte costs 8 bits. The exact code length of a whole text under each language decides.

The trees of all languages share one set of nodes. Node numbers of all positions come from `order + 1` table look-ups
(node of the gram ending one byte earlier, next byte), so numpy scores whole batches of texts without a loop over bytes.

Training reads a sample whose bound is documented: per language rows of small hash, at most `train_docs` and `train_bytes`
(whole texts). Everything else covers all rows.

Cases: a null text and one without any letter are `und` with score 0; ties go to the language that sorts first; with no
training rows every text is `und`; repeated rows each give a row; a very long text is scored whole, as a batch of its own; empty
tables give no rows; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_arrow, smallest_by_hash, utf8

UND = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


class PPM:
    """Frozen context trees of several languages. next_node[k]: (node of a k-gram) * symbols + symbol -> node of the
    (k+1)-gram, 0 if no language has it. cost[k][node]: bits of the last byte of a (k+1)-gram coded from its k bytes of
    context, escapes below included. escape[k][node]: bits to leave the context that is this k-gram."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3):
        self.langs, self.order = sorted(samples), order
        if not samples:
            return
        texts = [b"".join(b"\n" + t for t in samples[x]) for x in self.langs]
        seen = np.zeros(256, bool)
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that no sample has
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        a, n = int(seen.sum()) + 1, len(self.langs)
        grams = [self.symbol[np.frombuffer(t, np.uint8)] for t in texts]
        self.next_node, self.cost, self.escape, self.a = [], [], [], a
        nodes, counts = [np.ones(len(g), np.int32) for g in grams], np.array([[len(g) for g in grams]] * 2, float)
        lower = np.full((a, n), 8.0)  # bits of each symbol below the empty context
        below = None
        for k in range(order + 1):  # grams of k + 1 bytes, their contexts of k bytes
            keys = [p[: len(g) - k].astype(np.int64) * a + g[k:] for p, g in zip(nodes, grams)]
            uniq = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            table = np.zeros((len(counts)) * a, np.int32)
            table[uniq] = np.arange(1, len(uniq) + 1)
            c = np.stack([np.bincount(table[x], minlength=len(uniq) + 1) for x in keys], 1).astype(float)
            context, sym = uniq // a, uniq % a
            total, kinds = np.zeros((len(counts), n)), np.zeros((len(counts), n))
            np.add.at(total, context, c[1:])
            np.add.at(kinds, context, c[1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                if k == 0:
                    short = lower[sym]
                else:
                    short = self.cost[k - 1][below(context, sym)]
                cost = np.where(c[1:] > 0, -np.log2(c[1:] / (total + kinds)[context]), leave[context] + short)
            self.next_node.append(table)
            self.cost.append(np.concatenate([np.zeros((1, n)), cost]).astype(np.float64))
            self.escape.append(leave.astype(np.float64))
            # the (k+1)-gram that ends a (k+2)-gram: suffix of the gram's node, then the next symbol
            suffix = np.zeros(len(uniq) + 1, np.int32)
            if k:
                suffix[1:] = below(context, sym)
            else:
                suffix[1:] = 1
            below = (lambda s, t: lambda ctx, sy: t[s[ctx].astype(np.int64) * a + sy])(suffix, table)
            nodes = [table[x] for x in keys]
            counts = c

    def code_lengths(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; ends: n + 1 offsets into raw. The context never crosses texts."""
        bits = np.zeros((len(ends) - 1, len(self.langs)))
        if not len(raw):
            return bits
        start = np.repeat(ends[:-1], np.diff(ends))
        left = np.minimum(np.arange(len(raw)) - start, self.order).astype(np.int8)  # bytes of context
        sym, node = self.symbol[raw], np.ones(len(raw), np.int32)
        context, grams = [node], []
        for k, table in enumerate(self.next_node):
            g = table[context[k] * np.int64(self.a) + sym]
            grams.append(g)
            if k < self.order:
                c = np.empty_like(g)
                c[0], c[1:] = 0, g[:-1]
                c[left < k + 1] = 0
                context.append(c)
        total = np.zeros((len(raw), len(self.langs)), np.float32)
        todo = np.arange(len(raw))
        for k in range(self.order, -1, -1):
            g = grams[k][todo]
            hit = g > 0
            total[todo[hit]] += self.cost[k][g[hit]].astype(np.float32)
            todo = todo[~hit]
            if not len(todo):
                break
            total[todo] += self.escape[k][context[k][todo]].astype(np.float32)
        total[todo] += 8.0
        full = np.diff(ends) > 0
        bits[full] = np.add.reduceat(total, ends[:-1][full], axis=0, dtype=np.float64)
        return bits


def train(docs: DataFrame, order: int = 3, train_docs: int = 400, train_bytes: int = 1_500_000, text_col: str = "text", lang_col: str = "lang") -> PPM:
    """Fit on the bounded sample of rows: at most train_docs and train_bytes a language, the first of them in any case."""
    learn = ~held_out() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.filter(learn).select("doc_id", F.col(lang_col).alias("lang"), F.octet_length(text_col).alias("size"), F.xxhash64("doc_id").alias("h"), F.col(text_col).alias("text"))
    picked = smallest_by_hash(rows, "lang", train_docs)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") + F.col("size") <= train_bytes) | (F.col("rank") == 1))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(picked.select("lang", "doc_id", "text").collect(), key=lambda r: (r.lang, r.doc_id is not None, r.doc_id, r.text)):
        texts.setdefault(r.lang, []).append(r.text.encode())
    return PPM(texts, order)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predicted(m: PPM, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text."""
    raw, ends = utf8(column)
    n, langs = np.diff(ends), np.array([*m.langs, UND])
    letters = np.array([t is not None and has_letter(t) for t in column.to_pylist()], bool)
    if m.langs:
        bits = m.code_lengths(raw, ends)
        best = bits.argmin(1)
        least = bits[np.arange(len(best)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        per = least / np.maximum(n, 1)
    else:
        best, score, per, letters = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n)), letters & False
    return langs[np.where(letters, best, len(langs) - 1)], np.where(letters, score, 0.0), per


def predict(docs: DataFrame, model: PPM, text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the prediction under equal priors), bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches_by_bytes(batches, "text", batch_bytes):
            lang, score, per = _predicted(shared.value, batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(per)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text_col).alias("text")), run, SCHEMA)


def keep_known(docs: DataFrame, model: PPM, text_col: str = "text", batch_bytes: int = 1 << 18) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted language is not und."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches_by_bytes(batches, text_col, batch_bytes):
            lang, _, _ = _predicted(shared.value, batch.column(at))
            yield batch.filter(pa.array(lang != UND, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
