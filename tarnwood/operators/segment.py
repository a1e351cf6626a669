"""Character HMM segmentation over B, M, E, S labels: training as counts, cutting by Viterbi in log space."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions.text import bmes

STATES = "BEMS"
#: Characters cut side by side.
_CHARS = 2_000_000


def train(lines: DataFrame, order: str = "line_no", text: str = "line", strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """start(s, p), trans(s1, s2, p), emit(s, ch, p) from lines of words with spaces between. strict: starts are divided by
    lines - 1 and the first character of a line is not counted among emissions."""
    labelled = lines.withColumn("w", F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")).filter("size(w) > 0")
    chars = labelled.select(order, F.array_join("w", "").alias("c"), F.array_join(F.transform("w", bmes), "").alias("t"))
    long = chars.select(order, F.posexplode(F.arrays_zip(F.split("c", "").alias("ch"), F.split("t", "").alias("s"))).alias("pos", "x")).select(order, "pos", F.col("x.ch").alias("ch"), F.col("x.s").alias("s"))
    n = chars.count() - (1 if strict else 0)
    state = long.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    start = long.filter("pos = 0").groupBy("s").agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("p"))
    pairs = long.withColumn("s1", F.lag("s").over(Window.partitionBy(order).orderBy("pos"))).filter("s1 is not null").groupBy("s1", F.col("s").alias("s2")).agg(F.count(F.lit(1)).alias("c"))
    trans = pairs.join(state.withColumnRenamed("s", "s1"), "s1").select("s1", "s2", (F.col("c") / F.col("n")).alias("p"))
    seen = long.filter("pos > 0") if strict else long
    emit = seen.groupBy("s", "ch").agg(F.count(F.lit(1)).alias("c")).join(state, "s").select("s", "ch", ((F.col("c") + 1) / F.col("n")).alias("p"))
    return start, trans, emit


def viterbi(text: str, start: dict, trans: dict, emit: dict) -> str:
    """Best labels; unseen characters emit with probability 1, ties go to the state that sorts first."""
    low = -1e30
    log = lambda p: math.log(p) if p else low
    e = lambda s, c: log(emit[s, c]) if (s, c) in emit else (low if any((x, c) in emit for x in STATES) else 0.0)
    score, back = {s: log(start.get(s, 0)) + e(s, text[0]) for s in STATES}, []
    for c in text[1:]:
        prev, score, step = score, {}, {}
        for s in STATES:
            best = max(STATES, key=lambda r: (prev[r] + log(trans.get((r, s), 0)), -ord(r)))
            score[s], step[s] = prev[best] + log(trans.get((best, s), 0)) + e(s, c), best
        back.append(step)
    ends = "ES" if len(text) > 1 else STATES
    s = max(ends, key=lambda r: (score[r], -ord(r)))
    out = [s]
    for step in reversed(back):
        out.append(step[out[-1]])
    return "".join(reversed(out))


def viterbi_all(texts: list[str], start: dict, trans: dict, emit: dict) -> list[str]:
    """viterbi() of many texts, none empty, side by side: one step of numpy for each position of the longest text."""
    if not texts:
        return []
    low, order = -1e30, sorted(STATES)
    log = lambda p: math.log(p) if p else low
    known = sorted({c for _, c in emit})
    place = {c: i for i, c in enumerate(known)}
    e = np.array([[log(emit[s, c]) if (s, c) in emit else low for s in order] for c in known] + [[0.0] * 4])
    first, t = np.array([log(start.get(s, 0)) for s in order]), np.array([[log(trans.get((r, s), 0)) for r in order] for s in order])
    by = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in by])
    begin = np.cumsum(sizes) - sizes
    codes = np.fromiter((place.get(c, len(known)) for i in by for c in texts[i]), np.int64, int(sizes.sum()))
    score, back = first + e[codes[begin]], np.zeros((len(codes), 4), np.int8)
    last = np.array([order.index(c) for c in "ES"])
    labels = np.zeros(len(codes), np.int8)
    for p in range(1, int(sizes[0])):
        live = int(np.searchsorted(-sizes, -p, side="left"))  # texts longer than p come first
        at = begin[:live] + p
        ways = score[:live, None, :] + t
        best = ways.argmax(2)  # the state that sorts first among equals
        back[at] = best
        score[:live] = np.take_along_axis(ways, best[..., None], 2)[..., 0] + e[codes[at]]
    state = np.where(sizes > 1, last[score[:, last].argmax(1)], score.argmax(1))
    for p in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -p, side="left"))
        at = begin[:live] + p
        labels[at] = state[:live]
        state[:live] = back[at, state[:live]]
    out = [""] * len(texts)
    named = np.frombuffer("".join(order).encode(), np.uint8)[labels].tobytes().decode()
    for i, b, n in zip(by, begin.tolist(), sizes.tolist()):
        out[i] = named[b : b + n]
    return out


def cut_words(text: str, labels: str) -> list[str]:
    out, begin = [], 0
    for i, s in enumerate(labels):
        if s in "ES":
            out.append(text[begin : i + 1])
            begin = i + 1
    return out + ([text[begin:]] if begin < len(text) else [])


def cut(docs: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, words). The parameters are a few states times the characters of a script, collected once."""
    start, trans, emit = (m.collect() for m in model)
    a, b, c = {r.s: r.p for r in start}, {(r.s1, r.s2): r.p for r in trans}, {(r.s, r.ch): r.p for r in emit}
    shared = docs.sparkSession.sparkContext.broadcast((a, b, c))

    def part(rows):
        some = [t for _, t in rows if t]
        cuts = iter([cut_words(t, y) for t, y in zip(some, viterbi_all(some, *shared.value))])
        return pd.DataFrame({id_col: [i for i, _ in rows], "words": [next(cuts) if t else [] for _, t in rows]})

    def run(batches):
        for pdf in batches:
            held, size = [], 0
            for row in zip(pdf[id_col], pdf[text_col]):
                held.append(row)
                size += len(row[1] or "")
                if size >= _CHARS:
                    yield part(held)
                    held, size = [], 0
            if held:
                yield part(held)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInPandas(run, f"{id_col} long, words array<string>")
