import random

import numpy as np
import pytest
from brute import bag, exact_rows, fm_rows, near_rows, ordered, rows_of, suffix_rows
from pyspark.sql import functions as F

from tarnwood.llm import exact_dedup, fm_dedup, near_dedup, suffix_dedup

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")
NEAR = ("doc_id", "class_id", "class_size")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_exact(docs):
    assert rows_of(exact_dedup.exact_dedup(docs), *EXACT) == ordered(exact_rows(pairs(docs)))


def test_exact_compares_texts_where_digests_meet(docs):
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.pmod(F.length(t), F.lit(3)).cast("string"))
    assert rows_of(weak, *EXACT) == ordered(exact_rows(pairs(docs)))


def test_exact_with_salted_join(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert rows_of(exact_dedup.exact_dedup(docs), *EXACT) == ordered(exact_rows(pairs(docs)))


def test_drop_copies_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, _, k, _ in exact_rows(pairs(docs)) if k]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in want if i is not None)


def test_suffix(docs):
    assert rows_of(suffix_dedup.remove_repeats(docs), *SUFFIX) == ordered(suffix_rows(pairs(docs)))


def test_suffix_text_without_spans(docs):
    out = suffix_dedup.keep_text(docs.filter("doc_id in (1, 3, 11)").distinct(), suffix_dedup.remove_repeats(docs.filter("doc_id in (1, 3, 11)").distinct()))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3] == "" and len(got[1]) > 200 and "quick" not in got[11]


def test_spans_joined_by_shuffle(spark, docs):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = rows_of(suffix_dedup.remove_repeats(docs), *SUFFIX)
    finally:
        spark.conf.set(key, before)
    assert got == ordered(suffix_rows(pairs(docs)))


def test_fm(docs):
    assert rows_of(fm_dedup.remove_repeats(docs), *WORDS) == ordered(fm_rows(pairs(docs)))


def test_windows_on_random_texts(spark):
    """Few symbols, so that matches start, stop and overlap everywhere."""
    r = random.Random(3)
    base = "".join(r.choice("ab ") for _ in range(900))
    rows = []
    for i in range(40):
        a, n = r.randrange(700), r.randrange(20, 300)
        rows.append((i, base[a : a + n] + "".join(r.choice("ab é") for _ in range(r.randrange(60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(df), *SUFFIX) == ordered(suffix_rows(rows))
    assert rows_of(fm_dedup.remove_repeats(df), *WORDS) == ordered(fm_rows(rows))


def test_one_id_for_two_texts(spark):
    t = " ".join(f"v{i}" for i in range(70))
    rows = [(1, t), (1, "other " + t), (2, t + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(df), *SUFFIX) == ordered(suffix_rows(rows))
    assert rows_of(fm_dedup.remove_repeats(df), *WORDS) == ordered(fm_rows(rows))


def test_near(docs):
    assert rows_of(near_dedup.near_duplicates(docs), *NEAR) == ordered(near_rows(pairs(docs)))


def test_near_chains_are_not_lost(spark):
    """Texts that each differ a little more from the first: links exist between neighbours only."""
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(30):
        w = list(words)
        for j in range(i):
            w[(j * 6) % 200] = f"c{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df), *NEAR) == ordered(near_rows(rows))


def _family(seed, n):
    """Copies of copies: sets of changed words are shared between some, dropped and added words, and texts just below the threshold."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(160)]
    kin = [base]
    for i in range(n):
        w = list(r.choice(kin[-12:] if r.random() < 0.5 else kin))
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1, 1, 2])] = [r.choice([f"x{r.randrange(30)}", f"u{i}_{at}"]) for _ in range(r.choice([0, 1, 1, 3]))]
        kin.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(kin)]


@pytest.mark.parametrize("longest", [2, 256])
def test_near_families(spark, longest):
    rows = _family(4, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({c for _, c, _ in near_rows(rows)}) > 3
    assert rows_of(near_dedup.near_duplicates(df, per_band=2, longest=longest), *NEAR) == ordered(near_rows(rows))


def test_near_one_id_for_two_texts(spark):
    a = " ".join(f"q{j}" for j in range(100))
    rows = [(1, a), (5, a + " z"), (5, "another text with nothing in common"), (None, "y " + a), (None, "some other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered((r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect()) == ordered([rows[2], rows[3], rows[4]])


def test_near_recall_on_documents(spark):
    """Pairs of 0.8 and more among documents that share a shingle of at most 60 documents."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    bags = [bag(t) for _, t in rows]
    by = {}
    for i, b in enumerate(bags):
        for g in b:
            by.setdefault(g, []).append(i)
    near = set()
    for i, j in {(i, j) for g in by.values() if len(g) <= 60 for i in g for j in g if i < j}:
        both = sum((bags[i] & bags[j]).values())
        if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
            near.add((rows[i][0], rows[j][0]))
    of = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(near) > 50 and sum(of[a] == of[b] for a, b in near) >= 0.99 * len(near)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elems = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = elems[:1000], elems[250:1250]
    sig = near_dedup.dart_signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    assert abs((sig[0] == sig[1]).mean() - 750 / 1250) < 0.1
    assert (sig != 0).all()
    small = near_dedup.dart_signatures(elems[:3], np.array([0, 3, 3]), 50)
    assert (small[0] != 0).all() and (small[1] == 0).all()


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, suffix_dedup.remove_repeats, fm_dedup.remove_repeats, near_dedup.near_duplicates])
def test_empty_table(op, none):
    assert op(none).count() == 0


def test_longest_previous_factors():
    r = random.Random(2)
    pieces = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))).encode() for _ in range(40)]
    text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
    at = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    doc = np.array([r.randrange(12) for _ in pieces])
    starts = np.concatenate([a + np.arange(len(p)) for a, p in zip(at, pieces)])
    left = np.concatenate([len(p) - np.arange(len(p)) for p in pieces])
    owner = np.repeat(doc, [len(p) for p in pieces])
    got = suffix_dedup.longest_previous_factors(text, starts, left, owner)
    tails = [(d, p[i:]) for d, p in zip(doc, pieces) for i in range(len(p))]

    def both(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    assert got.tolist() == [max([both(x, y) for e, y in tails if e < d], default=0) for d, x in tails]
    assert suffix_dedup.smaller_before(np.array([3, 1, 2, 2, 0, 5])).tolist() == [-1, -1, 1, 1, -1, 4]


def test_matching_statistics():
    r = random.Random(6)
    pieces = [[r.randrange(2, 5) for _ in range(r.randrange(1, 30))] for _ in range(15)]
    doc = [r.randrange(6) for _ in pieces]
    text = np.array([x for p in pieces for x in [*p, 1]] + [0])
    owner = np.array([d for d, p in zip(doc, pieces) for _ in range(len(p) + 1)] + [99])
    index = fm_dedup.FMIndex(text, owner)
    stops = np.array([sum(len(q) + 1 for q in pieces[:i]) + j for i, p in enumerate(pieces) for j in range(1, len(p) + 1)])
    who = np.array([d for d, p in zip(doc, pieces) for _ in p])

    def longest(p, j, d, limit):
        inside = lambda w: any(w == q[i : i + len(w)] for e, q in zip(doc, pieces) if e < d for i in range(len(q)))
        return max([n for n in range(1, min(j, limit) + 1) if inside(p[j - n : j])], default=0)

    want = [longest(p, j, d, 7) for d, p in zip(doc, pieces) for j in range(1, len(p) + 1)]
    got = index.matching_statistics(text, stops, 7, who)
    assert got.tolist() == want and 0 < sum(0 < x < 7 for x in want)


def test_wide_windows(spark):
    """More windows in a piece than eight bits number; widths that are too small are refused."""
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(2000))
    rows = [(1, long), (2, "x" + long[100:1500] + "y"), (3, long[300:1900]), (4, "z" + long[:290])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(suffix_dedup.remove_repeats(df, width=300), *SUFFIX) == ordered(suffix_rows(rows, 300))
    words = [(i, " ".join(t.replace(" ", "q"))) for i, t in rows]
    assert rows_of(fm_dedup.remove_repeats(spark.createDataFrame(words, "doc_id long, text string"), width=300), *WORDS) == ordered(fm_rows(words, 300))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, width=10)
