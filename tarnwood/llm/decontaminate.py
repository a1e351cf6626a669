"""Benchmark decontamination [native]: a distributed positional inverted index, intersected from the rarest test terms.

The training texts are tokenised once; every posting (term, document, position) of a term that occurs in the test set is
stored as a table in the shared folder, with one end posting per document that carries its length. Test items become
windows of `width` consecutive words. For each window the posting lists are taken in the order of their length: each posting of the
rarest term is a candidate place; places without the second rarest term near by go, then those without the third; the
lists of the other terms are read for the documents that are left. At a place that remains, the offset-adjusted positions
tell whether it is an exact phrase match (every term at its offset), and whether it is a proximity match: all words of the
window, each as often as in the window, in any order, inside n + n div 2 consecutive words of the document, n being the
window's length. An exact match is a proximity match. Only DataFrame operations are used.

Sizes: vocabulary, windows and candidates are broadcast only after they were counted (common.small_side), else joined by
shuffle on (key, block of positions, term), keys that no single word dominates. Word frequencies are summed before the shuffle.

Cases: null and empty texts have no words and give zero counts; items without words or id are ignored; items shorter than
the window are one window; a document is a row's id and text: rows that repeat both are one document and each get its
answer, one id with several texts stands for several documents, and a null id is an id like others; very long texts are
postings like any others; an empty benchmark gives no hits, empty documents no rows; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, small_side, stage

_SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same with A-Z as letters, for texts as they are
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(2**63)
END = 0  # term of the end posting


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    bare = F.btrim(low, F.lit(_SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id (null as least), or a hash of id and text where some id stands for two texts."""
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(doc.alias("doc"), F.xxhash64(text).alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    return doc if seen.filter("a < b").isEmpty() else F.xxhash64(doc, text)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, win array<string>): each window of each item."""
    w = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("win")).distinct()


def build_index(docs: DataFrame, windows: DataFrame, key: Column, text_col: str = "text", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored postings (doc, pos, term) and the vocabulary (word, term) of the test set."""
    from pyspark.sql import Window

    test_words = windows.select(F.explode("win").alias("word")).distinct()
    vocab = test_words.withColumn("term", F.row_number().over(Window.orderBy("word"))).unionAll(docs.sparkSession.createDataFrame([("", END)], "word string, term int"))
    vocab = small_side(vocab, "vocabulary", parts=parts)
    tokens = docs.select(key.alias("doc"), F.posexplode(F.array_append(words(F.col(text_col)), F.lit(""))).alias("pos", "word"))
    return stage(tokens.join(vocab, "word").select("doc", "pos", "term"), "postings"), vocab


def ranked_windows(windows: DataFrame, vocab: DataFrame, postings: DataFrame, parts: int | None = None) -> DataFrame:
    """(win, n, parts): each different window once, its (uses, off, term) from the rarest term on; none if a term never occurs."""
    from pyspark.sql import Window

    uses = postings.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    terms = small_side(vocab.join(uses, "term").filter(F.col("term") != END), "uses", parts=parts)
    spread = windows.select("win").distinct().select("win", F.posexplode("win").alias("off", "word")).join(terms, "word")
    ranked = spread.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("uses", "off", "term"))).alias("parts"))
    ranked = ranked.filter(F.size("parts") == F.size("win"))  # each of the item's terms occurs
    return ranked.select("win", F.size("win").alias("n"), "parts", F.row_number().over(Window.orderBy("win")).alias("wid"))


def _span(n):
    return n + F.floor(n / 2).cast("int")


def matches(postings: DataFrame, ranked: DataFrame, width: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, start, n, wid) of every exact occurrence of a window, and (doc, wid) of the windows with a proximity match."""
    reach = width + width // 2  # no stretch is longer
    size = 6 * reach
    block = lambda pos: F.floor(pos / size).cast("int")

    def blocks(pos):
        """The block of a position, and the next one where that is within reach."""
        at, b = F.pmod(pos, F.lit(size)), block(pos)
        return F.explode(F.array_compact(F.array(b, F.when(at < reach, b - 1), F.when(at >= size - reach, b + 1)))).alias("block")

    def part(i: int, name: str) -> DataFrame:
        """The i-th rarest term of each window that has one."""
        return small_side(ranked.filter(F.size("parts") > i).select(F.col("parts")[i]["term"].alias("term"), F.col("parts")[i]["off"].alias("off"), "n", "wid"), name, parts=parts)

    def near(places: DataFrame, i: int) -> DataFrame:
        """Places of windows of more than i words that have the i-th rarest term near by."""
        other = part(i, f"part{i}")
        lists = postings.join(small_side(other.select("term").distinct(), "terms", parts=parts), "term", "left_semi").withColumnRenamed("pos", "at")
        lists = lists.select("doc", "term", "at", blocks(F.col("at")))
        need = places.join(other.drop("n", "off"), "wid").withColumn("block", block(F.col("pos")))
        close = need.join(lists, ["doc", "block", "term"]).filter((F.abs(F.col("at") - F.col("pos")) < _span(F.col("n"))) & (F.col("at") != F.col("pos")))
        return stage(close.select("doc", "pos", "off", "n", "wid").distinct(), f"near{i}")

    first = stage(postings.join(part(0, "rarest"), "term").select("doc", "pos", "off", "n", "wid"), "candidates")
    second = near(first, 1)
    third = near(second.filter("n > 2"), 2)
    rest = third.unionByName(second.filter("n = 2"))
    terms = F.array_distinct(F.transform("parts", lambda x: x["term"]))
    needs = F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter("parts", lambda x: x["term"] == t)).alias("c")))
    listed = small_side(ranked.select("wid", F.transform("parts", lambda x: F.struct(x["off"].alias("off"), x["term"].alias("term"))).alias("parts"), needs.alias("needs")), "windows", parts=parts)
    need = rest.join(listed.select("wid", "needs"), "wid").select("doc", "pos", "off", "n", "wid", F.explode("needs.term").alias("term"))
    need = need.select("*", blocks(F.col("pos")))
    lists = postings.join(small_side(rest.select("doc").distinct(), "documents"), "doc", "left_semi").select("doc", "term", F.col("pos").alias("at"), block(F.col("pos")).alias("block"))
    seen = need.join(lists, ["doc", "block", "term"]).filter(F.abs(F.col("at") - F.col("pos")) < _span(F.col("n")))
    seen = seen.groupBy("doc", "pos", "off", "n", "wid").agg(F.collect_set(F.struct("at", "term")).alias("hits")).join(listed, "wid")
    start = F.col("pos") - F.col("off")
    exact = F.forall("parts", lambda x: F.array_contains(F.col("hits"), F.struct((start + x["off"]).alias("at"), x["term"].alias("term"))))
    inside = lambda s: F.filter("hits", lambda h: (h["at"] >= s) & (h["at"] < s + _span(F.col("n"))))
    whole = lambda hits: F.forall("needs", lambda t: F.size(F.filter(hits, lambda h: h["term"] == t["term"])) >= t["c"])
    firsts = F.filter(F.transform("hits", lambda h: h["at"]), lambda a: a <= F.col("pos"))  # a stretch may begin at one of the words
    told = seen.select("doc", "pos", "off", "n", "wid", exact.alias("exact"), F.when(exact, True).when(whole(F.col("hits")), F.exists(firsts, lambda s: whole(inside(s)))).otherwise(False).alias("near"))
    told = stage(told.filter("near"), "matches")
    alone = first.filter("n = 1").select("doc", F.col("pos").alias("start"), "n", "wid").distinct()
    exacts = told.filter("exact").select("doc", start.alias("start"), "n", "wid").unionByName(alone)
    return exacts, told.select("doc", "wid").unionByName(alone.select("doc", "wid")).distinct()


def _judged(docs: DataFrame, items: DataFrame, key: Column, width: int, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, n_words) of all keys, (doc, n_hit, n_items, item_list, n_near, near_list) of those with a match, and (doc, pos) of
    the words hit."""
    windows = stage(item_windows(items, width), "windows")
    parts = parts_for(windows.count(), 5_000)  # of the tables that grow with the benchmark alone
    postings, vocab = build_index(docs, windows, key, text_col, parts)
    ranked = stage(ranked_windows(windows, vocab, postings, parts), "ranked", parts)
    exact, close = matches(postings, ranked, width, parts)
    hits = stage(exact, "hits")
    places = hits.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hit = places.groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    of = small_side(windows.join(ranked.select("win", "wid"), "win").select("wid", "item_id"), "items", parts=parts)

    def items_of(found: DataFrame, n: str, listed: str) -> DataFrame:
        ids = found.select("doc", "wid").distinct().join(of, "wid").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
        return ids.groupBy("doc").agg(F.count(F.lit(1)).alias(n), F.array_join(F.array_sort(F.collect_list("item")), ",").alias(listed))

    told = items_of(close, "n_near", "near_list").join(items_of(hits, "n_items", "item_list"), "doc", "left").join(hit, "doc", "left")
    return postings.filter(F.col("term") == END).groupBy("doc").agg(F.max("pos").cast("long").alias("n_words")), small_side(told, "told"), places


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated by exact matches; n_near, near_sha256:
    the items with a proximity match, digested alike."""
    key = _row_key(docs, id_col, text_col)
    length, told, _ = _judged(docs, items, key, width, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("doc"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    bad = F.coalesce(F.col("n_items") >= least_items, F.lit(False)).alias("contaminated")
    return rows.join(length, "doc").join(told, "doc", "left").select("doc_id", "n_words", zero("n_hit"), zero("n_items"), digest("item_list").alias("items_sha256"), bad, zero("n_near"), digest("near_list").alias("near_sha256"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated (by exact matches), with all their columns; a row is known by id and text."""
    key = _row_key(docs, id_col, text_col)
    _, told, _ = _judged(docs, items, key, width, text_col)
    gone = small_side(told.filter(F.col("n_items") >= least_items).select(F.col("doc").alias("_gone")), "contaminated")
    return docs.join(gone, key == gone["_gone"], "left_anti")


def cut_contaminated(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, without the words that any exact match covers; a row of no other words goes.

    A word goes with what stands between it and the next one. Matches are judged on the input, not on what is left; texts
    without a match stay as they are. length_col: a column with the text's length in characters, told anew where words went."""
    from pyspark.sql import Window

    key = _row_key(docs, id_col, text_col)
    _, told, places = _judged(docs, items, key, width, text_col)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc").orderBy("pos"))  # alike for words in a row
    runs = places.withColumn("run", run).groupBy("doc", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("_runs"))
    cuts = small_side(runs.join(told.select("doc", "n_items"), "doc").select(F.col("doc").alias("_doc"), F.col("n_items").alias("_items"), "_runs"), "cuts")
    rows = docs.join(cuts, key == cuts["_doc"], "left").filter(F.col("_items").isNull() | (F.col("_items") < least_items))
    hit, text = F.col("_runs").isNotNull(), F.col(text_col)
    parts = F.struct(F.filter(F.split(text, _BETWEEN), lambda w: w != "").alias("words"), F.split(text, _WORD).alias("between"))
    rows = rows.select("*", F.explode(F.array(F.when(hit, parts))).alias("_parts"))  # a generator, so that a text is split once
    gone = F.flatten(F.transform("_runs", lambda r: F.sequence(r["a"], r["b"])))
    rows = rows.select("*", F.explode(F.array(F.when(hit, F.array_except(F.sequence(F.lit(0), F.size("_parts.words") - 1), gone)))).alias("_left"))
    rows = rows.filter(F.col("_left").isNull() | (F.size("_left") > 0))
    left = F.array_join(F.transform("_left", lambda i: F.concat(F.col("_parts.words")[i], F.col("_parts.between")[i + 1])), "")
    rows = rows.withColumn(text_col, F.when(hit, F.concat(F.col("_parts.between")[0], left)).otherwise(text))
    if length_col:
        rows = rows.withColumn(length_col, F.when(hit, F.char_length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return rows.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS win, least(len(w), 8) AS n FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, sizes s)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
nw AS (SELECT DISTINCT item_id, w[i : i + 7] AS v, least(len(w), 8) AS n, least(len(w), 8) + least(len(w), 8) // 2 AS span FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) t(i) WHERE len(w) > 0),
freq AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
ns AS (SELECT v, span, arg_min(word, (coalesce(c, 0), word)) AS rare FROM (SELECT DISTINCT v, span, unnest(v) AS word FROM nw) LEFT JOIN freq USING (word) GROUP BY v, span),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
nc AS (SELECT dp.doc_id, dp.w, dp.i, ns.v, ns.span FROM dp JOIN ns ON dp.w[dp.i] = ns.rare WHERE list_has_all(dp.w[greatest(dp.i - ns.span + 1, 1) : dp.i + ns.span - 1], ns.v)),
nl AS (SELECT doc_id, v, w[s : s + span - 1] AS part FROM (SELECT doc_id, w, v, span, unnest(range(greatest(i - span + 1, 1), i + 1)) AS s FROM nc)),
nh AS (SELECT DISTINCT doc_id, v FROM nl WHERE list_has_all(part, v) AND len(list_filter(v, lambda x: len(list_filter(part, lambda y: y = x)) < len(list_filter(v, lambda y: y = x)))) = 0),
nt AS (SELECT doc_id, count(*) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT nh.doc_id, nw.item_id FROM nh JOIN nw USING (v)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.l, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated,
  coalesce(nt.n_near, 0) AS n_near, sha256(coalesce(nt.l, '')) AS near_sha256
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id LEFT JOIN nt ON nt.doc_id = d.doc_id
"""
