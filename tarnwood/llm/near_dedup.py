"""MinHash near-dedup: DartMinHash signatures of weighted shingle sets, banded joining, exact verification.

A document is the weighted set of its five-word shingles, the weight being the number of occurrences; similarity is the
weighted Jaccard similarity. For each element the plane of weight and rank holds darts, one per unit of area on average,
whose places are hashes of the element and the unit cell, so all documents see the same darts. The darts with a weight
below the element's weight hit the document; those of rank below theta = t / |x| are thrown (t = k ln k + 2k expected),
each hashes to one of k coordinates, and the dart of least rank in a coordinate is the signature there. Coordinates
without a dart are rare and filled by doubling theta for that document. The work is linear in elements plus darts.

Signatures are cut into bands; documents that agree in a band share a bucket. Links inside buckets are found exactly, without all
pairs of a bucket. The pivot of a bucket is its member that shares most buckets with others (the original of a family of
copies); buckets of one pivot h are one group, and each member z is compared with h: M = h without z, E = z without h. Documents
linked to h are of one class. Two members x, y have |h| - |Mx| - |My| + c elements in common, c being those that their
differences share, so they are linked exactly if c >= g(x) + g(y) - |h| (1 - t) / (1 + t) with g = (t |E| + |M|) / (1 + t). For a
member that is not linked to h this is more than 0: what is left to find shows in shared differences. Differences that only
one member has cannot be shared, which ends the search for nearly all members (bounds of g and of g - |M| among the members
of other classes). The others are posted under the rarest of their shared differences (prefix filter: so many that a linked pair
must meet), and pairs that meet are tested by c. Where more than `longest` members are posted under one difference, they are a
group of their own with one of them as its pivot, and the same steps follow; the pivot leaves, so this ends.

Exact copies (equal words) are one document with a count throughout. Classes are found by least labels with pointer
jumping over staged tables; nothing of the corpus is sent to the driver.

Cases: null and empty texts have no words and form one class of exact copies; texts of one to four words are one shingle;
the least doc_id names a class, and the document of that id stays (of several texts with that id, the one of least digest);
rows that repeat a doc_id each give a row, and a row is known by its id and words, so that one id may stand for several
texts; a null doc_id counts as the smallest and is returned as null; very long texts are one set of hashes; empty tables
give no rows; further columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batches_by_bytes, map_arrow, mix64, parts_for, small_side, stage, utf8
from .earlier_windows import _NO_ID, keyed
from .windows import gram_hashes, word_symbols

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Rows with lists of differences that one task may hold where a table's size is known.
_WIDE = 2_000
#: Poisson(1): chance of at most 0, 1, 2 ... darts in a unit cell.
_UPTO = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def elements(raw: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (shingle, occurrence) of each text and their n + 1 offsets: a set whose plain Jaccard similarity is the
    weighted one of the shingles."""
    sym, words, _, _ = word_symbols(raw, ends)
    n = np.diff(words)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.repeat(words[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    grams = gram_hashes(sym, width)
    out = np.zeros(len(row), np.uint64)
    long = n[row] >= width
    out[long] = grams[first[long]]
    for i in np.flatnonzero((n > 0) & (n < width)):  # at most four words each
        h = n[i : i + 1].astype(np.uint64)
        for s in sym[words[i] : words[i + 1]]:
            h = mix64(h * _GOLD ^ s)
        out[np.searchsorted(row, i)] = h[0]
    salted = mix64(out ^ mix64(row.astype(np.uint64) * _GOLD))
    order = np.argsort(salted, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], salted[order][1:] != salted[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    occurrence = np.zeros(len(row), np.uint64)
    occurrence[order] = (np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))).astype(np.uint64)
    return mix64(out + occurrence * np.uint64(0xA24BAED4963EE407)), np.concatenate([[0], np.cumsum(count)])


def dart_signatures(elems: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """n x k signature; rows of empty sets are 0. Each element covers one unit of weight, so a shingle of weight w has w
    cells side by side; the cell (element, rank floor) holds Poisson(1) darts."""
    n, size = len(ends) - 1, np.diff(ends)
    out = np.zeros((n, k), np.uint64)
    theta = (k * math.log(k) + 2 * k) / np.maximum(size, 1)
    todo = np.flatnonzero(size)
    while len(todo):
        cells = np.ceil(theta[todo]).astype(np.int64)
        own = size[todo]
        row = np.repeat(np.arange(len(todo)), own)
        e = elems[np.repeat(ends[:-1][todo] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        times = cells[row]
        at = np.repeat(np.arange(len(e)), times)
        floor = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        key = mix64(e[at] ^ mix64(floor.astype(np.uint64) + _GOLD))
        u = (key >> np.uint64(11)).astype(np.float64) * 2.0**-53
        darts = np.searchsorted(_UPTO, u, side="right")
        hit = np.flatnonzero(darts)
        count = darts[hit]
        which = np.repeat(hit, count)
        number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix64(key[which] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        rank = floor[which] + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53
        drow = row[at[which]]
        low = np.flatnonzero(rank <= theta[todo][drow])
        dart, rank, drow = dart[low], rank[low], drow[low]
        name = mix64(dart + _GOLD)
        place = drow * k + (name % np.uint64(k)).astype(np.int64)
        order = np.lexsort((name, rank, place))
        first = order[np.concatenate([[True], place[order][1:] != place[order][:-1]])] if len(order) else order
        sig = np.zeros(len(todo) * k, np.uint64)
        sig[place[first]] = name[first]
        sig = sig.reshape(len(todo), k)
        full = (sig != 0).all(1)
        out[todo[full]] = sig[full]
        todo = todo[~full]
        theta[todo] *= 2
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64) * _GOLD
        for c in range(b * rows, (b + 1) * rows):
            h = mix64(h ^ sig[:, c])
        out[:, b] = h
    return out.view(np.int64)


def _signed(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    def run(batches):
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            raw, ends = utf8(batch.column(1))
            elems, off = elements(raw, ends)
            keys = band_keys(dart_signatures(elems, off, bands * per_band), bands, per_band)
            some = np.flatnonzero(np.diff(off))
            values = pa.array(keys[some].ravel())
            yield pa.record_batch([batch.column(0).take(pa.array(some)), pa.array(np.diff(off)[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * bands).astype(np.int32)), values)], names=["key", "n", "bands"])

    return map_arrow(rows.select("key", "text"), run, "key long, n int, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(key, elems): the hashed set of each text."""

    def run(batches):
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            raw, ends = utf8(batch.column(1))
            elems, off = elements(raw, ends)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(elems.view(np.int64)))], names=["key", "elems"])

    return map_arrow(rows.select("key", "text"), run, "key long, elems array<long>")


def components(links: DataFrame) -> DataFrame:
    """(key, label): least key of each connected part, by least labels of neighbours and pointer jumping."""
    parts = parts_for(links.count())  # tables as small as these need few tasks
    edges = stage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", parts)
    labels = stage(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("label")), "labels", parts)
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        low = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("key").alias("low"), F.col("label").alias("far"))
        new = stage(low.join(jump, "low", "left").select("key", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label")), "labels", parts)
        if new.filter("old <> label").isEmpty():
            return new.select("key", "label")
        labels = new.select("key", "label")


def _pivots(buckets: DataFrame, parts: int) -> DataFrame:
    """(h, key): each member of a bucket beside the bucket's pivot."""
    sized = buckets.join(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket").groupBy("key").agg(F.sum("size").alias("weight"))
    weighed = stage(buckets.select("bucket", "key").join(sized, "key"), "weighed", parts)
    pivot = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("p")).select("bucket", F.col("p.key").alias("h"))
    return weighed.join(pivot, "bucket").filter("key <> h").select("h", "key").distinct()


def _linked(common: Column, n: Column, other: Column, threshold: float) -> Column:
    return common >= threshold * (n + other - common)


def _mixed(members: DataFrame, parts: int) -> DataFrame:
    """Members of the groups that hold more than one class."""
    several = members.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("grp")
    return members.join(small_side(several, "several", parts=parts), "grp", "left_semi")


def _hopeful(members: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Members that the bounds allow a link to a member of another class, with the least number of differences that such a
    link shares (o, and eo of E alone). members: (grp, nh, key, label, m, e), of groups of more than one class."""
    cost = (threshold * F.size("e") + F.size("m")) / (1 + threshold)
    sizes = members.select("grp", "nh", "key", "label", F.size("m").alias("nm"), F.size("e").alias("ne"), cost.alias("g"), (cost - F.size("m")).alias("r"))
    seen = members.select("grp", "key", F.explode("e").alias("x"), F.lit(1).alias("in_e")).unionAll(members.select("grp", "key", F.explode("m").alias("x"), F.lit(0).alias("in_e")))
    own = seen.groupBy("grp", "x", "in_e").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("c")).filter("c = 1").groupBy("grp", "key").agg(F.sum("in_e").alias("own_e"), F.sum(1 - F.col("in_e")).alias("own_m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    held = stage(sizes.join(own, ["grp", "key"], "left").withColumns({"se": F.col("ne") - zero("own_e"), "sm": F.col("nm") - zero("own_m")}).drop("own_e", "own_m"), "bounds", parts)
    least = small_side(held.groupBy("grp").agg(F.min(F.struct("g", "label")).alias("bg"), F.min(F.struct("r", "label")).alias("br")), "least", parts=parts)
    others = held.join(least, "grp").groupBy("grp").agg(F.min(F.when(F.col("label") != F.col("bg.label"), F.col("g"))).alias("g2"), F.min(F.when(F.col("label") != F.col("br.label"), F.col("r"))).alias("r2"))
    told = held.join(least, "grp").join(small_side(others, "others", parts=parts), "grp")
    free = F.col("nh") * ((1 - threshold) / (1 + threshold)) + 1e-6  # rounding never rules a member out
    g = F.when(F.col("label") != F.col("bg.label"), F.col("bg.g")).otherwise(F.col("g2"))
    r = F.when(F.col("label") != F.col("br.label"), F.col("br.r")).otherwise(F.col("r2"))
    told = told.withColumns({"o": F.col("g") + g - free, "eo": F.col("g") + r - free})
    return told.filter("se + sm > 0 and se + sm >= o and se >= eo").select("grp", "key", "o", "eo")


def _posted(members: DataFrame, parts: int) -> DataFrame:
    """(grp, kind, x, key): members under the rarest of their shared differences. Kind 1: of E, for links that must share
    some of E; kind 0: of both, for members of which that is not known."""
    one = lambda c, in_e: members.select("grp", "key", "o", "eo", F.explode(c).alias("x"), F.lit(in_e).alias("in_e"))
    seen = stage(one("e", 1).unionAll(one("m", 0)), "differences", parts)
    times = seen.groupBy("grp", "x", "in_e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = seen.join(times, ["grp", "x", "in_e"]).groupBy("grp", "key", "o", "eo").agg(F.array_sort(F.collect_list(F.struct("c", "x", "in_e"))).alias("d"))
    upto = lambda d, o: F.slice(d, 1, F.greatest(F.size(d) - F.greatest(F.lit(1), F.ceil(o)).cast("int") + 1, F.lit(0)))
    kinds = shared.select("grp", "key", upto(F.filter("d", lambda d: d["in_e"] == 1), F.col("eo")).alias("e"), F.when(F.col("eo") < 1, upto(F.col("d"), F.col("o"))).alias("d"))
    return stage(kinds.select("grp", "key", F.explode("e").alias("d"), F.lit(1).alias("kind")).unionAll(kinds.select("grp", "key", F.explode("d").alias("d"), F.lit(0).alias("kind"))).select("grp", "kind", "d.x", "key"), "posted", parts)


def _renamed(members: DataFrame, links: DataFrame) -> DataFrame:
    return members.join(components(links).select("key", F.col("label").alias("new")), "key", "left").withColumn("label", F.coalesce("new", "key")).drop("new")


def links_of(buckets: DataFrame, sets: DataFrame, threshold: float, longest: int = 256) -> DataFrame:
    """buckets: (bucket, key) with two members or more; sets: (key, elems). Returns links (a, b) that connect the documents of each class."""
    few = parts_for(buckets.count())
    pairs = small_side(_pivots(buckets, few), "pivots", parts=few)
    parts = parts_for(pairs.count(), _WIDE)
    one = sets.join(pairs, "key").select("h", "key", "elems")
    both = one.join(sets.select(F.col("key").alias("h"), F.col("elems").alias("eh")), "h")
    members = stage(both.select(F.col("h").alias("grp"), F.col("h").alias("pivot"), F.size("eh").alias("nh"), "key", F.array_except("eh", "elems").alias("m"), F.array_except("elems", "eh").alias("e")), "members", parts)
    n = F.col("nh") - F.size("m") + F.size("e")  # elements of the member
    links = stage(members.filter(_linked(n - F.size("e"), n, F.col("nh"), threshold)).select(F.col("pivot").alias("a"), F.col("key").alias("b")), "links", parts)
    while True:
        held = stage(_mixed(_renamed(members.drop("pivot"), links), parts), "mixed", parts)
        if held.isEmpty():
            return links
        held = stage(held.join(_hopeful(held, threshold, parts), ["grp", "key"]), "hopeful", parts)
        posted = _posted(held, parts)
        lists = posted.groupBy("grp", "kind", "x").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        posts = stage(posted.join(lists, ["grp", "kind", "x"]).join(held.select("grp", "key", "label", "nh", F.size("m").alias("nm"), F.size("e").alias("ne")), ["grp", "key"]), "posts", parts)
        short, cost = posts.filter(F.col("c") <= longest), lambda p: (threshold * F.col(f"{p}ne") + F.col(f"{p}nm")) / (1 + threshold)
        y = short.select("grp", "kind", "x", *(F.col(c).alias(f"y_{c}") for c in ("key", "label", "nm", "ne")))
        enough = F.least("nm", "y_nm") + F.least("ne", "y_ne") >= cost("") + cost("y_") - F.col("nh") * ((1 - threshold) / (1 + threshold)) - 1e-6
        meet = stage(short.join(y, ["grp", "kind", "x"]).filter((F.col("key") < F.col("y_key")) & (F.col("label") != F.col("y_label")) & enough).select("grp", F.col("key").alias("a"), F.col("y_key").alias("b")).distinct(), "pairs", parts)
        side = lambda p: held.select("grp", F.col("key").alias(p), F.col("m").alias(f"m_{p}"), F.col("e").alias(f"e_{p}"), "nh")
        tested = meet.join(side("a"), ["grp", "a"]).join(side("b").drop("nh"), ["grp", "b"])
        common = F.col("nh") - F.size("m_a") - F.size("m_b") + F.size(F.array_intersect("m_a", "m_b")) + F.size(F.array_intersect("e_a", "e_b"))
        size = lambda p: F.col("nh") - F.size(f"m_{p}") + F.size(f"e_{p}")
        links = stage(links.unionAll(tested.filter(_linked(common, size("a"), size("b"), threshold)).select("a", "b")).distinct(), "links", parts)
        long = posts.filter(F.col("c") > longest).select(F.xxhash64("grp", "kind", "x").alias("sub"), "grp", "key")
        if long.isEmpty():
            return links
        lead = long.join(held.select("grp", "key", "m", "e", "nh"), ["grp", "key"])
        first = lead.groupBy("sub").agg(F.min("key").alias("pivot"))
        lead = stage(lead.join(small_side(first, "first", parts=parts), "sub"), "sub", parts)
        p = lead.filter("key = pivot").select("sub", F.col("m").alias("pm"), F.col("e").alias("pe"))
        less, more = lambda x, y: F.array_except(x, y), F.concat
        members = lead.filter("key <> pivot").join(p, "sub").select(F.col("sub").alias("grp"), "pivot", (F.col("nh") - F.size("pm") + F.size("pe")).alias("nh"), "key", more(less("m", "pm"), less("pe", "e")).alias("m"), more(less("pm", "m"), less("e", "pe")).alias("e"))
        members, parts = stage(members, "members", parts), parts_for(lead.count(), _WIDE)
        links = stage(links.unionAll(members.filter(_linked(n - F.size("e"), n, F.col("nh"), threshold)).select(F.col("pivot").alias("a"), F.col("key").alias("b"))).distinct(), "links", parts)


def _classes(docs: DataFrame, threshold: float, bands: int, per_band: int, id_col: str, text_col: str, longest: int = 256) -> DataFrame:
    """Per row: doc (null id as least), sha of the text's words, class_id, class_size, first (sha of the document that stays)."""
    rows, ids = keyed(docs, _words_of(text_col), id_col)
    parts = parts_for(ids.count())
    first = stage(ids.groupBy("sha").agg(F.min(F.struct("doc", "key")).alias("f"), F.count(F.lit(1)).alias("n")).select("sha", F.col("f.key").alias("rep"), F.col("f.doc").alias("doc"), "n"), "texts", parts)
    copies = small_side(ids.join(first.filter("n > 1").select("sha", "rep"), "sha").filter("key <> rep").select("key").distinct(), "copies", parts=parts)
    single = rows.select("key", "text").join(copies, "key", "left_anti")
    signed = stage(_signed(single, bands, per_band), "signatures")
    exploded = signed.select("key", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("bucket")
    buckets = stage(exploded.join(shared, "bucket").select("bucket", "key").distinct(), "buckets", bands * parts)
    wanted = small_side(buckets.select("key").distinct(), "wanted", parts=parts)
    sets = stage(_sets(single.join(wanted, "key", "left_semi")).dropDuplicates(["key"]), "sets")
    classes = components(links_of(buckets, sets, threshold, longest))
    texts = first.join(classes.select(F.col("key").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = texts.groupBy("label").agg(F.min(F.struct("doc", "sha")).alias("f"), F.sum("n").alias("class_size"))
    told = stage(texts.join(named, "label").select("sha", F.col("f.doc").alias("class_id"), F.col("f.sha").alias("first"), "class_size"), "classes", parts)
    return ids.join(told, "sha").select("doc", "sha", "class_id", "class_size", "first")


def _words_of(text_col: str) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "), F.lit(" "))


def _kept() -> Column:
    return (F.col("doc") == F.col("class_id")) & (F.col("sha") == F.col("first"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 20, per_band: int = 5, id_col: str = "doc_id", text_col: str = "text", longest: int = 256) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of the class), class_size (rows), kept.

    A pair of similarity s shares a bucket with probability 1 - (1 - s**per_band)**bands: 0.9996 at 0.8."""
    real = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return _classes(docs, threshold, bands, per_band, id_col, text_col, longest).select(real("doc").alias("doc_id"), real("class_id").alias("class_id"), "class_size", _kept().alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, bands: int = 20, per_band: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document (id and words) of each class, with all their columns."""
    gone = _classes(docs, threshold, bands, per_band, id_col, text_col).filter(~_kept()).select(F.col("doc").alias("_gone"), F.col("sha").alias("_sha")).distinct()
    gone = small_side(gone, "near", parts=parts_for(docs.count()))
    own = (F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)) == gone["_gone"]) & (F.sha2(_words_of(text_col), 256) == gone["_sha"])
    return docs.join(gone, own, "left_anti")
