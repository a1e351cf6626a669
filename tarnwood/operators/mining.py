"""Frequent items, item sets, prefix trees. Baskets are (tid, items array<string>)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered_by_text


def item_frequency(baskets: DataFrame) -> DataFrame:
    """(item, cnt): repeats inside a basket count."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("cnt"))


def apriori(baskets: DataFrame, least_single: int = 3, confidence: float = 0.7, least_group: int = 1) -> DataFrame:
    """(items, support, max_item, max_val, confidence): pairs and triples of frequent items made in their basket, each
    a row with an id of its own; confidence is support over the count of the most frequent member (the first on ties)."""
    freq = item_frequency(baskets).filter(F.col("cnt") >= least_single)
    one = baskets.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("s"))
    after = lambda i: F.slice("s", F.col(i) + 2, F.greatest(F.size("s"), F.lit(1)))  # noqa: E731  the items that sort later
    pair_rows = one.select("s", F.posexplode("s").alias("i", "a")).select("s", "i", "a", F.posexplode(after("i")).alias("j", "b")).withColumn("j", F.col("i") + F.col("j") + 1)
    kept = lambda df, *cs: reduce(lambda d, c: d.join(freq.select(F.col("item").alias(c)), c, "left_semi"), cs, df)
    count = lambda df, *cs: kept(df.groupBy(*cs).agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least_group), *cs)
    pairs = count(pair_rows, "a", "b")
    # a triple that is frequent holds only pairs that are frequent themselves
    triples = count(pair_rows.select("a", "b", F.explode(after("j")).alias("c")), "a", "b", "c")
    sets = pairs.select(F.array("a", "b").alias("items"), "support").unionAll(triples.select(F.array("a", "b", "c").alias("items"), "support"))
    member = sets.select("items", "support", F.explode("items").alias("item")).join(freq, "item")
    top = member.groupBy("items", "support").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "item")).alias("m"))
    return top.select("items", "support", F.col("m.item").alias("max_item"), (-F.col("m.n")).alias("max_val"), (F.col("support") / -F.col("m.n")).alias("confidence")).filter(F.col("confidence") >= confidence)


def ordered_baskets(baskets: DataFrame, min_fp: int = 2) -> DataFrame:
    """(tid, items, total): items by total frequency, most frequent first, ties by item; baskets whose most frequent item is
    under min_fp go; total is the sum of frequencies."""
    freq = item_frequency(baskets)
    rows = baskets.select("tid", F.posexplode("items").alias("pos", "item")).join(freq, "item")
    g = rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "item", "pos"))).alias("x"), F.sum("cnt").alias("total"))
    return g.filter(-F.col("x")[0]["n"] >= min_fp).select("tid", F.transform("x", lambda s: s["item"]).alias("items"), "total")


def prefix_counts(ordered: DataFrame) -> DataFrame:
    """(path, support): each prefix of the ordered baskets and how many share it."""
    return ordered.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda n: F.slice("items", 1, n))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("support"))


def leaf_paths(prefixes: DataFrame) -> DataFrame:
    """Paths that no other path extends."""
    parents = prefixes.filter("size(path) > 1").select(F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    return prefixes.join(parents, "path", "left_anti")


def ancestor_counts(leaves: DataFrame) -> DataFrame:
    """(item, ancestor, paths): in how many root-to-leaf paths the ancestor stands before the item."""
    at = leaves.select("path", F.posexplode("path").alias("i", "item")).filter("i > 0")
    return at.select("item", F.explode(F.array_distinct(F.slice("path", 1, F.col("i")))).alias("ancestor")).groupBy("item", "ancestor").agg(F.count(F.lit(1)).alias("paths"))


def frequent_sets(baskets: DataFrame, min_support: float = 0.05, min_confidence: float = 0.5):
    """Item sets and rules of FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets.select(F.array_distinct("items").alias("items")))
    return model.freqItemsets, model.associationRules


def encode_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, relation, tail) to entity(id, name) and relation(start_id, name, end_id); ids follow the names' order."""
    names = triples.select(F.col("head").alias("name")).unionAll(triples.select(F.col("tail").alias("name"))).distinct().persist()
    entity = numbered_by_text(names, F.col("name"), "id").withColumn("id", (F.col("id") + 1).cast("int"))
    start, end = entity.select(F.col("name").alias("head"), F.col("id").alias("start_id")), entity.select(F.col("name").alias("tail"), F.col("id").alias("end_id"))
    return entity.select("id", "name"), triples.join(start, "head").join(end, "tail").select("start_id", F.col("relation").alias("name"), "end_id")


def neighbours(relation: DataFrame) -> DataFrame:
    """(id, other, name) of an undirected pattern: both directions of each relation."""
    return relation.select(F.col("start_id").alias("id"), F.col("end_id").alias("other"), "name").unionAll(relation.select(F.col("end_id").alias("id"), F.col("start_id").alias("other"), "name"))
