"""URL filters: association rules mined from labelled URLs, beside a list of host and path rules.

A label belongs to a document, and a URL names its document by the number in its path, so labels reach URLs by that number
(url_number; another column may be given). FP-growth (pyspark.ml) mines combinations of URL tokens together with the label item on
three quarters of the labelled URLs. Rules whose consequent is the label are pruned by support and by confidence, bounded
relative to the share of bad URLs (`min_lift` times it), and must hold on the other quarter: `min_held` URLs at least, bad more
often than the quarter is. A rule whose tokens contain another kept rule's is pruned. A URL that a rule fits is blocked.
Matching goes through an inverted index: each rule is posted under the token that fewest rules use, URLs look up their tokens,
and the few rules found are checked for containment of all their tokens.

Cases: null URLs, and URLs without "://", have an empty host and path, no rule and no tokens (verdict allow, unless a
list rule fits, which needs a host); repeated rows each give a row; of rules that fit one URL the most confident is told, of
equal ones that whose text is last; very long URLs have all their tokens; empty tables give no rows; no labelled rows, or none that is
bad, give no mined rules; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage

#: (verdict, host, path) - a rule fits the host and its subdomains where the URL's path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. The list is part of the query, so it is bounded."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, the host and its parent domains, path segments (numbers by length), file ending, query keys."""
    host, path = host_of(url), path_of(url)
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "9")))
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.regexp_extract(s, "^([^=]*)", 1)))
    marks = F.filter(F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.when(url.contains("#"), F.lit("f:"))), lambda x: x.isNotNull())
    return F.when(url.isNull() | (host == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(marks, tails, segments, keys)))


def url_number(url: Column) -> Column:
    """The first path segment that is a number, an ending aside; null if there is none."""
    return F.nullif(F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?(?:/|$)", 1), F.lit("")).cast("long")


def _fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (.., tokens). One row for each URL and rule that fits it: the URL's columns, rule_id, rule_tokens, confidence."""
    spread = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    freq = spread.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = spread.join(freq, "token").groupBy("rule_id").agg(F.min(F.struct("uses", "token")).alias("rare"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence")).select(F.col("rare.token").alias("token"), "rule_id", "rule_tokens", "confidence")
    return urls.withColumn("token", F.explode("tokens")).join(small_side(index, "index", parts=4), "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).drop("token")


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_lift: float = 1.2, min_count: int = 15, min_held: int = 5) -> DataFrame:
    """labelled: (tokens array<string>, bad boolean, held boolean). Returns rule_id, tokens (sorted), confidence and support
    (of tokens and label) among rows not held, held_confidence. A rule needs `min_support` of the rows and `min_count` bad rows."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = stage(labelled.filter("size(tokens) > 0").select("tokens", F.coalesce("bad", F.lit(False)).alias("bad"), "held"), "labelled")
    n, share, held_share = rows.agg(F.count_if(~F.col("held")), F.avg(F.when(~F.col("held"), F.col("bad").cast("double"))), F.avg(F.when(F.col("held"), F.col("bad").cast("double")))).first()
    if not share or held_share is None:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, held_confidence double")
    items = rows.filter("not held").select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min(1.0, min_lift * share), numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(items)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = stage(rules.withColumn("rule_id", F.xxhash64("tokens")), "rules")
    told = _fitting(rows.filter("held").select("tokens", "bad"), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("bad").cast("double")).alias("held_confidence"))
    rules = small_side(rules.join(told.filter((F.col("n") >= min_held) & (F.col("held_confidence") > held_share)), "rule_id").drop("n"), "held", parts=4)
    inside = rules.select(F.col("tokens").alias("inner_tokens"))
    pairs = rules.select("tokens", F.explode("tokens").alias("t")).join(inside.select("inner_tokens", F.col("inner_tokens")[0].alias("t")), "t")
    wider = pairs.filter((F.size("inner_tokens") < F.size("tokens")) & (F.size(F.array_except("inner_tokens", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(wider, "tokens", "left_anti").select("rule_id", "tokens", "confidence", "support", "held_confidence")


def match_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """urls: (key, tokens). Returns one row per key that a rule fits, with the most confident rule's tokens."""
    found = _fitting(urls.select(key, "tokens"), rules)
    return found.groupBy(key).agg(F.max(F.struct("confidence", F.array_join("rule_tokens", " ").alias("text"))).alias("best")).select(key, F.col("best.text").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def labelled_urls(urls: DataFrame, labels: DataFrame, number: Column) -> DataFrame:
    """(tokens, bad, held): URLs whose number is a labelled doc_id; copies of a URL are held out together."""
    bad = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("number")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return urls.withColumn("number", number).join(bad, "number").select(url_tokens(F.col("url")).alias("tokens"), "bad", (F.pmod(F.xxhash64("url"), F.lit(4)) == 0).alias("held"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, number: Column | None = None, **bounds) -> DataFrame:
    """pages: page_id, url. labels: doc_id, quality, toxic; a URL is bad if quality is 0 or toxic is 1. bounds: of mine_rules.

    Returns page_id, host, path, rule, verdict, mined_rule, mined_confidence; mined rules decide where no listed rule fits."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    mined = mine_rules(labelled_urls(urls, labels, url_number(F.col("url")) if number is None else number), **bounds)
    found = match_rules(urls.filter("url is not null").select("url", url_tokens(F.col("url")).alias("tokens")).distinct(), mined, "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = urls.join(found, "url", "left").withColumns({"host": host, "path": path})
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", "mined_confidence")
