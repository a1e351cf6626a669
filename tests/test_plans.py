"""Plans: no Python on paths of built-in functions, pushed filters, pruned columns, broadcasts only of small sides."""

import pytest
from pyspark.sql import functions as F

from tarnwood.operators import profile, sampling
from tarnwood.plans import texts
from tarnwood.session import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["profile_lineitem", "outlier_batch", "impute_window_mean", "trend_score", "gap_ratio", "local_extrema", "word_count", "bm25_scores", "encode_docs", "apriori_pairs_triples", "fp_prefix_counts", "knn_exact", "mutual_info", "rough_importance"])
def test_no_python(spark, name):
    assert not any(x in plan(texts.QUERIES[name](spark, SF)) for x in ("Python", "Pandas", "Arrow"))


def test_columns_are_pruned(spark):
    p = plan(profile.profile(table(spark, SF, "lineitem"), ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in p


def test_filters_are_pushed(spark):
    p = plan(table(spark, SF, "lineitem").filter("l_quantity > 40").select("l_tax"))
    assert "GreaterThan(l_quantity,40.0)" in p


def test_group_limit(spark):
    assert "WindowGroupLimit" in plan(sampling.first_per_class(table(spark, SF, "events"), "event_type", ["event_id"], 5))


def test_lookup_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(texts.QUERIES["lookup_join"](spark, SF))


def test_one_scan_for_a_batch_of_rules(spark):
    assert plan(texts.QUERIES["outlier_batch"](spark, SF)).count("FileScan") == 1


def test_events_time_is_kept(spark):
    assert dict(table(spark, SF, "events").dtypes)["ts"] == "timestamp_ntz"
    assert table(spark, SF, "events").select(F.max("ts")).first()[0] is not None
