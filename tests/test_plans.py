"""Plan-shape tests: the properties that matter at scale, checked on the
physical plan Spark commits to when every unhinted table is large (AQE off,
automatic broadcast off)."""

import re

import pytest

import __spark_entry__ as E

from conftest import SF001


@pytest.fixture(scope="module")
def static_spark(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _plan(spark, name):
    return E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_flagship_one_shuffle_and_pruned_scan(static_spark):
    p = _plan(static_spark, "features_by_class")
    assert p.count("Exchange hashpartitioning") == 1
    assert "html" not in re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert "partial_avg" in p  # map-side combine before the shuffle


def test_suffix_resolution_never_shuffles_rows(static_spark):
    p = _plan(static_spark, "suffix_domain")
    assert "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p
    assert p.count("BroadcastHashJoin") >= 4


def test_top_k_per_group_limits_before_shuffle(static_spark):
    p = _plan(static_spark, "head_per_group")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_split_labels_rows_without_shuffling_them(static_spark):
    p = _plan(static_spark, "strat_split")
    assert "Exchange hashpartitioning" not in p and "Window" not in p


def test_reputation_lookup_is_skew_safe(static_spark):
    p = _plan(static_spark, "reputation_fallback")
    # cold keys: shuffle join on the spread key; hot keys: broadcast
    assert re.search(r"SortMergeJoin \[_jk#\d+\], \[_ck#\d+\], LeftOuter", p)
    assert "BroadcastHashJoin" in p


def test_split_filters_prune_stage_directories(static_spark):
    p = _plan(static_spark, "alpha_search")
    assert re.search(r"PartitionFilters: \[[^\]]*split#\d+ = val", p)


def test_roc_has_no_whole_class_window(static_spark):
    p = _plan(static_spark, "auc")
    # the prefix-sum window over scores is partitioned by (class, bucket)
    assert re.search(r"windowspecdefinition\(cls#\d+, _bk#\d+, score#\d+ DESC", p)


def test_scoring_moves_no_dimension(static_spark):
    """The dimension side of a lookup is read bucketed by its key, without an exchange."""
    p = _plan(static_spark, "score_batch")
    assert "Bucketed: true" in p
    # the URLs, and the fixed allow list's distinct entries ahead of their broadcast
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", p)) == ["page_id", "registered_domain"]


def test_the_engines_dimensions_are_bucketed_too(static_spark):
    from pyspark.sql import functions as F
    from tidewatch.operators.skew import hot_keys_of, skew_safe_left_join
    from tidewatch.session import bucketed_table
    rows = static_spark.range(1000).select("id", F.concat(F.lit("k"), (F.col("id") % 90).cast("string")).alias("k"))
    dim = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain, kept = (skew_safe_left_join(rows, d, "k", "n", F.xxhash64("id"), hot=hot_keys_of(rows, ["k"], 0.5)["k"])
                   for d in (dim, bucketed_table(dim, "dim", "k")))
    p = kept._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in p and "hashpartitioning(_ck" not in p and "hashpartitioning(_jk" in p
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect()))


def test_lookups_that_follow_each_other_do_not_run_twice(static_spark):
    p = _plan(static_spark, "reputation_lineitem")
    assert p.count("Scan parquet") <= 8 and p.count("Join") <= 10
