"""Properties that hold at scale: skew by the joined rows, pooled ROC, whole inputs, every branch reached."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewatch.constants import FEATURE_COLS
from tidewatch.functions.lexical import feature_columns
from tidewatch.operators import graph as GR
from tidewatch.operators import guard as G
from tidewatch.operators import metrics as M
from tidewatch.operators.skew import skew_safe_left_join, skew_safe_semi_join
from tidewatch.operators.suffix import with_registered_domain
from tidewatch.sources import io
from tidewatch.sources.tables import url_table

from conftest import SF01


@pytest.fixture
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def half_on(spark, key):
    return spark.range(16000).select("id", F.when(F.col("id") % 2 == 0, F.lit(key)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("key"))


@pytest.mark.parametrize("join", ["left", "semi"])
def test_a_hot_key_the_statistics_do_not_know_is_spread(no_aqe, join):
    spark = no_aqe
    big = half_on(spark, "new.example")
    stats = spark.range(997).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("n"))
    if join == "left":
        out = skew_safe_left_join(big, stats, "key", "n", F.xxhash64("id"))
        assert out.filter("key = 'new.example' AND n IS NULL").count() == 8000 and out.count() == 16000
    else:
        out = skew_safe_semi_join(big, stats, "key", F.xxhash64("id"))
        assert out.count() == 8000
        out = skew_safe_left_join(big, stats, "key", None, F.xxhash64("id"))
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) >= 8


def test_an_unseen_hot_key_is_unseen(spark):
    big = half_on(spark, "new.example")
    known = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    out = G.flag_unseen(big, "key", known)
    assert out.filter("key = 'new.example' AND NOT is_unseen").count() == 0
    assert out.filter("is_unseen").count() == big.join(known, "key", "left_anti").count()


def test_suffixes_of_wildcard_rules_are_not_broadcast(no_aqe):
    df = no_aqe.range(40).select("id", F.concat(F.lit("d"), "id", F.lit(".t"), F.col("id") % 20).alias("registered_domain"),
                                 F.concat(F.lit("t"), F.col("id") % 20).alias("tld"), F.col("id").cast("double").alias("x"))
    out = GR.propagate(df, ["x"], spread=F.xxhash64("id"))
    assert out.filter("tld_x IS NULL OR dom_x IS NULL").count() == 0


@pytest.mark.parametrize("ties", [1, 3, 50])
def test_pooled_roc_and_auc_equal_one_versus_rest(spark, ties):
    df = spark.range(600).select((F.col("id") * 7919 % 601).alias("r"), F.concat(F.lit("c"), F.col("id") * 31 % 7 % 4).alias("cls"))
    df = df.select("cls", F.floor(F.col("r") / ties).cast("double").alias("score"))
    classes = df.select(F.col("cls").alias("k")).distinct()
    ovr = df.crossJoin(classes).select(F.col("k").alias("cls"), "score", (F.col("cls") == F.col("k")).alias("is_pos"))
    norm = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert norm(M.auc_by_class(df, "cls", "score")) == norm(M.auc(ovr))
    assert norm(M.roc_by_class(df, "cls", "score")) == norm(M.roc_points(ovr))


def test_roc_of_nothing(spark):
    none = spark.createDataFrame([], "cls string, score double, is_pos boolean")
    for out in (M.auc(none), M.roc_points(none), M.auc_by_class(none, "cls", "score"), M.roc_by_class(none, "cls", "score")):
        assert out.count() == 0


def test_pooled_roc_has_no_product_of_rows_and_classes(no_aqe):
    plan = M.auc_by_class(half_on(no_aqe, "x").withColumn("s", F.col("id") % 50), "key", "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") <= 1  # the one-row total


def test_every_feature_and_rule_varies(spark):
    u = url_table(spark, SF01)
    f = u.select(*feature_columns("url"))
    one = f.agg(*[F.count_distinct(c).alias(c) for c in FEATURE_COLS]).first()
    assert [c for c in FEATURE_COLS if one[c] < 2] == []
    q = E.queries()
    rules = {r.guard_rule for r in q["guard_rules"](spark, SF01).select("guard_rule").distinct().collect()}
    assert rules == {None, "malware", "phishing"}
    assert q["allowlist_split"](spark, SF01).select("is_allowed").distinct().count() == 2
    assert q["zero_day_flag"](spark, SF01).select("is_unseen").distinct().count() == 2
    assert q["reputation_legacy"](spark, SF01).filter("domain_frequency = 0").count() > 0
    cold = q["cold_start_serving"](spark, SF01)
    assert cold.filter("domain_unseen").count() and cold.filter("NOT domain_unseen").count()


def test_hosts_with_a_final_dot_and_octets(spark):
    rows = [("http://example.com./a", "example.com", "com"), ("http://999.999.999.999/a", "999.", ""),
            ("http://192.168.0.1:80/", "192.168.0.1.", ""), ("http://a.foo.ck/", "a.foo.ck", "foo.ck")]
    got = with_registered_domain(spark.createDataFrame([(r[0],) for r in rows], "url string")).collect()
    by = {r.url: (r.registered_domain, r.tld) for r in got}
    assert by == {r[0]: r[1:] for r in rows}  # domain and suffix are joined by a dot, also where one is empty


def test_csv_keeps_blanks(spark, tmp_path):
    io.write_csv(spark.createDataFrame([("  http://a.com/x  ", "benign")], "url string, type string"), f"{tmp_path}/c")
    assert io.read_raw_csv(spark, f"{tmp_path}/c").first().url == "  http://a.com/x  "


def test_score_covers_every_url_in_one_pass(spark):
    from tidewatch.catalog.model_q import engines
    from tidewatch.plans.scoring import score
    urls = url_table(spark, SF01).select("page_id", "url")
    out = score(urls, engines(spark, SF01), classes=True)
    assert out.count() == urls.count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
    r = out.filter("predicted_class IS NOT NULL").first()
    assert max(r.class_probabilities.values()) * 100 == pytest.approx(r.confidence_score)
    assert r.class_probabilities[r.predicted_class] == max(r.class_probabilities.values())
