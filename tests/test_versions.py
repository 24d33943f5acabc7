"""Kept tables: sums and ids over batches, repeated epochs, writers in each other's way."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph as GR
from tidewatch.operators.versions import Conflict, KeyDictionary, KeyedSums, VersionLog
from tidewatch.streaming import score_stream as S


def folder():
    return tempfile.mkdtemp(prefix="tw-kept-", dir="/tmp")


def rows(n, seed, hot=0.4):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.05 else "hot" if rng.random() < hot else f"k{rng.randrange(40)}", float(rng.randrange(100)),
             rng.choice([None, 1.0, 2.5])) for _ in range(n)]


SCHEMA = "registered_domain string, a double, b double"


def test_sums_over_batches_equal_one_pass_and_repeats_change_nothing(spark):
    table = KeyedSums(spark, folder(), "registered_domain", ["a", "b"], buckets=8)
    batches = [spark.createDataFrame(rows(300, i), SCHEMA) for i in range(3)]
    assert [table.merge(b, e) for e, b in enumerate(batches)] == [True] * 3
    assert table.merge(batches[2], 2) is False and table.merge(batches[0], 0) is False
    whole = GR.domain_profile(batches[0].unionByName(batches[1]).unionByName(batches[2]), ["a", "b"])
    cols = ["registered_domain", "dom_n", "dom_sum_a", "dom_sum_b", "dom_a"]
    listed = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert listed(table.profile()) == listed(whole)
    assert table.merge(spark.createDataFrame([], SCHEMA), 3) is True
    assert listed(table.profile()) == listed(whole)


def test_only_touched_buckets_are_written_again(spark):
    table = KeyedSums(spark, folder(), "registered_domain", ["a"], buckets=16)
    table.merge(spark.createDataFrame([(f"k{i}", 1.0) for i in range(200)], "registered_domain string, a double"), 0)
    before = set(table.log.last()[1]["folders"])
    table.merge(spark.createDataFrame([("k7", 5.0)], "registered_domain string, a double"), 1)
    after = set(table.log.last()[1]["folders"])
    assert len(before) == len(after) == 16 and len(after - before) == 1
    assert table.read().filter("registered_domain = 'k7'").first()["sum_a"] == 6.0
    assert table.log.forget(keep=1) == 1
    assert table.read().agg(F.sum("n")).first()[0] == 201


def test_a_batch_that_failed_before_its_entry_is_not_seen(spark, monkeypatch):
    table = KeyedSums(spark, folder(), "registered_domain", ["a", "b"], buckets=4)
    batch = spark.createDataFrame(rows(100, 1), SCHEMA)

    def lost(*_):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(VersionLog, "commit", lost)
        with pytest.raises(RuntimeError):
            table.merge(batch, 0)
    assert table.read().count() == 0
    assert table.merge(batch, 0) and table.read().agg(F.sum("n")).first()[0] == 100


def test_a_stream_keeps_sums_and_a_restart_counts_once(spark):
    src, ckpt = folder(), folder()
    spark.createDataFrame(rows(400, 9), SCHEMA).repartition(5).write.mode("overwrite").parquet(src)
    table = KeyedSums(spark, folder(), "registered_domain", ["a", "b"], buckets=4)
    stream = lambda: S.url_stream(spark, src, SCHEMA, max_files=2)
    S.finish(S.keep_sums(stream(), table, ckpt))
    assert table.log.last()[0] == 2  # three micro-batches
    S.finish(S.keep_sums(stream(), table, ckpt))
    S.finish(S.keep_sums(stream(), table, folder()))  # a lost checkpoint repeats the epochs
    assert table.read().agg(F.sum("n")).first()[0] == 400


def test_ids_stay_and_new_keys_follow_without_gaps(spark):
    d = KeyDictionary(spark, folder(), "k", buckets=4)
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "k string")
    assert d.add(keys("b", "a", "b", None)) == 2
    first = {r["k"]: r["id"] for r in d.read().collect()}
    assert first == {"a": 0, "b": 1}
    assert d.add(keys("c", "a", "Z", "b"), epoch=0) == 2 and d.add(keys("new"), epoch=0) == 0
    assert d.add(keys("a")) == 0
    second = {r["k"]: r["id"] for r in d.read().collect()}
    assert first.items() <= second.items() and sorted(second.values()) == [0, 1, 2, 3]
    d.compact()
    assert {r["k"]: r["id"] for r in d.read().collect()} == second
    assert d.add(spark.range(500).select(F.concat(F.lit("n"), "id").alias("k"))) == 500
    assert sorted(r["id"] for r in d.read().collect()) == list(range(504))


def test_two_writers_of_one_version_never_share_an_id(spark):
    root = folder()
    one, two = KeyDictionary(spark, root, "k", buckets=4), KeyDictionary(spark, root, "k", buckets=4)
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "k string").withColumn("_b", one.bucket())
    number, entry = two.log.last()
    one.add(keys("a", "b"))
    with pytest.raises(Conflict):  # it started from the version before
        two._add(keys("b", "c"), number, entry, None)
    assert two.read().count() == 2
    assert two.add(keys("b", "c")) == 1  # and repeats from the new one
    assert sorted((r["k"], r["id"]) for r in one.read().collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_a_repeated_run_leaves_one_record(spark):
    from tidewatch.plans.reports import append_runs, latest_runs, run_table
    path = folder() + "/runs"
    rec = lambda *f1: spark.createDataFrame([(m, f) for m, f in zip(("lexical", "hybrid"), f1)], "model string, macro_f1 double")
    append_runs(rec(0.1, 0.2), path, "01", "2026-01-01 10:00:00")
    append_runs(rec(0.3, 0.4), path, "02", "2026-01-02 10:00:00")
    append_runs(rec(0.5, 0.6), path, "02", "2026-01-02 11:00:00")
    append_runs(rec(0.7), path, "1", "2026-01-02 11:00:00")
    assert sorted((r["run_id"], r["model"], r["macro_f1"]) for r in run_table(spark, path).collect()) == [
        ("01", "hybrid", 0.2), ("01", "lexical", 0.1), ("02", "hybrid", 0.6), ("02", "lexical", 0.5), ("1", "lexical", 0.7)]
    assert sorted((r["model"], r["run_id"]) for r in latest_runs(spark, path).collect()) == [("hybrid", "02"), ("lexical", "1")]
