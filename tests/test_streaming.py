"""Streams deliver every row once: after a time-out, a failure and a restart."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import score_stream as S


def folders():
    return [tempfile.mkdtemp(prefix="tw-stream-", dir="/tmp") for _ in range(3)]


def many_files(spark, path, files=24, rows=1200):
    spark.range(rows).withColumn("url", F.concat(F.lit("http://a.com/"), "id")).repartition(files).write.mode(
        "overwrite").parquet(path)


@pytest.mark.parametrize("form", ["rows", "batches"])
def test_a_time_out_raises_and_a_restart_delivers_the_rest_once(spark, form):
    src, out, ckpt = folders()
    many_files(spark, src)
    start = S.stream_into if form == "rows" else S.stream_batches_into
    stream = lambda: S.url_stream(spark, src, "id bigint, url string", max_files=1)
    plain = lambda df: df.withColumn("n", F.length("url"))
    with pytest.raises(TimeoutError):
        S.finish(start(stream(), plain, out, ckpt), timeout_s=1)
    S.finish(start(stream(), plain, out, ckpt))
    ids = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(1200))


def test_a_stopped_stream_goes_on_with_new_files(spark):
    src, out, ckpt = folders()
    many_files(spark, src, 3, 100)
    S.finish(S.stream_into(S.url_stream(spark, src, "id bigint, url string"), lambda d: d, out, ckpt))
    spark.range(100, 150).withColumn("url", F.lit("u")).write.mode("append").parquet(src)
    S.finish(S.stream_into(S.url_stream(spark, src, "id bigint, url string"), lambda d: d, out, ckpt))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(150))


@pytest.mark.parametrize("form", ["rows", "batches"])
def test_failures_are_raised(spark, form):
    src, out, ckpt = folders()
    many_files(spark, src, 2, 10)
    start = S.stream_into if form == "rows" else S.stream_batches_into
    bad = lambda df: df.withColumn("n", F.raise_error(F.lit("broken row")).cast("int"))
    with pytest.raises(Exception, match="broken row"):
        S.finish(start(S.url_stream(spark, src, "id bigint, url string"), bad, out, ckpt))


@pytest.mark.parametrize("form", ["file", "folder"])
@pytest.mark.parametrize("name", ["score_stream", "score_batches"])
def test_pages_stream_from_one_file_or_a_folder(spark, name, form):
    import os
    import shutil

    from tidewatch import catalog
    catalog.load_all()
    from conftest import SF001
    src = tempfile.mkdtemp(prefix="tw-pages-", dir="/tmp")
    if form == "folder":
        spark.read.parquet(f"{SF001}/pages.parquet").repartition(3).write.parquet(f"{src}/pages.parquet")
        assert os.path.isdir(f"{src}/pages.parquet")
    else:
        shutil.copyfile(f"{SF001}/pages.parquet", f"{src}/pages.parquet")
    got = sorted(catalog.QUERIES[name](spark, src).collect())
    assert got == sorted(catalog.QUERIES["score_batch"](spark, src).collect()) and len(got) == 50


def test_the_trained_engines_score_a_stream_of_a_folder_of_pages(spark):
    from tidewatch import catalog
    catalog.load_all()
    from conftest import SF001
    src = tempfile.mkdtemp(prefix="tw-pages-", dir="/tmp")
    spark.read.parquet(f"{SF001}/pages.parquet").repartition(3).write.parquet(f"{src}/pages.parquet")
    got = {r.page_id: r for r in catalog.QUERIES["score_stream_model"](spark, src).collect()}
    batch = {r.page_id: r for r in catalog.QUERIES["score_batch_model"](spark, src).collect()}
    assert got.keys() == batch.keys() and len(got) == 50
    for k, b in batch.items():
        assert got[k].predicted_class == b.predicted_class and got[k].p_0 == pytest.approx(b.p_0, abs=1e-8)
