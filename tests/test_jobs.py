"""Jobs end to end on a CSV written from the pages table, plus S6-S8 and T2."""

import tempfile

from pyspark.sql import functions as F

from tidewatch.plans import jobs
from tidewatch.sources import io
from tidewatch.sources.tables import page_url, url_table

from conftest import SF01


def test_jobs_chain(spark):
    work = tempfile.mkdtemp(prefix="tw-jobs-", dir="/tmp")
    io.write_csv(url_table(spark, SF01).select("url", "type"), f"{work}/raw")
    r = jobs.feature_job(spark, f"{work}/raw", f"{work}/features")
    assert r["rows"] == 250 and r["features"] == 40
    leg = jobs.legacy_job(spark, f"{work}/features", f"{work}/graph_features")
    assert leg["rows"] == 250
    jobs.lexical_job(spark, f"{work}/features", f"{work}/lexical_model")
    doc = jobs.fusion_job(spark, f"{work}/graph_features", f"{work}/lexical_model", f"{work}/hybrid", alpha=None)
    assert [a["alpha"] for a in doc["alpha_tested"]] == [0.3, 0.5, 0.7]
    assert sum(map(sum, doc["test_confusion_matrix"])) > 0
    ev = jobs.evaluation_job(spark, f"{work}/graph_features", f"{work}/lexical_model", f"{work}/reports")
    assert ev["dataset_size"] == 250 and "timestamp" in ev
    imp = spark.read.option("header", True).csv(f"{work}/reports/feature_importance")
    assert imp.count() == 40
    auc = spark.read.json(f"{work}/reports/auc_lexical")
    assert auc.count() == 4
    rep = spark.read.json(f"{work}/reports/classification_report")
    assert {r.model for r in rep.select("model").distinct().collect()} == {"lexical", "graph", "hybrid"}
    splits = [{(r.url, r.split) for r in spark.read.parquet(f"{work}/{t}").select("url", "split").collect()}
              for t in ("features", "graph_features")]
    assert splits[0] == splits[1]
    g = jobs.graph_job(spark, f"{work}/features", f"{work}/gnn_features", max_iter=10)
    assert g["val_log_loss"] > 0
    out = spark.read.parquet(f"{work}/gnn_features")
    s = out.select(sum(F.col(f"domain_class_{i}_prob") for i in range(4)).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in s)


def test_stage_reuse(spark):
    work = tempfile.mkdtemp(prefix="tw-stage-", dir="/tmp")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    a = io.stage(spark, f"{work}/s", build)
    b = io.stage(spark, f"{work}/s", build)
    assert a.count() == b.count() == 5 and len(calls) == 1


def test_stage_of_changed_inputs_is_made_anew(spark):
    work = tempfile.mkdtemp(prefix="tw-stage-", dir="/tmp")
    source, stage = f"{work}/in", f"{work}/s"

    def build():
        return spark.read.parquet(source).selectExpr("id * 2 AS twice")

    def never():
        raise AssertionError("made again from the same inputs")
    for n in (3, 7):
        spark.range(n).write.mode("overwrite").parquet(source)
        assert io.stage(spark, stage, build, inputs=[source]).count() == n
        assert io.stage(spark, stage, never, inputs=[source]).count() == n
    io._write_made_from(spark, stage, "")  # as a driver lost while writing leaves it
    assert io.stage(spark, stage, build, inputs=[source]).count() == 7
    io.stage(spark, f"{work}/old", lambda: spark.range(2))  # a stage of unknown inputs
    assert io.stage(spark, f"{work}/old", build, inputs=[source]).count() == 7


def test_engines_roundtrip_and_foreach_batch(spark):
    from tidewatch.catalog.model_q import engines
    from tidewatch.plans.scoring import load_engines, save_engines, score
    from tidewatch.streaming.score_stream import foreach_batch_score, url_stream
    from conftest import SF001
    eng = engines(spark, SF001)
    path = tempfile.mkdtemp(prefix="tw-eng-", dir="/tmp")
    save_engines(eng, path)
    eng2 = load_engines(spark, path)
    urls = url_table(spark, SF001).select("page_id", "url")
    a = {r.page_id: r.predicted_class for r in score(urls, eng).collect()}
    b = {r.page_id: r.predicted_class for r in score(urls, eng2).collect()}
    assert a == b
    out = tempfile.mkdtemp(prefix="tw-fb-", dir="/tmp")
    src = url_stream(spark, SF001, "page_id bigint, url string, html string", file_glob="pages.parquet")
    foreach_batch_score(src.select("page_id", page_url().alias("url")), eng2, out, tempfile.mkdtemp(prefix="tw-ck-", dir="/tmp"))
    c = {r.page_id: r.predicted_class for r in spark.read.parquet(out).collect()}
    assert c == a


def test_stream_over_several_microbatches(spark):
    """T1 with three input files read one per trigger equals batch scoring."""
    from tidewatch.catalog.model_q import engines
    from tidewatch.plans.scoring import score
    from tidewatch.streaming.score_stream import run_stream_score, url_stream
    from conftest import SF001
    src_dir = tempfile.mkdtemp(prefix="tw-src-", dir="/tmp")
    urls = url_table(spark, SF001).select("page_id", "url")
    urls.repartition(3).write.mode("overwrite").parquet(src_dir)
    eng = engines(spark, SF001)
    out = run_stream_score(url_stream(spark, src_dir, "page_id bigint, url string", max_files=1), eng,
                           tempfile.mkdtemp(prefix="tw-out-", dir="/tmp"), tempfile.mkdtemp(prefix="tw-ck-", dir="/tmp"))
    s = {r.page_id: (r.predicted_class, round(r.confidence_score, 9)) for r in spark.read.parquet(out).collect()}
    b = {r.page_id: (r.predicted_class, round(r.confidence_score, 9)) for r in score(urls, eng).collect()}
    assert s == b and len(s) == urls.count()


def test_invalid_url_keeps_its_row(spark):
    from tidewatch.catalog.model_q import engines
    from tidewatch.plans.scoring import score
    from conftest import SF001
    df = spark.createDataFrame([(1, "http://a.example.com/x"), (2, "   "), (3, "https://www.google.com/q")],
                               "req_id int, url string")
    out = {r.req_id: r for r in score(df, engines(spark, SF001)).collect()}
    assert out[2].status == "invalid" and out[2].predicted_class is None
    assert out[1].status == "ok" and out[1].predicted_class is not None
    assert out[3].is_allowed and out[3].predicted_class == "benign"


def test_raw_csv_missing_values_and_multiline(spark):
    """Quoted multi-line fields survive; pandas-style missing markers are NULL and C3 drops them."""
    from tidewatch.operators import clean
    d = tempfile.mkdtemp(prefix="tw-csv-", dir="/tmp")
    with open(f"{d}/raw.csv", "w") as f:
        f.write('url,type\n"http://a.com/x,y",benign\nNA,phishing\nnull,benign\n"http://b.com/""q""",malware\n'
                '"http://c.com/multi\nline",defacement\nhttp://d.com,NaN\n')
    raw = io.read_raw_csv(spark, f"{d}/raw.csv", multi_line=True)
    rows = raw.collect()
    assert len(rows) == 6
    assert rows[0].url == "http://a.com/x,y" and rows[1].url is None and rows[2].url is None
    assert rows[3].url == 'http://b.com/"q"' and rows[4].url == "http://c.com/multi\nline"
    kept = clean.encode_target(clean.validate_and_clean(raw)).collect()
    assert sorted(r.url for r in kept) == ["http://a.com/x,y", 'http://b.com/"q"', "http://c.com/multi\nline"]


def test_all_job_and_skip_prep(spark):
    work = tempfile.mkdtemp(prefix="tw-all-", dir="/tmp")
    io.write_csv(url_table(spark, SF01).select("url", "type"), f"{work}/raw")
    a = jobs.all_job(spark, f"{work}/raw", f"{work}/out", mode="legacy")
    b = jobs.all_job(spark, f"{work}/raw", f"{work}/out", mode="legacy", skip_prep=True)
    assert a == b and a["best_alpha"] == 0.7
