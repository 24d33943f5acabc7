"""Raw records with their fate, and distinct counts that merge."""

import tempfile

from pyspark.sql import functions as F

from tidewatch.operators import clean, sketches as K
from tidewatch.plans.scoring import refreshed
from tidewatch.operators.versions import KeyedSums
from tidewatch.sources import io


def folder():
    return tempfile.mkdtemp(prefix="tw-in-", dir="/tmp") + "/t"


LINES = ["url,type", "http://a.com/x,benign", "http://b.com,Phishing ", "http://c.com,benign,one too many", "http://d.com", "http://e.com,NA",
         ',benign', '"  ",malware', "http://f.com,spam", '"http://g.com/?a=1,2",DEFACEMENT', "http://a.com/x,benign"]


def test_every_record_is_kept_or_told(spark):
    raw, out = folder(), folder()
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(raw)
    counts = io.ingest_csv(spark, raw, out)
    assert counts == {"kept": 4, "malformed": 2, "missing": 2, "blank": 1, "unknown_class": 1}
    kept = sorted(map(tuple, io.read_ingested(spark, out).collect()))
    assert kept == [("http://a.com/x", "benign"), ("http://a.com/x", "benign"), ("http://b.com", "Phishing "), ("http://g.com/?a=1,2", "DEFACEMENT")]
    gone = {r["record"]: r["status"] for r in io.read_ingested(spark, out, rejected=True).collect()}
    assert gone["http://c.com,benign,one too many"] == "malformed" and gone["http://d.com"] == "malformed"
    assert gone["http://f.com,spam"] == "unknown_class" and len(gone) == 6
    # what is kept is what the cleaning steps keep of the plain read
    plain = clean.encode_target(clean.validate_and_clean(io.read_raw_csv(spark, raw)))
    whole = plain.filter(~F.col("url").isin("http://c.com"))
    assert sorted(r["url"] for r in whole.collect()) == sorted(u for u, _ in kept)


def test_an_empty_file_and_only_rejects(spark):
    for lines, want in ((["url,type"], 0), (["url,type", "x", "y"], 2)):
        raw, out = folder(), folder()
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(raw)
        counts = io.ingest_csv(spark, raw, out)
        assert counts["malformed"] == want and sum(counts.values()) == want


def test_stored_sketches_unite_to_the_whole(spark):
    df = spark.range(60000).select((F.col("id") % 3).alias("g"), (F.col("id") % 4).alias("part"),
                                   F.when(F.col("id") % 10 > 0, F.col("id") % 20011).cast("string").alias("k"))
    stored = K.distinct_sketches(df, "k", ["g", "part"])
    by = {r["g"]: r["n_distinct"] for r in K.estimates(K.united(stored, ["g"])).collect()}
    exact = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.countDistinct("k").alias("n")).collect()}
    assert by.keys() == exact.keys() and all(abs(by[g] - n) <= 4 * K.ERROR * n for g, n in exact.items())
    one = K.estimates(K.united(K.distinct_sketches(df, "k", ["g"]))).first()
    whole = K.estimates(K.united(stored)).first()
    assert whole["n_rows"] == one["n_rows"] == 60000 and whole["n_distinct"] == one["n_distinct"]
    n = df.select(F.countDistinct("k")).first()[0]
    assert abs(whole["n_distinct"] - n) <= 4 * K.ERROR * n


def test_engines_take_a_kept_profile(spark):
    """Scoring with the kept table gives what the profile made in one pass gives."""
    from tidewatch.catalog.model_q import engines
    from tidewatch.constants import FEATURE_COLS
    from tidewatch.plans.prepare import labelled_urls
    from tidewatch.plans.scoring import graph_probs_cold, with_features
    from tidewatch.operators.suffix import with_registered_domain
    from conftest import SF001
    eng, u = engines(spark, SF001), labelled_urls(spark, SF001)
    lf = with_features(u, normalise=True).select("page_id", "registered_domain", *FEATURE_COLS)
    table = KeyedSums(spark, folder(), "registered_domain", FEATURE_COLS, buckets=4)
    for i in range(2):
        table.merge(lf.filter(F.col("page_id") % 2 == i), i)
    urls = with_features(with_registered_domain(u.select("page_id", "url")), normalise=True)
    a, b = ({r["page_id"]: r["p_graph"] for r in graph_probs_cold(urls, e, ["page_id", "url"]).collect()}
            for e in (eng, refreshed(eng, table)))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))
