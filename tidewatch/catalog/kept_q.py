"""Queries over tables that are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import CLASSES, FEATURE_COLS
from ..operators import metrics as M
from ..operators import sketches as K
from ..operators.versions import KeyDictionary, KeyedSums
from ..plans.prepare import labelled_urls
from ..plans.reports import append_runs, latest_runs
from ..session import ensure_checkpoint_dir, materialize
from ..sources import io
from ..sources.tables import DIRTY_SQL, dirty_url_table
from ..streaming.score_stream import finish, keep_sums, url_stream
from . import ORACLE, query, rounded
from .fusion_q import _models
from .graph_q import _lf
from .reputation_q import LABELLED_SQL


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept/{name}-{uuid.uuid4().hex}"


@query("profile_stream", ORACLE["domain_profile"])
def profile_stream(spark, sf_dir):
    """The domain profile kept by a stream of all URLs' features in several micro-batches, one of
    them repeated."""
    files = _folder(spark, "features")
    lf = _lf(spark, sf_dir).select("registered_domain", *FEATURE_COLS)
    lf.repartition(6).write.parquet(files)
    table = KeyedSums(spark, _folder(spark, "profile"), "registered_domain", FEATURE_COLS, buckets=16)
    schema = ", ".join(["registered_domain string", *[f"{c} double" for c in FEATURE_COLS]])
    finish(keep_sums(url_stream(spark, files, schema, max_files=2), table, _folder(spark, "checkpoint")))
    table.merge(lf, epoch=0)  # an epoch that is there already
    t = table.profile()
    return rounded(t.select("registered_domain", "dom_n", *[f"dom_{c}" for c in FEATURE_COLS]), 6)


@query("stable_node_ids", f"""WITH l AS ({LABELLED_SQL}),
a AS (SELECT DISTINCT registered_domain FROM l WHERE split = 'train'),
b AS (SELECT DISTINCT registered_domain FROM l WHERE registered_domain NOT IN (SELECT registered_domain FROM a)),
i AS (SELECT registered_domain, row_number() OVER (ORDER BY registered_domain) - 1 AS id FROM a
      UNION ALL SELECT registered_domain, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY registered_domain) - 1 FROM b)
SELECT page_id, CAST(id AS BIGINT) AS node_id FROM l JOIN i USING (registered_domain)""")
def stable_node_ids(spark, sf_dir):
    """Ids of the domains of the train URLs, kept when those of all URLs are added."""
    u = labelled_urls(spark, sf_dir)
    ids = KeyDictionary(spark, _folder(spark, "ids"), "registered_domain", buckets=16)
    ids.add(u.filter("split = 'train'"), epoch=0)
    ids.add(u, epoch=1)
    ids.add(u, epoch=1)  # a repeated batch
    return u.join(ids.read(), "registered_domain").select("page_id", F.col("id").alias("node_id"))


@query("run_history", f"""SELECT model, CASE WHEN model = 'lexical' THEN 'b' ELSE 'c' END AS run_id,
  accuracy, macro_precision, macro_recall, macro_f1 FROM ({ORACLE['model_compare']})""")
def run_history(spark, sf_dir):
    """Each model's latest record in a run table where one run was written twice."""
    path = _folder(spark, "runs")
    m = M.summary(_models(spark, sf_dir), "target", "pred", ["model"])
    older = m.withColumn("macro_f1", F.lit(0.0)).withColumn("accuracy", F.lit(0.0))
    append_runs(older, path, "a", "2026-01-01 00:00:00")
    append_runs(older, path, "b", "2026-01-02 00:00:00")
    append_runs(m, path, "b", "2026-01-02 00:00:00")  # the run again: it replaces its record
    append_runs(m.filter("model <> 'lexical'"), path, "c", "2026-01-03 00:00:00")
    cols = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]
    return rounded(latest_runs(spark, path).select("model", "run_id", *cols))


_NAMES = ", ".join(f"'{c}'" for c in CLASSES)
_STATUS_SQL = f"""SELECT CASE WHEN page_id % 11 = 7 THEN 'malformed' WHEN url IS NULL OR type IS NULL THEN 'missing'
  WHEN NOT regexp_matches(url, '\\S') THEN 'blank' WHEN lower(trim(type)) NOT IN ({_NAMES}) THEN 'unknown_class' ELSE 'kept' END AS status,
  page_id, url FROM ({DIRTY_SQL})"""


@query("ingest_rejects", f"""WITH s AS ({_STATUS_SQL}), k(status) AS (VALUES {', '.join(f"('{s}')" for s in io.STATUSES)})
SELECT k.status, count(s.status) AS n_observed, count(s.status) AS n_written,
  CAST(coalesce(sum(length(url)) FILTER (s.status = 'kept'), 0) AS BIGINT) AS kept_chars FROM k LEFT JOIN s ON k.status = s.status GROUP BY k.status""")
def ingest_rejects(spark, sf_dir):
    """A dirty CSV of all URLs (some records with a field too many) read once; kept and rejected
    records with the counts observed on the way."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    extra = F.when(F.col("page_id") % 11 == 7, F.lit(",one more")).otherwise(F.lit(""))
    line = F.concat(F.coalesce(quoted("url"), F.lit("")), F.lit(","), F.coalesce(quoted("type"), F.lit("")), extra)
    raw, out = _folder(spark, "raw"), _folder(spark, "ingested")
    dirty_url_table(spark, sf_dir).select(line.alias("value")).write.text(raw)
    counts = io.ingest_csv(spark, raw, out, header=False)
    seen = spark.createDataFrame([(s, counts[s]) for s in io.STATUSES], "status string, n_observed long")
    kept = io.read_ingested(spark, out).select(F.lit("kept").alias("status"), F.length("url").alias("chars"))
    gone = io.read_ingested(spark, out, rejected=True).select("status", F.lit(0).alias("chars"))
    there = kept.unionByName(gone).groupBy("status").agg(F.count(F.lit(1)).alias("n_written"), F.sum("chars").alias("kept_chars"))
    return seen.join(there, "status", "left").select("status", "n_observed", F.coalesce("n_written", F.lit(0)).alias("n_written"),
                                                     F.coalesce("kept_chars", F.lit(0)).alias("kept_chars"))


@query("distinct_sketches", f"""WITH l AS ({LABELLED_SQL}) SELECT CAST(target AS INTEGER) AS class, count(*) AS n_rows,
  count(DISTINCT registered_domain) AS n_exact, true AS within_bound, true AS union_alike FROM l GROUP BY target
UNION ALL SELECT NULL, count(*), count(DISTINCT registered_domain), true, true FROM l""")
def distinct_sketches(spark, sf_dir):
    """Distinct domains a class and of all from sketches stored a (class, split), united without a
    rescan; within four standard errors of the exact count, and the same as sketches made in one pass."""
    u = labelled_urls(spark, sf_dir)
    stored = materialize(K.distinct_sketches(u, "registered_domain", ["target", "split"]), "sketches")
    once = K.distinct_sketches(u, "registered_domain", ["target"])
    a = K.estimates(K.united(stored, ["target"]).unionByName(K.united(stored).withColumn("target", F.lit(None).cast("int"))))
    b = K.estimates(K.united(once, ["target"]).unionByName(K.united(once).withColumn("target", F.lit(None).cast("int"))))
    exact = u.groupBy("target").agg(F.countDistinct("registered_domain").alias("n_exact")).unionByName(
        u.agg(F.countDistinct("registered_domain").alias("n_exact")).withColumn("target", F.lit(None).cast("int")))
    # one row a class on either side
    same = lambda x, y: F.col(f"{x}.target").eqNullSafe(F.col(f"{y}.target"))
    j = a.alias("a").join(b.alias("b"), same("a", "b")).join(exact.alias("e"), same("a", "e"))
    off = F.abs(F.col("a.n_distinct") - F.col("e.n_exact"))
    return j.select(F.col("a.target").alias("class"), F.col("a.n_rows").alias("n_rows"), "e.n_exact",
                    (off <= F.greatest(F.lit(0.5), 4 * K.ERROR * F.col("e.n_exact"))).alias("within_bound"),
                    (F.col("a.n_distinct") == F.col("b.n_distinct")).alias("union_alike"))
