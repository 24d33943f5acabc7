"""Report documents and source round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import FEATURE_COLS
from ..operators import fusion as FU
from ..operators import graph as GR
from ..operators import metrics as M
from ..operators import reputation as R
from ..plans.prepare import labelled_urls
from ..plans.reports import comparison_record, experiment_summary, fusion_metrics_doc
from ..plans.scores import scored_urls
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.tables import URLS_SQL, url_table
from . import query, rounded
from .fusion_q import _MODELS_SQL, _fusion_test_sql, _summary_sql
from .graph_q import _LF_SQL, _lf
from .reputation_q import LABELLED_SQL


@query("raw_csv_roundtrip", f"SELECT url, type FROM ({URLS_SQL})")
def raw_csv_roundtrip(spark, sf_dir):
    """S4 then S1: write (url, type) as CSV, read it back with the raw reader."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/raw-{uuid.uuid4().hex}"
    io.write_csv(url_table(spark, sf_dir).select("url", "type"), path)
    return io.read_raw_csv(spark, path)


def _model_metrics(spark, sf_dir):
    from .fusion_q import _models
    return M.summary(_models(spark, sf_dir), "target", "pred", ["model"])


def _info(spark, sf_dir):
    return M.dataset_info(labelled_urls(spark, sf_dir), len(FEATURE_COLS))


_SUM = _summary_sql(_MODELS_SQL, "target", "pred", ["model"])
_E11_SQL = ("SELECT " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN {k} END) AS {m}_{k}"
    for m in ["lexical", "graph", "hybrid"] for k in ["accuracy", "macro_precision", "macro_recall", "macro_f1"])
    + f", (SELECT CAST(count(*) AS BIGINT) FROM ({LABELLED_SQL})) AS dataset_size, CAST({len(FEATURE_COLS)} AS BIGINT) AS num_features"
    + f", (SELECT CAST(count(DISTINCT registered_domain) AS BIGINT) FROM ({LABELLED_SQL})) AS num_domains FROM ({_SUM})")


@query("experiment_summary", _E11_SQL)
def experiment_summary_q(spark, sf_dir):
    """Metrics of all engines side by side with dataset info."""
    return rounded(experiment_summary(_model_metrics(spark, sf_dir), _info(spark, sf_dir)))


_REC_SQL = ("SELECT lex AS lightgbm_macro_f1, hyb AS hybrid_macro_f1, "
            "CASE WHEN lex <> 0 THEN (hyb - lex) / lex * 100.0 ELSE 0.0 END AS improvement_percent, dataset_size, num_features, num_domains "
            "FROM (SELECT lexical_macro_f1 AS lex, hybrid_macro_f1 AS hyb, dataset_size, num_features, num_domains FROM ("
            + _E11_SQL.replace(_SUM, _summary_sql(_MODELS_SQL, "target", "pred", ["model"], rnd=False)) + "))")
_REC_SQL = ("SELECT round(lightgbm_macro_f1, 9) + 0.0 AS lightgbm_macro_f1, round(hybrid_macro_f1, 9) + 0.0 AS hybrid_macro_f1, "
            "round(improvement_percent, 9) + 0.0 AS improvement_percent, dataset_size, num_features, num_domains FROM (" + _REC_SQL + ")")


@query("comparison_record", _REC_SQL)
def comparison_record_q(spark, sf_dir):
    """Lexical vs hybrid comparison record, without its clock."""
    return rounded(comparison_record(_model_metrics(spark, sf_dir), _info(spark, sf_dir)).drop("timestamp"))


@query("comparison_record_stamped")
def comparison_record_stamped(spark, sf_dir):
    """E10 with the time of the run."""
    return rounded(comparison_record(_model_metrics(spark, sf_dir), _info(spark, sf_dir)))


def _document(spark, sf_dir):
    """The fusion metrics JSON document, written and read back."""
    s = scored_urls(spark, sf_dir)
    search, summ = FU.fusion_report(s, "p_lex", "p_graph", "target")
    best = FU.best_alpha(search)
    test = s.filter(F.col("split") == "test").crossJoin(F.broadcast(best))
    test = FU.fused_prediction(test, "p_lex", "p_graph", F.col("best_alpha"))
    doc = fusion_metrics_doc(search, summ, M.confusion(test, "target", "pred"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/json/fusion-{uuid.uuid4().hex}"
    io.write_json(doc.coalesce(1), path)
    return io.read_json(spark, path)


@query("fusion_metrics_doc", "SELECT best_alpha, validation_best_f1, test_f1, CAST(3 AS BIGINT) AS n_alphas, "
       "CAST(n_rows AS BIGINT) AS matrix_total, CAST(round(test_accuracy * n_rows) AS BIGINT) AS matrix_trace "
       f"FROM ({_fusion_test_sql()})")
def fusion_metrics_doc_q(spark, sf_dir):
    """The fields of the metrics document."""
    m = F.col("test_confusion_matrix")
    total = F.aggregate(F.flatten(m), F.lit(0).cast("long"), lambda a, x: a + x)
    trace = F.aggregate(F.transform(m, lambda r, i: F.get(r, i)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rounded(_document(spark, sf_dir).select(
        "best_alpha", "validation_best_f1", "test_f1", F.size("alpha_tested").cast("long").alias("n_alphas"),
        total.alias("matrix_total"), trace.alias("matrix_trace")))


@query("fusion_metrics_json")
def fusion_metrics_json(spark, sf_dir):
    """The whole document as text."""
    back = _document(spark, sf_dir)
    return back.select(F.to_json(F.struct(*[F.col(c) for c in sorted(back.columns)])).alias("document"))


def _path(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("parquet_roundtrip", f"SELECT page_id, url, type FROM ({URLS_SQL})")
def parquet_roundtrip(spark, sf_dir):
    """S3 then S2: the URL table as Parquet, partitioned by class, and back."""
    path = _path(spark, "parquet/urls")
    io.write_parquet(url_table(spark, sf_dir), path, ["type"])
    return spark.read.parquet(path).select("page_id", "url", "type")


@query("profile_artefact", "SELECT registered_domain, CAST(count(*) AS BIGINT) AS dom_n, "
       f"round(avg(url_length), 6) + 0.0 AS dom_url_length, round(avg(entropy), 6) + 0.0 AS dom_entropy FROM ({_LF_SQL}) GROUP BY registered_domain")
def profile_artefact(spark, sf_dir):
    """The domain profile that serving falls back on, written and read back."""
    path = _path(spark, "artefacts/domains")
    cols = ["url_length", "entropy"]
    io.write_parquet(GR.domain_profile(_lf(spark, sf_dir), cols), path)
    return rounded(spark.read.parquet(path).select("registered_domain", "dom_n", *[f"dom_{c}" for c in cols]), 6)


@query("stage_reuse", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_computed FROM ({URLS_SQL})")
def stage_reuse(spark, sf_dir):
    """A stage asked for twice is computed once."""
    path, computed = _path(spark, "stages/urls"), []

    def compute():
        computed.append(1)
        return url_table(spark, sf_dir)
    pages = [f"{sf_dir}/pages.parquet"]
    io.stage(spark, path, compute, inputs=pages)
    return io.stage(spark, path, compute, inputs=pages).agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.lit(len(computed)).cast("long").alias("n_computed"))


@query("graph_columns", "SELECT page_id, " + ", ".join(f"R_graph_class_{i} AS p_{i}" for i in range(4)) + " FROM (WITH "
       + S.reputation_sql(LABELLED_SQL, "registered_domain", "tld", "target", [0, 1, 2, 3], ["page_id"]) + ")")
def graph_columns(spark, sf_dir):
    """a table without ``domain_class_i_prob`` is read through ``R_graph_class_i``."""
    u = labelled_urls(spark, sf_dir).select("page_id", "url", "registered_domain", "tld", "target", "split")
    r = R.reputation(u, "registered_domain", "tld", "target", [0, 1, 2, 3], spread=F.xxhash64("url"))
    r = r.drop(*[f"domain_class_{i}_prob" for i in range(4)])
    return rounded(r.select("page_id", *[F.col(c).alias(f"p_{i}") for i, c in enumerate(FU.graph_prob_columns(r, 4))]))
