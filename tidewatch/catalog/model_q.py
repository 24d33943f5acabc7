"""Model, scoring and streaming queries.

``score_batch``, ``score_stream``, ``score_batches`` and ``audit`` run the serving
decision on the fixed score table, so SQL can state their rows; the queries
ending in ``_model`` run the trained engines.  Trained numbers differ between
runs of different versions, so ``rf_scores``, ``mlp_scores`` and
``importance_facts`` return facts about them that SQL can state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import CLASSES, FEATURE_COLS
from ..functions.probs import prob_columns, prob_map
from ..operators import graph as GR
from ..operators import guard as G
from ..operators import metrics as M
from ..operators.fusion import align_scores
from ..plans import models as MD
from ..plans.prepare import labelled_urls
from ..plans.scores import scored_urls
from ..plans.scoring import fit_engines, score, verdict, with_features
from ..session import bucketed_table, ensure_checkpoint_dir, input_signature, materialize
from ..sources.tables import page_url, url_table
from ..streaming.score_stream import finish, run_stream_score, stream_batches_into, stream_into, table_stream
from . import query, rounded
from .fusion_q import SCORED_SQL
from .guard_q import _FINAL_SQL, _NAMES_SQL, _final, _known, _r, _serving
from .reputation_q import LABELLED_SQL

CLS = [0, 1, 2, 3]
PAGES = "page_id bigint, url string, html string"
_ENGINES: dict = {}


def engines(spark, sf_dir):
    key = (spark.sparkContext.applicationId, input_signature(f"{sf_dir}/pages.parquet"))
    if key not in _ENGINES:
        _ENGINES[key] = fit_engines(labelled_urls(spark, sf_dir))
    return _ENGINES[key]


def _folders(spark, name):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _page_stream(spark, sf_dir):
    src = table_stream(spark, f"{sf_dir.rstrip('/')}/pages.parquet", PAGES)
    return src.select("page_id", page_url().alias("url"))


# --- the serving decision on fixed scores -------------------------------------
_DECIDED = ["page_id", "url", "status", "is_allowed", "predicted_class", "confidence_score"]
_DECIDED_SQL = ("SELECT page_id, url, 'ok' AS status, is_allowed, " + f"{_NAMES_SQL} AS predicted_class, "
                + f"{_r('greatest(pv0, pv1, pv2, pv3) * 100.0')} AS confidence_score, "
                + ", ".join(f"{_r(f'pv{i}')} AS p_{i}" for i in CLS) + f" FROM ({_FINAL_SQL})")


def _fixed(spark, sf_dir):
    """Serving vector, domain and unseen flag of every page: the static side."""
    h = G.flag_unseen(_serving(spark, sf_dir), "path_key", _known(spark, sf_dir))
    return bucketed_table(h.select("page_id", "registered_domain", "is_unseen", "p_serve"), "fixed_scores", "page_id")


def _decide(urls, fixed):
    """URLs (batch or stream) to their verdict: scores by key, guard, allow list."""
    d = G.flag_allowed(urls.join(fixed, "page_id"), "registered_domain")
    rule = G.guard_rule("url", "is_unseen")
    p = F.when(F.col("is_allowed"), G.allow_vector()).otherwise(G.apply_guard("p_serve", rule))
    d = verdict(d.withColumn("p_final", p).withColumn("status", F.lit("ok")))
    return d.select(*_DECIDED, *prob_columns("p_final", "p"))


@query("score_batch", _DECIDED_SQL)
def score_batch(spark, sf_dir):
    """R2 over all URLs on fixed scores."""
    return rounded(_decide(url_table(spark, sf_dir).select("page_id", "url"), _fixed(spark, sf_dir)))


@query("score_stream", _DECIDED_SQL)
def score_stream(spark, sf_dir):
    """The same decision as a Structured Streaming query over the pages files."""
    fixed, (out, ckpt) = _fixed(spark, sf_dir), _folders(spark, "rows")
    finish(stream_into(_page_stream(spark, sf_dir), lambda s: _decide(s, fixed), out, ckpt))
    return rounded(spark.read.parquet(out))


@query("score_batches", _DECIDED_SQL)
def score_batches(spark, sf_dir):
    """The same decision in micro-batches, each epoch a directory of its own."""
    fixed, (out, ckpt) = _fixed(spark, sf_dir), _folders(spark, "batches")
    finish(stream_batches_into(_page_stream(spark, sf_dir), lambda b: _decide(b, fixed), out, ckpt))
    return rounded(spark.read.parquet(out).drop("epoch"))


@query("audit", "SELECT page_id, url, is_unseen, guard_rule, " + f"{_NAMES_SQL} AS predicted_class, " + ", ".join(
    f"{_r(f'{c}{i}')} AS {n}_{i}" for n, c in (("lex", "pl"), ("graph", "pg"), ("final", "pv")) for i in CLS)
    + f" FROM ({_FINAL_SQL})")
def audit(spark, sf_dir):
    """Both engines' vectors, rule and final class of every URL, on fixed scores."""
    f = verdict(_final(spark, sf_dir), "p_verdict")
    return rounded(f.select("page_id", "url", "is_unseen", "guard_rule", "predicted_class", *prob_columns("p_lex", "lex"),
                            *prob_columns("p_graph", "graph"), *prob_columns("p_verdict", "final")))


@query("class_probabilities", " UNION ALL ".join(
    f"SELECT page_id, {S.q(c)} AS class, {_r(f'pv{i}')} AS probability FROM ({_FINAL_SQL})" for i, c in enumerate(CLASSES)))
def class_probabilities(spark, sf_dir):
    """The class -> probability map of every verdict, unfolded."""
    f = _final(spark, sf_dir)
    return rounded(f.select("page_id", F.explode(prob_map("p_verdict")).alias("class", "probability")))


_BY_URL = ", ".join(f"min(pg{i}) AS pg{i}" for i in CLS)


@query("align_scores", "SELECT l.page_id, l.target, s.url IS NOT NULL AS has_scores, "
       + ", ".join(f"{_r(f'pg{i}')} AS pg_{i}" for i in CLS)
       + f" FROM ({LABELLED_SQL}) l LEFT JOIN (SELECT url, {_BY_URL} FROM ({SCORED_SQL}) WHERE split <> 'val' GROUP BY url) s ON l.url = s.url")
def align_scores_q(spark, sf_dir):
    """Labels with the graph scores of another table (without the validation
    URLs), by URL."""
    s = scored_urls(spark, sf_dir).filter("split <> 'val'").groupBy("url").agg(
        *[F.min(F.element_at("p_graph", i + 1)).alias(f"pg_{i}") for i in CLS])
    u = labelled_urls(spark, sf_dir).select("page_id", "url", "target")
    return rounded(align_scores(u, s, "url").select("page_id", "target", "has_scores", *[f"pg_{i}" for i in CLS]))


# --- trained engines: facts that SQL can state, and their numbers --------------
def _facts(scored, p, truth="target"):
    """Per split: rows, vectors that are no distribution, and whether the log loss
    of the train rows is below that of their class shares (the model has learnt)."""
    train = scored.filter("split = 'train'")
    bad = (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6) | (F.array_min(p) < 0) | (F.size(p) != len(CLASSES))
    loss = M.log_loss(train, p, truth).select(F.col("log_loss").alias("_l"))
    share = train.groupBy(truth).count()
    total = share.agg(F.sum("count").alias("_n"))
    prior = share.crossJoin(F.broadcast(total)).agg(
        (-F.sum(F.col("count") * F.log(F.col("count") / F.col("_n"))) / F.max("_n")).alias("_prior"))  # one row
    per = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bad.cast("long")).alias("n_bad"))
    return per.crossJoin(F.broadcast(loss)).crossJoin(F.broadcast(prior)).select(
        "split", "n_rows", "n_bad", (F.col("_l") < F.col("_prior")).alias("beats_prior"))


_FACTS_SQL = (f"SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_bad, true AS beats_prior "
              f"FROM ({LABELLED_SQL}) GROUP BY split")


def _forest(spark, sf_dir):
    lf = with_features(labelled_urls(spark, sf_dir), normalise=True)
    return lf, MD.train_lexical_model(lf.filter(F.col("split") == "train"))


def _graph_table(spark, sf_dir):
    lf = with_features(labelled_urls(spark, sf_dir), normalise=True)
    prop = GR.with_suffix_vector(GR.propagate(lf, FEATURE_COLS, spread=F.xxhash64("url")), "tld",
                                 MD.SUFFIX_BUCKETS)
    cols = MD.graph_feature_cols()
    return materialize(prop.select("page_id", "target", "split", *cols), "graph_train", partition_by=["split"]), cols


def _graph_scores(spark, sf_dir):
    prop, cols = _graph_table(spark, sf_dir)
    m, _ = MD.select_graph_model(prop.filter(F.col("split") == "train"), prop.filter(F.col("split") == "val"), cols)
    return MD.graph_probs(m, prop, cols)


@query("rf_scores", _FACTS_SQL)
def rf_scores(spark, sf_dir):
    """M1: facts of the random-forest probabilities of every URL."""
    lf, m = _forest(spark, sf_dir)
    return _facts(materialize(MD.lexical_probs(m, lf).select("split", "target", "p_lex"), "rf_scores"), "p_lex")


@query("rf_scores_model")
def rf_scores_model(spark, sf_dir):
    """M1: random-forest class probabilities for every URL (trained on train)."""
    lf, m = _forest(spark, sf_dir)
    return rounded(MD.lexical_probs(m, lf).select("page_id", "split", *prob_columns("p_lex", "lex")))


@query("mlp_scores", _FACTS_SQL)
def mlp_scores(spark, sf_dir):
    """M2: facts of the graph model's probabilities, chosen by validation loss."""
    g = _graph_scores(spark, sf_dir)
    return _facts(materialize(g.select("split", "target", "p_graph"), "mlp_scores"), "p_graph")


@query("mlp_scores_model")
def mlp_scores_model(spark, sf_dir):
    """M2 + M4: propagated graph features -> MLP -> domain_class_{i}_prob."""
    g = MD.export_graph_scores(_graph_scores(spark, sf_dir))
    return rounded(g.select("page_id", "split", *[f"domain_class_{i}_prob" for i in CLS]))


@query("mlp_slices", f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, true AS kept_is_lowest, true AS resumed_alike, "
       f"true AS beats_prior FROM ({LABELLED_SQL})")
def mlp_slices(spark, sf_dir):
    """M2: training in slices; the kept model has the lowest validation loss, a second call goes on from
    the stored slices, and the model has learnt."""
    prop, cols = _graph_table(spark, sf_dir)
    train, val = prop.filter("split = 'train'"), prop.filter("split = 'val'")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    MD.train_graph_in_slices(train, val, cols, folder, slices=2, slice_iter=10)  # as if the driver was lost here
    model, table = MD.train_graph_in_slices(train, val, cols, folder, slices=4, slice_iter=10)
    scored = materialize(MD.graph_probs(model, prop, cols).select("split", "target", "p_graph"), "slice_scores")
    per = _facts(scored, "p_graph")
    own = M.log_loss(scored.filter("split = 'val'"), "p_graph", "target").select(F.col("log_loss").alias("own"))
    low = table.agg(F.min("val_log_loss").alias("low"), F.min(F.when(F.col("kept"), F.col("val_log_loss"))).alias("kept"),
                    F.max("slice").alias("last"))
    total = per.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"), F.min("beats_prior").alias("beats_prior"))
    one = total.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(low))  # one row each
    return one.select("n_rows", "n_bad", (F.col("kept") == F.col("low")).alias("kept_is_lowest"),
                      ((F.abs(F.col("own") - F.col("kept")) < 1e-9) & (F.col("last") >= 2)).alias("resumed_alike"), "beats_prior")


@query("importance_facts", f"SELECT CAST({len(FEATURE_COLS)} AS BIGINT) AS n_features, CAST(1.0 AS DOUBLE) AS total, "
       "CAST(0 AS BIGINT) AS n_negative, true AS some_are_used")
def importance_facts(spark, sf_dir):
    """Facts of the fitted forest's importances."""
    imp = MD.forest_importance(spark, _forest(spark, sf_dir)[1])
    return rounded(imp.agg(F.count_distinct("feature").alias("n_features"), F.sum("importance").alias("total"),
                           F.sum((F.col("importance") < 0).cast("long")).alias("n_negative"),
                           (F.sum((F.col("importance") > 0).cast("long")) >= 5).alias("some_are_used")), 6)


@query("importance_model")
def importance_model(spark, sf_dir):
    """The 20 largest importances of the fitted forest."""
    imp = MD.forest_importance(spark, _forest(spark, sf_dir)[1])
    return rounded(imp.orderBy(F.col("importance").desc(), "feature").limit(20))


@query("model_roundtrip", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM ({LABELLED_SQL})")
def model_roundtrip(spark, sf_dir):
    """A saved and loaded forest scores every URL as the fitted one does."""
    lf, m = _forest(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    MD.save_model(m, path)
    both = MD.lexical_probs(MD.load_model(path), MD.lexical_probs(m, lf), "p_again")
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.sum((F.col("p_lex") != F.col("p_again")).cast("long")).alias("n_different"))


@query("score_batch_model")
def score_batch_model(spark, sf_dir):
    """R2: end-to-end scoring of every URL with the trained engines."""
    s = score(url_table(spark, sf_dir).select("page_id", "url"), engines(spark, sf_dir))
    return rounded(s.select(*_DECIDED, *prob_columns("p_final", "p")))


@query("score_stream_model")
def score_stream_model(spark, sf_dir):
    """T1 with the trained engines."""
    out, ckpt = _folders(spark, "model")
    run_stream_score(_page_stream(spark, sf_dir), engines(spark, sf_dir), out, ckpt)
    return rounded(spark.read.parquet(out).select(*_DECIDED, *prob_columns("p_final", "p")))


@query("audit_model")
def audit_model(spark, sf_dir):
    """E14 with the trained engines."""
    s = score(url_table(spark, sf_dir).select("page_id", "url"), engines(spark, sf_dir), debug=True)
    return rounded(s.select("page_id", "url", "is_unseen", "guard_rule", "predicted_class",
                            *prob_columns("p_lex", "lex"), *prob_columns("p_graph", "graph"),
                            *prob_columns("p_final", "final")))
