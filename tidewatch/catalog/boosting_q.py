"""Queries over the boosted lexical model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASSES, FEATURE_COLS
from ..functions.probs import prob_columns
from ..operators import boosting as B
from ..operators import metrics as M
from ..plans import models as MD
from ..plans.prepare import labelled_urls
from ..plans.scoring import with_features
from ..session import input_signature, materialize
from . import query, rounded
from .graph_q import _LF_SQL, _lf
from .reputation_q import LABELLED_SQL

K = len(CLASSES)
L2, MIN_ROWS = 1.0, 5
#: thresholds by rule, the same for every feature, so that SQL can state the splits too
GRID = [i / 10 for i in range(1, 10)] + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 16.0, 24.0, 32.0, 48.0, 64.0, 96.0, 128.0]
_MODELS: dict = {}


def _boosted(spark, sf_dir):
    """Features of all URLs and the model fitted on train, once a session and input."""
    key = (spark.sparkContext.applicationId, input_signature(f"{sf_dir}/pages.parquet"))
    if key not in _MODELS:
        lf = materialize(with_features(labelled_urls(spark, sf_dir), normalise=True), "boost_features", partition_by=["split"])
        _MODELS[key] = lf, MD.train_boosted_model(lf.filter(F.col("split") == "train"),
                               params=B.Params(rounds=8, depth=4, rate=0.4, min_rows=2))
    return _MODELS[key]


def _term(g: str, h: str) -> str:
    return f"({g} / 1048576.0) * ({g} / 1048576.0) / ({h} / 1048576.0 + {L2})"


_ROOT_SQL = f"""WITH f AS (SELECT * FROM ({_LF_SQL}) WHERE split = 'train'),
u AS (UNPIVOT (SELECT page_id, target, {', '.join(FEATURE_COLS)} FROM f) ON {', '.join(FEATURE_COLS)} INTO NAME feature VALUE x),
p AS (SELECT cls, (count(*) FILTER (target = cls)) / count(*) AS p FROM f, range({K}) c(cls) GROUP BY cls),
e AS (SELECT feature, x, cls, round((p - (target = cls)::INT) * 1048576)::BIGINT AS g, round(p * (1 - p) * 1048576)::BIGINT AS h FROM u, p),
v AS (SELECT feature, x, cls, sum(g) AS g, sum(h) AS h, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold),
s AS (SELECT feature, cls, threshold, sum(g) FILTER (x < threshold) AS gl, sum(h) FILTER (x < threshold) AS hl,
             sum(n) FILTER (x < threshold) AS nl, sum(g) AS ga, sum(h) AS ha, sum(n) AS na FROM v, t GROUP BY ALL),
w AS (SELECT *, round({_term('gl', 'hl')} + {_term('(ga - gl)', '(ha - hl)')} - {_term('ga', 'ha')}, 9) AS gain
      FROM s WHERE nl >= {MIN_ROWS} AND na - nl >= {MIN_ROWS}),
r AS (SELECT *, row_number() OVER (PARTITION BY cls, feature ORDER BY gain DESC, threshold) AS rn FROM w WHERE gain > 0)
SELECT cls::INT AS class, feature, threshold, nl::BIGINT AS n_left, gl::BIGINT AS gradient_left, hl::BIGINT AS curvature_left,
       round(gain, 6) + 0.0 AS gain FROM r WHERE rn = 1"""


@query("boosted_root_splits", _ROOT_SQL)
def boosted_root_splits(spark, sf_dir):
    """The first split of each class's tree for every feature, by gain, on all train URLs."""
    train = _lf(spark, sf_dir).filter("split = 'train'")
    rows = B.binned(train, FEATURE_COLS, "target", [GRID] * len(FEATURE_COLS), B.log_priors(train, "target", K))
    hist = B.histogram(rows, [{"f": [-1], "t": [0.0], "v": [0.0]}] * K, K, 0)
    # a threshold inside an empty bin cuts as the next one below does: thresholds are told by the bin on the left
    best = B.best_splits(B.split_gains(hist, L2, MIN_ROWS), by=("cls", "feature")).filter("best IS NOT NULL")
    names, grid = F.array(*[F.lit(c) for c in FEATURE_COLS]), F.array(*[F.lit(x) for x in GRID])
    return rounded(best.select(
        F.col("cls").alias("class"), F.get(names, F.col("feature")).alias("feature"),
        F.get(grid, -F.col("best.b").cast("int")).alias("threshold"), F.col("best.n_left").alias("n_left"),
        F.col("best.g_left").alias("gradient_left"), F.col("best.h_left").alias("curvature_left"),
        F.col("best.gain").alias("gain")), 6)


@query("boosted_scores", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_bad, "
       f"true AS below_forest, true AS below_priors FROM ({LABELLED_SQL})")
def boosted_scores(spark, sf_dir):
    """M1: facts of the boosted probabilities of every URL; train loss against the forest's and the class shares'."""
    lf, model = _boosted(spark, sf_dir)
    train = lf.filter("split = 'train'")
    forest = MD.train_lexical_model(train)
    loss = M.log_loss(model.predict(train), "p_lex", "target").select(F.col("log_loss").alias("a"))
    other = M.log_loss(MD.lexical_probs(forest, train), "p_lex", "target").select(F.col("log_loss").alias("b"))
    share = M.log_loss(train.withColumn("p", F.array(*[F.lit(x) for x in B.log_priors(train, "target", K)]))
                       .withColumn("p", B.softmax(F.col("p"))), "p", "target").select(F.col("log_loss").alias("c"))
    p = F.col("p_lex")
    bad = (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9) | (F.array_min(p) < 0) | (F.size(p) != K)
    counts = model.predict(lf).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bad.cast("long")).alias("n_bad"))
    # four one-row frames
    return counts.crossJoin(F.broadcast(loss)).crossJoin(F.broadcast(other)).crossJoin(F.broadcast(share)).select(
        "n_rows", "n_bad", (F.col("a") < F.col("b")).alias("below_forest"), (F.col("a") < F.col("c")).alias("below_priors"))


@query("boosted_scores_model")
def boosted_scores_model(spark, sf_dir):
    """M1: boosted class probabilities of every URL (trained on train)."""
    lf, model = _boosted(spark, sf_dir)
    return rounded(model.predict(lf).select("page_id", "split", *prob_columns("p_lex", "lex")))
