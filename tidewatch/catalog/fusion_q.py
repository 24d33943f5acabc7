"""Queries over fusion, guard, verdicts and evaluation (F1-F5, R1, J4-J6,
U8, U9, E1-E9, E12, E13, E15, M3, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import EPS, SERVING_ALPHA
from ..functions.probs import argmax, normalise_exact, prob_columns, renormalise, round_vec
from ..operators import fusion as FU
from ..operators import metrics as M
from ..plans.scores import SIG_FEATURES, scored_urls
from ..sources.tables import read_table
from . import query, rounded
from .reputation_q import LABELLED_SQL

CLS = [0, 1, 2, 3]
K = 4

# ---------------------------------------------------------------- SQL side
_feat = S.features("url", "host_lex", "path")
_sig = " || ':' || ".join(f"CAST({_feat[c]} AS VARCHAR)" for c in SIG_FEATURES)
_LAB_SIG = (f"SELECT l.* EXCLUDE (host_lex, path), {_sig} AS lex_sig, "
            f"CAST({_feat['https_flag']} AS VARCHAR) AS sig_parent FROM ({S.with_lex_host_path(LABELLED_SQL)}) l")
_BASE_COLS = ["page_id", "url", "target", "split", "path_key", "host", "registered_domain"]
_G_SQL = "WITH " + S.reputation_sql(_LAB_SIG, "path_key", "host", "target", CLS,
                                    _BASE_COLS + ["lex_sig", "sig_parent"], digits=None)
_G2 = (f"SELECT {', '.join(_BASE_COLS)}, lex_sig, sig_parent, "
       + ", ".join(f"domain_class_{i}_prob AS pg{i}" for i in CLS) + f" FROM ({_G_SQL})")
_L_SQL = "WITH " + S.reputation_sql(_G2, "lex_sig", "sig_parent", "target", CLS,
                                    _BASE_COLS + [f"pg{i}" for i in CLS], digits=None)
SCORED_SQL = (f"SELECT {', '.join(_BASE_COLS)}, " + ", ".join(f"pg{i}" for i in CLS) + ", "
              + ", ".join(f"domain_class_{i}_prob AS pl{i}" for i in CLS) + f" FROM ({_L_SQL})")

_D = "CAST({} AS DOUBLE)"
_EPS = _D.format(repr(EPS))


def _blend_sql(alpha_sql: str) -> list[str]:
    """Blend of pl with renormalised pg, element-wise, as Spark evaluates it."""
    gsum = "(((pg0 + pg1) + pg2) + pg3)"
    return [f"({alpha_sql} * pl{i} + ({_D.format('1.0')} - {alpha_sql}) * (pg{i} / ({gsum} + {_EPS})))"
            for i in CLS]


def _argmax_sql(vals: list[str]) -> str:
    r = [f"round({v}, 9)" for v in vals]
    m = f"greatest({', '.join(r)})"
    return "(CASE " + " ".join(f"WHEN {r[i]} = {m} THEN {i}" for i in CLS) + " END)"


_A07 = _D.format(SERVING_ALPHA)
_PF = _blend_sql(_A07)
_HYB_SQL = (f"SELECT *, " + ", ".join(f"{v} AS pf{i}" for i, v in enumerate(_PF))
            + f", {_argmax_sql(_PF)} AS pred FROM ({SCORED_SQL})")


def _r(e: str) -> str:
    return f"round({e}, 9) + 0.0"


def _summary_sql(src: str, y: str, yhat: str, groups: list[str], rnd: bool = True) -> str:
    _r = globals()["_r"] if rnd else (lambda e: e)
    g = ", ".join(groups)
    gs = (g + ", ") if groups else ""
    return f"""SELECT {gs}{_r('sum(tp) / sum(support)')} AS accuracy,
  {_r('avg(prec)')} AS macro_precision, {_r('avg(rec)')} AS macro_recall, {_r('avg(f1)')} AS macro_f1,
  {_r('sum(f1 * support) / sum(support)')} AS weighted_f1, CAST(sum(support) AS BIGINT) AS n_rows
FROM (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS prec,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec,
             CASE WHEN support + n_pred > 0 THEN 2.0 * tp / (support + n_pred) ELSE 0.0 END AS f1
      FROM (SELECT {gs}label, sum(t) AS support, sum(p) AS n_pred, sum(tp) AS tp FROM (
              SELECT {gs}{y} AS label, 1 AS t, 0 AS p, CAST({y} = {yhat} AS INTEGER) AS tp FROM ({src})
              UNION ALL SELECT {gs}{yhat}, 0, 1, 0 FROM ({src})) GROUP BY {gs}label))
{('GROUP BY ' + g) if groups else ''}"""


# ---------------------------------------------------------------- Spark side
def _hybrid(spark, sf_dir):
    s = scored_urls(spark, sf_dir)
    return FU.fused_prediction(s, "p_lex", "p_graph", SERVING_ALPHA)


@query("scored_probs", f"SELECT page_id, split, target, " + ", ".join(
    [f"{_r(f'pl{i}')} AS pl_{i}" for i in CLS] + [f"{_r(f'pg{i}')} AS pg_{i}" for i in CLS])
    + f" FROM ({SCORED_SQL})")
def scored_probs(spark, sf_dir):
    """Lexical-signature and graph reputation vectors for every URL."""
    s = scored_urls(spark, sf_dir)
    return rounded(s.select("page_id", "split", "target", *prob_columns("p_lex", "pl"),
                            *prob_columns("p_graph", "pg")))


@query("alpha_blend", "SELECT page_id, " + ", ".join(f"{_r(f'pf{i}')} AS pf_{i}" for i in CLS)
       + f", pred FROM ({_HYB_SQL}) WHERE split = 'test'")
def alpha_blend(spark, sf_dir):
    """F1 + G8: alpha 0.7 blend on the test split and its argmax."""
    h = _hybrid(spark, sf_dir).filter(F.col("split") == "test")
    return rounded(h.select("page_id", *prob_columns("p_final", "pf"), "pred"))


_SV = [f"(pf{i} / (((pf0 + pf1) + pf2) + pf3))" for i in CLS]


@query("serving_blend", "SELECT page_id, " + ", ".join(f"{_r(v)} AS ps_{i}" for i, v in enumerate(_SV))
       + f" FROM ({_HYB_SQL})")
def serving_blend(spark, sf_dir):
    """serving blend divided by its sum."""
    h = _hybrid(spark, sf_dir).withColumn("p_serve", normalise_exact("p_final"))
    return rounded(h.select("page_id", *prob_columns("p_serve", "ps")))


def _alpha_rows_sql():
    parts = []
    for pos, a in enumerate([0.3, 0.5, 0.7]):
        pf = _blend_sql(_D.format(a))
        parts.append(f"SELECT *, {_D.format(a)} AS alpha, {pos} AS alpha_pos, {_argmax_sql(pf)} AS pred "
                     f"FROM ({SCORED_SQL}) WHERE split = 'val'")
    return " UNION ALL ".join(parts)


_SEARCH_SQL = (f"SELECT alpha, alpha_pos, macro_f1 AS validation_macro_f1, "
               f"row_number() OVER (ORDER BY macro_f1 DESC, alpha_pos) = 1 AS is_best FROM ("
               + _summary_sql(_alpha_rows_sql(), "target", "pred", ["alpha", "alpha_pos"]) + ")")


@query("alpha_search", _SEARCH_SQL)
def alpha_search(spark, sf_dir):
    """F2: validation macro F1 for each alpha of the grid, best marked."""
    s = scored_urls(spark, sf_dir).filter(F.col("split") == "val")
    return rounded(FU.alpha_search(s, "p_lex", "p_graph", "target"))


def _fusion_test_sql():
    best = f"SELECT alpha AS best_alpha, validation_macro_f1 AS validation_best_f1 FROM ({_SEARCH_SQL}) WHERE is_best"
    pf = _blend_sql("b.best_alpha")
    t = (f"SELECT s.*, b.best_alpha, b.validation_best_f1, {_argmax_sql(pf).replace('pl', 's.pl').replace('pg', 's.pg')} AS pred "
         f"FROM ({SCORED_SQL}) s CROSS JOIN ({best}) b WHERE s.split = 'test'")
    return (f"SELECT best_alpha, validation_best_f1, macro_f1 AS test_f1, accuracy AS test_accuracy, n_rows "
            f"FROM ({_summary_sql(t, 'target', 'pred', ['best_alpha', 'validation_best_f1'])})")


@query("fusion_test", _fusion_test_sql())
def fusion_test(spark, sf_dir):
    """test macro F1 with the alpha chosen on validation."""
    _, summ = FU.fusion_report(scored_urls(spark, sf_dir), "p_lex", "p_graph", "target")
    return rounded(summ)


_TEST_HYB = f"SELECT * FROM ({_HYB_SQL}) WHERE split = 'test'"


@query("confusion", f"""WITH t AS ({_TEST_HYB}),
labs AS (SELECT target AS lab FROM t UNION SELECT pred FROM t),
c AS (SELECT target, pred, count(*) AS n FROM t GROUP BY target, pred)
SELECT a.lab AS target, b.lab AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM labs a CROSS JOIN labs b LEFT JOIN c ON c.target = a.lab AND c.pred = b.lab""")
def confusion(spark, sf_dir):
    """Dense confusion matrix of the hybrid on test."""
    h = _hybrid(spark, sf_dir).filter(F.col("split") == "test")
    return M.confusion(h, "target", "pred")


@query("class_report", f"""WITH t AS ({_TEST_HYB}),
lc AS (SELECT label, sum(t) AS support, sum(p) AS n_pred, sum(tp) AS tp FROM (
        SELECT target AS label, 1 AS t, 0 AS p, CAST(target = pred AS INTEGER) AS tp FROM t
        UNION ALL SELECT pred, 0, 1, 0 FROM t) GROUP BY label),
pc AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN support + n_pred > 0 THEN 2.0 * tp / (support + n_pred) ELSE 0.0 END AS f1 FROM lc)
SELECT CAST(label AS VARCHAR) AS "row", {_r('precision')} AS precision, {_r('recall')} AS recall,
       {_r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'macro avg', {_r('avg(precision)')}, {_r('avg(recall)')}, {_r('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', {_r('sum(precision * support) / sum(support)')},
       {_r('sum(recall * support) / sum(support)')}, {_r('sum(f1 * support) / sum(support)')},
       CAST(sum(support) AS BIGINT) FROM pc""")
def class_report(spark, sf_dir):
    """Per-class precision/recall/F1/support plus macro and weighted rows."""
    h = _hybrid(spark, sf_dir).filter(F.col("split") == "test")
    return rounded(M.class_report(h, "target", "pred"))


_MODELS_SQL = (f"SELECT 'hybrid' AS model, target, pred FROM ({_TEST_HYB}) UNION ALL "
               f"SELECT 'lexical', target, {_argmax_sql([f'pl{i}' for i in CLS])} FROM ({_TEST_HYB}) UNION ALL "
               f"SELECT 'graph', target, {_argmax_sql([f'(pg{i} / ((((pg0 + pg1) + pg2) + pg3) + {_EPS}))' for i in CLS])} "
               f"FROM ({_TEST_HYB})")


def _models(spark, sf_dir):
    h = _hybrid(spark, sf_dir).filter(F.col("split") == "test")
    return (h.select(F.lit("hybrid").alias("model"), "target", "pred")
            .unionByName(h.select(F.lit("lexical").alias("model"), "target",
                                  argmax(round_vec("p_lex")).alias("pred")))
            .unionByName(h.select(F.lit("graph").alias("model"), "target",
                                  argmax(round_vec(renormalise("p_graph"))).alias("pred"))))


@query("model_compare", _summary_sql(_MODELS_SQL, "target", "pred", ["model"]))
def model_compare(spark, sf_dir):
    """Accuracy, macro precision/recall/F1 per engine on test."""
    return rounded(M.summary(_models(spark, sf_dir), "target", "pred", ["model"]))


@query("improvement", f"""SELECT {_r("max(CASE WHEN model = 'lexical' THEN macro_f1 END)")} AS lexical_macro_f1,
  {_r("max(CASE WHEN model = 'hybrid' THEN macro_f1 END)")} AS hybrid_macro_f1,
  {_r("CASE WHEN max(CASE WHEN model = 'lexical' THEN macro_f1 END) <> 0 THEN (max(CASE WHEN model = 'hybrid' THEN macro_f1 END) - max(CASE WHEN model = 'lexical' THEN macro_f1 END)) / max(CASE WHEN model = 'lexical' THEN macro_f1 END) * 100.0 ELSE 0.0 END")} AS improvement_percent
FROM ({_summary_sql(_MODELS_SQL, "target", "pred", ["model"], rnd=False)})""")
def improvement(spark, sf_dir):
    """Hybrid vs lexical macro F1 gain in percent (explicit test split)."""
    s = M.summary(_models(spark, sf_dir), "target", "pred", ["model"])
    w = s.groupBy().agg(F.max(F.when(F.col("model") == "lexical", F.col("macro_f1"))).alias("lex"),
                        F.max(F.when(F.col("model") == "hybrid", F.col("macro_f1"))).alias("hyb"))
    return rounded(w.select(F.col("lex").alias("lexical_macro_f1"), F.col("hyb").alias("hybrid_macro_f1"),
                            M.improvement(F.col("hyb"), F.col("lex")).alias("improvement_percent")))


_OVR_SQL = " UNION ALL ".join(
    f"SELECT {i} AS cls, round(pf{i}, 9) AS score, target = {i} AS is_pos FROM ({_TEST_HYB})" for i in CLS)


def _ovr(spark, sf_dir):
    h = _hybrid(spark, sf_dir).filter(F.col("split") == "test")
    o = M.one_vs_rest(h, "p_final", "target", K)
    return o.withColumn("score", F.round("score", 9))


@query("roc_points", f"""WITH o AS ({_OVR_SQL}),
d AS (SELECT cls, score, sum(CAST(is_pos AS BIGINT)) AS pos, sum(CAST(NOT is_pos AS BIGINT)) AS neg FROM o GROUP BY cls, score),
c AS (SELECT cls, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn,
             sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N
      FROM d WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(cls AS INTEGER) AS cls, score AS threshold, {_r('tp / NULLIF(P, 0)')} AS tpr, {_r('fp / NULLIF(N, 0)')} AS fpr
FROM c WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT CAST(cls AS INTEGER), CAST('inf' AS DOUBLE), {_r('0.0 / NULLIF(P, 0)')}, {_r('0.0 / NULLIF(N, 0)')} FROM c""")
def roc_points(spark, sf_dir):
    """E5 + E6: one-vs-rest ROC points of the hybrid on test."""
    return rounded(M.roc_points(_ovr(spark, sf_dir)))


_AUC_SQL = """WITH o AS ({ovr}),
r AS (SELECT cls, is_pos, rank() OVER (PARTITION BY cls ORDER BY score)
             + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM o),
s AS (SELECT cls, sum(CASE WHEN is_pos THEN rk ELSE 0 END) AS rs,
             sum(CAST(is_pos AS BIGINT)) AS P, sum(CAST(NOT is_pos AS BIGINT)) AS N FROM r GROUP BY cls)
SELECT CAST(cls AS INTEGER) AS cls, round((rs - P * (P + 1) / 2.0) / NULLIF(P * N, 0), 9) + 0.0 AS auc,
       CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg FROM s"""


@query("auc", _AUC_SQL.format(ovr=_OVR_SQL))
def auc(spark, sf_dir):
    """One-vs-rest AUC per class (oracle: Mann-Whitney rank sum)."""
    return rounded(M.auc(_ovr(spark, sf_dir)))


_EV_TYPES_SQL = "SELECT DISTINCT event_type AS cls FROM events"
_EV_OVR_SQL = ("SELECT c.cls, e.value AS score, e.event_type = c.cls AS is_pos FROM events e "
               f"CROSS JOIN ({_EV_TYPES_SQL}) c")


@query("auc_events", _AUC_SQL.format(ovr=_EV_OVR_SQL).replace("CAST(cls AS INTEGER)", "cls"))
def auc_events(spark, sf_dir):
    """E7 at table scale: AUC of ``value`` for each event type vs the rest,
    from one pooled rank."""
    return rounded(M.auc_by_class(read_table(spark, sf_dir, "events"), "event_type", "value"))


_ROC_SQL = """WITH o AS ({ovr}),
d AS (SELECT cls, score, sum(CAST(is_pos AS BIGINT)) AS pos, sum(CAST(NOT is_pos AS BIGINT)) AS neg FROM o GROUP BY cls, score),
c AS (SELECT cls, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn,
             sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N
      FROM d WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT cls, score AS threshold, round(tp / NULLIF(P, 0), 9) + 0.0 AS tpr, round(fp / NULLIF(N, 0), 9) + 0.0 AS fpr
FROM c WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT DISTINCT cls, CAST('inf' AS DOUBLE), round(0.0 / NULLIF(P, 0), 9) + 0.0,
  round(0.0 / NULLIF(N, 0), 9) + 0.0 FROM c"""


@query("roc_events", _ROC_SQL.format(ovr=_EV_OVR_SQL))
def roc_events(spark, sf_dir):
    """E6 at table scale: ROC curve of ``value`` for each event type vs the rest."""
    return rounded(M.roc_by_class(read_table(spark, sf_dir, "events"), "event_type", "value"))


@query("log_loss", f"""SELECT {_r(f"avg(-ln(CASE target {' '.join(f'WHEN {i} THEN pgn{i}' for i in CLS)} END + {_EPS}))")} AS log_loss,
  {_r(f"avg(CAST({_argmax_sql([f'pgn{i}' for i in CLS])} = target AS DOUBLE))")} AS accuracy
FROM (SELECT *, {', '.join(f'pg{i} / ((((pg0 + pg1) + pg2) + pg3) + {_EPS}) AS pgn{i}' for i in CLS)} FROM ({SCORED_SQL}) WHERE split = 'val')""")
def log_loss(spark, sf_dir):
    """M3: validation log loss and accuracy of the graph vector."""
    s = scored_urls(spark, sf_dir).filter(F.col("split") == "val")
    return rounded(M.log_loss(s.withColumn("p", renormalise("p_graph")), "p", "target"))
