"""Queries over the serving decision: allow list, zero-day flag, rule guard,
verdicts, long report tables (J4-J6, R1, U7-U9, E8, E12, E13, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import (ALLOW_LIST, ALLOW_VECTOR, CLASSES, FEATURE_COLS, GUARD_ENTROPY,
                         GUARD_KEYWORDS, MALWARE_MARKERS, MALWARE_VECTOR, PHISHING_VECTOR,
                         SERVING_ALPHA)
from ..functions.lexical import feature_columns
from ..functions.probs import argmax, class_name, confidence, normalise_exact, prob_columns, round_vec
from ..operators import fusion as FU
from ..operators import guard as G
from ..operators import metrics as M
from ..plans.prepare import labelled_urls
from ..plans.scores import scored_urls
from ..sources.tables import read_table
from . import query, rounded
from .fusion_q import _HYB_SQL, _r
from .reputation_q import LABELLED_SQL

CLS = [0, 1, 2, 3]


def _serving(spark, sf_dir):
    h = FU.fused_prediction(scored_urls(spark, sf_dir), "p_lex", "p_graph", SERVING_ALPHA)
    return h.withColumn("p_serve", normalise_exact("p_final"))


def _known(spark, sf_dir):
    s = scored_urls(spark, sf_dir)
    return s.filter(F.col("split") == "train").select("path_key")


def _guarded(spark, sf_dir):
    h = G.flag_unseen(_serving(spark, sf_dir), "path_key", _known(spark, sf_dir))
    rule = G.guard_rule("url", "is_unseen", signals=True)
    return (h.select("*", *G.guard_signals("url"))
            .withColumn("guard_rule", rule)
            .withColumn("p_guard", G.apply_guard("p_serve", F.col("guard_rule"))))


# --- SQL pieces ---------------------------------------------------------------
_SV_SQL = (f"SELECT *, " + ", ".join(f"pf{i} / (((pf0 + pf1) + pf2) + pf3) AS ps{i}" for i in CLS)
           + f" FROM ({_HYB_SQL})")
_KW_SQL = "(" + " + ".join(f"CAST(strpos(lower(url), {S.q(k)}) > 0 AS INTEGER)" for k in GUARD_KEYWORDS) + ")"
_MW_SQL = "(" + " OR ".join(f"strpos(lower(url), {S.q(m)}) > 0" for m in MALWARE_MARKERS) + ")"
_UNSEEN_SQL = (f"(path_key NOT IN (SELECT path_key FROM ({_HYB_SQL}) WHERE split = 'train'))")
_GS_SQL = (f"SELECT *, {_UNSEEN_SQL} AS is_unseen, CAST({_KW_SQL} AS BIGINT) AS guard_keywords, "
           f"{_MW_SQL} AS guard_malware, {S.entropy('url')} AS guard_entropy FROM ({_SV_SQL})")
_RULE_SQL = (f"SELECT *, CASE WHEN is_unseen AND guard_malware THEN 'malware' "
             f"WHEN is_unseen AND (guard_keywords >= 2 OR (guard_entropy > {GUARD_ENTROPY} AND guard_keywords >= 1)) "
             f"THEN 'phishing' END AS guard_rule FROM ({_GS_SQL})")


def _vec_case(vec_name: str, i: int) -> str:
    return (f"CASE WHEN guard_rule = 'malware' THEN {MALWARE_VECTOR[i]} WHEN guard_rule = 'phishing' "
            f"THEN {PHISHING_VECTOR[i]} ELSE {vec_name}{i} END")


_GUARDED_SQL = (f"SELECT *, " + ", ".join(f"CAST({_vec_case('ps', i)} AS DOUBLE) AS pgd{i}" for i in CLS)
                + f" FROM ({_RULE_SQL})")


@query("zero_day_flag", f"SELECT page_id, path_key, {_UNSEEN_SQL} AS is_unseen FROM ({_HYB_SQL})")
def zero_day_flag(spark, sf_dir):
    """URL key never seen in training."""
    s = scored_urls(spark, sf_dir)
    return G.flag_unseen(s, "path_key", _known(spark, sf_dir)).select("page_id", "path_key", "is_unseen")


@query("guard_rules", "SELECT page_id, is_unseen, guard_keywords, guard_malware, guard_rule, "
       + ", ".join(f"{_r(f'pgd{i}')} AS pg_{i}" for i in CLS) + f" FROM ({_GUARDED_SQL})")
def guard_rules(spark, sf_dir):
    """R1 + U7: keyword / marker / entropy overrides for unseen keys."""
    g = _guarded(spark, sf_dir)
    return rounded(g.select("page_id", "is_unseen", F.col("guard_keywords").cast("long").alias("guard_keywords"),
                            "guard_malware", "guard_rule", *prob_columns("p_guard", "pg")))


_ALLOW_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({S.q(d)})" for d in ALLOW_LIST) + ") t(allow_domain))"
_FINAL_SQL = (f"SELECT *, registered_domain IN (SELECT allow_domain FROM {_ALLOW_SQL}) AS is_allowed FROM ({_GUARDED_SQL})")
_FINAL_SQL = (f"SELECT *, " + ", ".join(
    f"CAST(CASE WHEN is_allowed THEN {ALLOW_VECTOR[i]} ELSE pgd{i} END AS DOUBLE) AS pv{i}" for i in CLS)
    + f" FROM ({_FINAL_SQL})")
_PRED_SQL = "(CASE " + " ".join(
    f"WHEN round(pv{i}, 9) = greatest({', '.join(f'round(pv{j}, 9)' for j in CLS)}) THEN {i}" for i in CLS) + " END)"
_NAMES_SQL = "CASE " + " ".join(f"WHEN {_PRED_SQL} = {i} THEN {S.q(c)}" for i, c in enumerate(CLASSES)) + " END"


def _final(spark, sf_dir):
    """R2 on fixed scores: allow-listed rows bypass scoring (J6), the others
    take the guarded serving vector; results stay keyed by page_id."""
    g = _guarded(spark, sf_dir)
    g = G.flag_allowed(g, "registered_domain")
    return g.withColumn("p_verdict", F.when(F.col("is_allowed"), G.allow_vector()).otherwise(F.col("p_guard")))


@query("allowlist_split", f"SELECT page_id, registered_domain, is_allowed, "
       + ", ".join(f"{_r(f'pv{i}')} AS pv_{i}" for i in CLS) + f" FROM ({_FINAL_SQL})")
def allowlist_split(spark, sf_dir):
    """J4 + J6: allow-list short cut, union with the scored rows."""
    f = _final(spark, sf_dir)
    return rounded(f.select("page_id", "registered_domain", "is_allowed", *prob_columns("p_verdict", "pv")))


@query("verdict", f"SELECT page_id, {_NAMES_SQL} AS predicted_class, "
       f"{_r(f'greatest(pv0, pv1, pv2, pv3) * 100.0')} AS confidence_score FROM ({_FINAL_SQL})")
def verdict(spark, sf_dir):
    """U8 + U9: predicted class name and confidence of the final vector."""
    f = _final(spark, sf_dir)
    return rounded(f.select("page_id", class_name(argmax(round_vec("p_verdict"))).alias("predicted_class"),
                            confidence("p_verdict").alias("confidence_score")))


_PL_SQL = " UNION ALL ".join(
    f"SELECT page_id, {S.q(m)} AS model, {S.q(c)} AS class, {_r(f'{col}{i}')} AS probability "
    f"FROM ({_HYB_SQL}) WHERE split = 'test'"
    for m, col in [("lexical", "pl"), ("graph", "pg"), ("hybrid", "pf")] for i, c in enumerate(CLASSES))


@query("prob_long", _PL_SQL)
def prob_long(spark, sf_dir):
    """Long table (url, model, class, probability) for the test split."""
    h = FU.fused_prediction(scored_urls(spark, sf_dir), "p_lex", "p_graph", SERVING_ALPHA)
    h = h.filter(F.col("split") == "test")
    wide = h.select("page_id", *[F.element_at(F.col(col), i + 1).alias(f"{m}|{c}")
                                 for m, col in [("lexical", "p_lex"), ("graph", "p_graph"),
                                                ("hybrid", "p_final")]
                                 for i, c in enumerate(CLASSES)])
    long = wide.unpivot("page_id", [c for c in wide.columns if c != "page_id"], "mc", "probability")
    return rounded(long.select("page_id", F.split("mc", r"\|")[0].alias("model"),
                               F.split("mc", r"\|")[1].alias("class"), "probability"))


_FEAT_SQL = ("WITH h AS (SELECT page_id, url, " + S.host_path_select("url") + f" FROM ({LABELLED_SQL})) "
             "SELECT page_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in S.features("url").items())
             + " FROM h")


@query("feature_long", "SELECT page_id, feature, round(value, 9) + 0.0 AS value FROM (UNPIVOT ("
       + _FEAT_SQL + ") ON COLUMNS(* EXCLUDE (page_id)) INTO NAME feature VALUE value)")
def feature_long(spark, sf_dir):
    """Feature name / value long view of every URL."""
    u = labelled_urls(spark, sf_dir).select("page_id", *[c.cast("double").alias(n) for c, n in
                                                         zip(feature_columns("url"), FEATURE_COLS)])
    return rounded(u.unpivot("page_id", FEATURE_COLS, "feature", "value"))


@query("topk_importance", "SELECT feature, round(importance, 6) + 0.0 AS importance FROM (UNPIVOT ("
       "SELECT " + ", ".join(f"var_pop({n}) AS {n}" for n in FEATURE_COLS)
       + f" FROM ({_FEAT_SQL}) WHERE page_id IN (SELECT page_id FROM ({LABELLED_SQL}) WHERE split = 'train')"
       + ") ON COLUMNS(*) INTO NAME feature VALUE importance) ORDER BY importance DESC, feature LIMIT 20")
def topk_importance(spark, sf_dir):
    """Top-20 features by a variance importance proxy on train (one
    aggregate row, unpivoted, then a top-k sort of 40 rows)."""
    u = labelled_urls(spark, sf_dir).filter(F.col("split") == "train")
    f = u.select(*[c.cast("double").alias(n) for c, n in zip(feature_columns("url"), FEATURE_COLS)])
    one = f.agg(*[F.var_pop(n).alias(n) for n in FEATURE_COLS])
    long = one.unpivot([], FEATURE_COLS, "feature", "importance")
    return rounded(long.orderBy(F.col("importance").desc(), "feature").limit(20), 6)


@query("stage_share", """SELECT user_id, event_type, round(stage_ms, 6) + 0.0 AS stage_ms,
  round(stage_ms / greatest(sum(stage_ms) OVER (PARTITION BY user_id), 0.001), 6) + 0.0 AS share
FROM (SELECT user_id, event_type, sum(value) AS stage_ms FROM events GROUP BY user_id, event_type)""")
def stage_share(spark, sf_dir):
    """Each stage's share of its run total (events: run = user, stage =
    event type, duration = value)."""
    ev = read_table(spark, sf_dir, "events")
    return rounded(M.stage_share(ev, "user_id", "event_type", "value"), 6)
