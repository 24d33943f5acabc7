"""Remaining scalar / projection / index queries (U1, U2, U6, C6-C9, J7) and
lexical features over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import CLASS_IDS, FEATURE_COLS
from ..functions.lexical import (char_stats_long, display_truncate, entropy_risk, feature_columns, lexical_host,
                                 shannon_entropy)
from ..operators import clean
from ..operators import graph as GR
from ..plans.prepare import labelled_urls
from ..sources.tables import document_table
from . import query, rounded
from .reputation_q import LABELLED_SQL

_ENT = S.entropy("url")


@query("entropy_risk", f"""SELECT page_id, round({_ENT}, 3) + 0.0 AS entropy_3,
  CASE WHEN {_ENT} < 3.5 THEN 'low' WHEN {_ENT} < 4.5 THEN 'medium' ELSE 'high' END AS entropy_risk,
  CASE WHEN length(url) > 35 THEN substr(url, 1, 35) || '...' ELSE url END AS display_url,
  upper(substr(type, 1, 1)) || lower(substr(type, 2)) AS display_class
FROM ({LABELLED_SQL})""")
def entropy_risk_q(spark, sf_dir):
    """U1 + U2 + U6: entropy (3 digits), its risk bucket, display forms."""
    u = labelled_urls(spark, sf_dir)
    e = shannon_entropy("url")
    return u.select("page_id", (F.round(e, 3) + F.lit(0.0)).alias("entropy_3"),
                    entropy_risk(e).alias("entropy_risk"), display_truncate("url").alias("display_url"),
                    F.initcap("type").alias("display_class"))


_SEL = ["url_length", "num_dots", "entropy", "suspicious_keyword_count"]
_F = S.features("url", "host_lex", "path")


@query("class_filter", "SELECT page_id, " + ", ".join(
    (f"round({_F[c]}, 9) + 0.0" if c == "entropy" else f"CAST({_F[c]} AS DOUBLE)") + f" AS {c}" for c in _SEL)
    + f", CAST(0.0 AS DOUBLE) AS missing_feature FROM ({S.with_lex_host_path(LABELLED_SQL)}) "
    f"WHERE target = {CLASS_IDS['malware']}")
def class_filter_q(spark, sf_dir):
    """C9 + C6/C7/C8: malware rows projected to a model's feature list, a
    feature absent from the table filled with 0.0."""
    u = labelled_urls(spark, sf_dir)
    u = u.select("page_id", "target", "url", *[c.cast("double").alias(n) for c, n in
                                               zip(feature_columns("url"), FEATURE_COLS) if n in _SEL])
    m = clean.drop_non_features(clean.class_filter(u, "malware"))
    return rounded(clean.project_features(m, ["page_id", *_SEL, "missing_feature"], fill=0.0))


@query("node_ids", f"""SELECT registered_domain, CAST(row_number() OVER (ORDER BY first_id, registered_domain) - 1 AS BIGINT) AS node_id
FROM (SELECT registered_domain, min(page_id) AS first_id FROM ({LABELLED_SQL}) GROUP BY registered_domain)""")
def node_ids(spark, sf_dir):
    """Dense domain node ids in first-appearance order."""
    u = labelled_urls(spark, sf_dir)
    first = u.groupBy("registered_domain").agg(F.min("page_id").alias("first_id"))
    return GR.dense_index(first, ["first_id", "registered_domain"]).select("registered_domain", "node_id")


_DF = S.features("text", "dhost", "dpath")
_DOC_SQL = (f"SELECT d.doc_id, coalesce(CAST(CAST(l.quality * 2 + l.toxic AS INTEGER) AS VARCHAR), 'unlabelled') AS target, d.text, "
            f"regexp_extract(d.text, {S.q(r'^(?:https?://)?([^/:\?]+)')}, 1) AS dhost, "
            f"regexp_extract(d.text, {S.q(r'^(?:https?://)?[^/:\?]+(/[^\?]*)')}, 1) AS dpath "
            f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


@query("lexical_documents", "SELECT target, CAST(count(*) AS BIGINT) AS n_docs, " + ", ".join(
    f"round(avg({_DF[c]}), 6) + 0.0 AS avg_{c}" for c in FEATURE_COLS) + f" FROM ({_DOC_SQL}) GROUP BY target")
def lexical_documents(spark, sf_dir):
    """All 40 lexical functions over all whole document texts, averaged per label
    class (quality * 2 + toxic, or unlabelled); one Arrow pass counts characters."""
    d = document_table(spark, sf_dir)
    d = d.select("target", "text", char_stats_long("text").alias("_t"), char_stats_long(lexical_host("text")).alias("_h"))
    f = d.select("target", *feature_columns("text", stats=("_t", "_h")))
    return rounded(f.groupBy("target").agg(F.count(F.lit(1)).alias("n_docs"),
                                           *[F.avg(c).alias(f"avg_{c}") for c in FEATURE_COLS]), 6)
