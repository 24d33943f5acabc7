"""Queries over the lexical feature functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import FEATURE_COLS
from ..functions.lexical import feature_columns
from ..sources.tables import URLS_SQL, url_table
from . import query, rounded

COUNT_COLS = FEATURE_COLS[:23]
STAT_COLS = FEATURE_COLS[23:33]
SUSP_COLS = FEATURE_COLS[33:]


def _features(spark, sf_dir):
    urls = url_table(spark, sf_dir)
    return urls.select("page_id", "url", "type", *feature_columns("url"))


def _feature_sql(cols):
    f = S.features("url")
    parts = []
    for c in cols:
        e = f[c]
        if c in FEATURE_COLS[23:28] or c in ("vowel_ratio", "consonant_ratio", "letter_ratio"):
            e = f"round({e}, 9) + 0.0"
        parts.append(f"{e} AS {c}")
    return (f"WITH u AS ({URLS_SQL}), h AS (SELECT *, {S.host_path_select('url')} FROM u) "
            f"SELECT page_id, url, " + ", ".join(parts) + " FROM h")


@query("lexical_counts", _feature_sql(COUNT_COLS))
def lexical_counts(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", "url", *COUNT_COLS)


@query("lexical_stats", _feature_sql(STAT_COLS))
def lexical_stats(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("page_id", "url", *STAT_COLS))


@query("lexical_suspicious", _feature_sql(SUSP_COLS))
def lexical_suspicious(spark, sf_dir):
    return _features(spark, sf_dir).select("page_id", "url", *SUSP_COLS)


def _by_class_sql():
    f = S.features("url")
    inner = ", ".join(f"{f[c]} AS {c}" for c in FEATURE_COLS)
    aggs = ", ".join(f"round(avg({c}), 6) + 0.0 AS avg_{c}" for c in FEATURE_COLS)
    return (f"WITH u AS ({URLS_SQL}), h AS (SELECT *, {S.host_path_select('url')} FROM u), "
            f"f AS (SELECT type, {inner} FROM h) "
            f"SELECT type, CAST(count(*) AS BIGINT) AS n_urls, {aggs} FROM f GROUP BY type")


@query("features_by_class", _by_class_sql())
def features_by_class(spark, sf_dir):
    """Flagship: class-wise mean of all 40 features (partial + final hash agg)."""
    feats = _features(spark, sf_dir)
    aggs = [F.avg(c).alias(f"avg_{c}") for c in FEATURE_COLS]
    return rounded(feats.groupBy("type").agg(F.count(F.lit(1)).alias("n_urls"), *aggs), 6)
