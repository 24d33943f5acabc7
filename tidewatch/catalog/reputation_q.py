"""Queries over aggregations and reputation lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import CLASS_IDS, FEATURE_COLS
from ..operators import reputation as R
from ..plans.prepare import PATH_KEY, labelled_urls, lineitem_labelled
from ..sources.tables import URLS_SQL
from . import query, rounded

CLS = [0, 1, 2, 3]
_MAP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASS_IDS.items())
TARGET_SQL = f"SELECT page_id, url, type, CAST(CASE type {_MAP} END AS INTEGER) AS target FROM ({URLS_SQL})"
LABELLED_SQL = (f"SELECT d.* EXCLUDE (stem), regexp_extract(url, {S.q(PATH_KEY)}, 1) AS path_key FROM "
                f"(WITH {S.suffix_ctes(S.split_sql(TARGET_SQL, 'target', 'url'))} SELECT * FROM dom) d")
LINEITEM_SQL = S.split_sql(
    "SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_returnflag, "
    "CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS row_key, s.s_nationkey "
    "FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey", "l_returnflag", "row_key", nested=False)


@query("class_dist", f"SELECT target, CAST(count(*) AS BIGINT) AS n_rows FROM ({TARGET_SQL}) GROUP BY target")
def class_dist(spark, sf_dir):
    return R.class_distribution(labelled_urls(spark, sf_dir), "target")


@query("class_priors", "SELECT " + ", ".join(
    f"round(sum(CASE WHEN target = {i} THEN 1 ELSE 0 END) / count(*), 9) + 0.0 AS prior_{i}" for i in CLS)
    + f" FROM ({LABELLED_SQL}) WHERE split = 'train'")
def class_priors(spark, sf_dir):
    u = labelled_urls(spark, sf_dir)
    return rounded(R.class_priors(u.filter(F.col("split") == "train"), "target", CLS))


@query("dataset_info",
       f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(FEATURE_COLS)} AS BIGINT) AS n_features, "
       f"CAST(count(DISTINCT registered_domain) AS BIGINT) AS n_domains, "
       f"CAST(count(DISTINCT host) AS BIGINT) AS n_hosts FROM ({LABELLED_SQL})")
def dataset_info(spark, sf_dir):
    """A3 + A12: rows, feature count, distinct domains and hosts (one agg)."""
    u = labelled_urls(spark, sf_dir)
    return u.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(FEATURE_COLS)).cast("long").alias("n_features"),
                 F.countDistinct("registered_domain").alias("n_domains"),
                 F.countDistinct("host").alias("n_hosts"))


_CT_SQL = (f"SELECT host, CAST(count(*) AS BIGINT) AS dom_n, " + ", ".join(
    f"CAST(sum(CASE WHEN target = {i} THEN 1 ELSE 0 END) AS BIGINT) AS dom_cnt_{i}" for i in CLS)
    + ", " + ", ".join(f"round(sum(CASE WHEN target = {i} THEN 1 ELSE 0 END) / count(*), 9) + 0.0 AS dom_prob_{i}"
                       for i in CLS)
    + f" FROM ({LABELLED_SQL}) WHERE split = 'train' GROUP BY host")


@query("key_crosstab", _CT_SQL)
def key_crosstab(spark, sf_dir):
    """Per host class counts and probabilities on train."""
    u = labelled_urls(spark, sf_dir).filter(F.col("split") == "train")
    s = R.key_class_stats(u, "host", "target", CLS, "dom").drop("dom_entropy")
    return rounded(s)


@query("key_class_entropy",
       "SELECT host, round(coalesce(-(" + " + ".join(
           f"CASE WHEN c{i} > 0 THEN (c{i} / n) * log2(c{i} / n) ELSE 0 END" for i in CLS)
       + "), 0.0), 9) + 0.0 AS dom_entropy FROM (SELECT host, count(*) AS n, " + ", ".join(
           f"sum(CASE WHEN target = {i} THEN 1 ELSE 0 END) AS c{i}" for i in CLS)
       + f" FROM ({LABELLED_SQL}) WHERE split = 'train' GROUP BY host)")
def key_class_entropy(spark, sf_dir):
    """Entropy of each host's class distribution."""
    u = labelled_urls(spark, sf_dir).filter(F.col("split") == "train")
    return rounded(R.key_class_stats(u, "host", "target", CLS, "dom").select("host", "dom_entropy"))


@query("reputation_legacy",
       "WITH " + S.reputation_sql(LABELLED_SQL, "registered_domain", "tld", "target", CLS,
                                  ["page_id", "url", "registered_domain", "tld"]))
def reputation_legacy(spark, sf_dir):
    """J1-J3 as the reference configures them: registered domain -> suffix -> global."""
    u = labelled_urls(spark, sf_dir).select("page_id", "url", "registered_domain", "tld", "target", "split")
    r = R.reputation(u, "registered_domain", "tld", "target", CLS, spread=F.xxhash64("url"))
    return rounded(r.drop("target", "split"))


@query("reputation_fallback",
       "WITH " + S.reputation_sql(LABELLED_SQL, "path_key", "host", "target", CLS,
                                  ["page_id", "url", "path_key", "host"]))
def reputation_fallback(spark, sf_dir):
    """J1-J3 with a fine key (host + first path segment) and host as parent:
    many test keys are unseen in train, so every fallback level is used."""
    u = labelled_urls(spark, sf_dir).select("page_id", "url", "path_key", "host", "target", "split")
    r = R.reputation(u, "path_key", "host", "target", CLS, spread=F.xxhash64("url"))
    return rounded(r.drop("target", "split"))


_LI_CLS = ["A", "N", "R"]


@query("reputation_lineitem",
       "WITH " + S.reputation_sql(LINEITEM_SQL, "l_suppkey", "s_nationkey", "l_returnflag", _LI_CLS,
                                  ["l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey"]))
def reputation_lineitem(spark, sf_dir):
    """Reputation at table scale: supplier -> nation -> global over lineitem."""
    li = lineitem_labelled(spark, sf_dir)
    r = R.reputation(li, "l_suppkey", "s_nationkey", "l_returnflag", _LI_CLS,
                     spread=F.xxhash64("row_key"))
    return rounded(r.select("l_orderkey", "l_linenumber", "l_suppkey", "s_nationkey",
                            *R.reputation_columns(len(_LI_CLS))))
