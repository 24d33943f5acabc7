"""Queries over cleaning, suffix resolution and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import CLASS_IDS
from ..operators import clean, split
from ..operators.suffix import with_registered_domain
from ..sources.tables import DIRTY_SQL, URLS_SQL, dirty_url_table, url_table
from . import query, rounded

_COIN_SQL = "substr(md5('42' || {u}), 1, 1) >= '8'"
_NORM_SQL = "regexp_replace(regexp_replace(url, '(?i)^https?://(www\\.)?', ''), '/+$', '')"


def _schemeless(spark, sf_dir):
    """Pages with the serving normaliser applied: URLs without a scheme."""
    return url_table(spark, sf_dir).withColumn("url", clean.normalise_url("url"))


_SCHEMELESS_SQL = f"SELECT page_id, {_NORM_SQL} AS url, type FROM ({URLS_SQL})"
_BIAS_SQL = (f"SELECT page_id, CASE WHEN type = 'benign' AND NOT starts_with(url, 'http') THEN "
             f"CASE WHEN {_COIN_SQL.format(u='url')} THEN 'https://www.' || url ELSE 'http://' || url END "
             f"ELSE url END AS url, type FROM ({_SCHEMELESS_SQL})")


@query("normalise_url", f"SELECT page_id, url AS raw_url, {_NORM_SQL} AS url FROM ({URLS_SQL})")
def normalise_url(spark, sf_dir):
    u = url_table(spark, sf_dir)
    return u.select("page_id", F.col("url").alias("raw_url"), clean.normalise_url("url").alias("url"))


@query("bias_fix", _BIAS_SQL)
def bias_fix(spark, sf_dir):
    return clean.bias_fix(_schemeless(spark, sf_dir))


@query("scheme_share",
       f"SELECT type = 'benign' AS is_benign, round(avg(CAST(starts_with(url, 'http') AS DOUBLE)), 9) + 0.0 "
       f"AS share_with_scheme, count(*) AS n_rows FROM ({_BIAS_SQL}) GROUP BY 1")
def scheme_share(spark, sf_dir):
    return rounded(clean.scheme_share(clean.bias_fix(_schemeless(spark, sf_dir))))


_MAP_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASS_IDS.items())


@query("clean_encode",
       f"SELECT page_id, url, lower(trim(type)) AS type, CAST(CASE lower(trim(type)) {_MAP_SQL} END AS INTEGER) "
       f"AS target FROM ({DIRTY_SQL}) WHERE url IS NOT NULL AND type IS NOT NULL "
       f"AND regexp_matches(url, '\\S') AND lower(trim(type)) IN ('benign','defacement','phishing','malware')")
def clean_encode(spark, sf_dir):
    return clean.encode_target(clean.validate_and_clean(dirty_url_table(spark, sf_dir)))


@query("suffix_domain",
       f"WITH {S.suffix_ctes(URLS_SQL)} SELECT page_id, url, host, registered_domain, tld, stem FROM dom")
def suffix_domain(spark, sf_dir):
    from ..operators.suffix import netloc_host
    u = url_table(spark, sf_dir).withColumn("host", netloc_host("url"))
    return with_registered_domain(u, stem_col="stem").select(
        "page_id", "url", "host", "registered_domain", "tld", "stem")


_SPLIT_SQL = """SELECT page_id, url, type, CASE WHEN rk <= n * 70 // 100 THEN 'train'
  WHEN rk <= n * 70 // 100 + (n - n * 70 // 100) // 2 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, rank() OVER (PARTITION BY type ORDER BY md5('42' || url), url) AS rk,
               count(*) OVER (PARTITION BY type) AS n FROM ({src}))"""


@query("strat_split", _SPLIT_SQL.format(src=URLS_SQL))
def strat_split(spark, sf_dir):
    return split.stratified_split(url_table(spark, sf_dir), "type", "url").select(
        "page_id", "url", "type", "split")


_LI_SRC = ("SELECT l_orderkey, l_linenumber, l_returnflag, "
           "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS k FROM lineitem")


@query("strat_split_lineitem",
       """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN rk <= n * 70 // 100 THEN 'train'
  ELSE 'test' END AS split
  FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY md5('42' || k), k) AS rk,
               count(*) OVER (PARTITION BY l_returnflag) AS n FROM (""" + _LI_SRC + "))")
def strat_split_lineitem(spark, sf_dir):
    """P1 at table scale (70/30 per return flag): rows are labelled in place."""
    from ..plans.prepare import lineitem_rows
    li = lineitem_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "row_key")
    return split.stratified_split(li, "l_returnflag", "row_key", nested=False).drop("row_key")


@query("split_sizes",
       "SELECT type, split, CAST(count(*) AS BIGINT) AS n_rows FROM (" + _SPLIT_SQL.format(src=URLS_SQL)
       + ") GROUP BY type, split")
def split_sizes(spark, sf_dir):
    s = split.stratified_split(url_table(spark, sf_dir), "type", "url")
    return s.groupBy("type", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("bernoulli_split",
       f"SELECT page_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split "
       f"FROM (SELECT page_id, CAST(('0x' || substr(md5('42' || url), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u "
       f"FROM ({URLS_SQL}))")
def bernoulli_split(spark, sf_dir):
    return split.bernoulli_split(url_table(spark, sf_dir), "url").select("page_id", "split")


_RISK = "CAST(CASE WHEN type <> 'benign' THEN 0.95 ELSE 0.05 END AS DOUBLE)"


@query("head_per_group", f"""WITH {S.suffix_ctes(URLS_SQL)},
fs AS (SELECT type, stem, min(page_id) AS first_id FROM dom GROUP BY type, stem),
st AS (SELECT type, stem FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY first_id) AS r FROM fs) WHERE r <= 2),
pr AS (SELECT d.page_id, d.url, d.type, st.stem AS sample_stem FROM dom d JOIN st ON d.type = st.type
       WHERE strpos(d.url, st.stem) > 0)
SELECT page_id, url, type AS label, sample_stem, {_RISK} AS risk FROM
  (SELECT *, row_number() OVER (PARTITION BY type, sample_stem ORDER BY page_id) AS r FROM pr) WHERE r <= 3""")
def head_per_group(spark, sf_dir):
    """Two first-seen domain stems per class, first three URLs of each."""
    d = with_registered_domain(url_table(spark, sf_dir), stem_col="stem")
    first = d.groupBy("type", "stem").agg(F.min("page_id").alias("first_id"))
    stems = split.first_k_per_group(first, ["type"], ["first_id"], 2).select(
        "type", F.col("stem").alias("sample_stem"))
    # bounded broadcast: at most two stems per class
    pairs = d.join(F.broadcast(stems), "type").filter(F.instr("url", F.col("sample_stem")) > 0)
    top = split.first_k_per_group(pairs, ["type", "sample_stem"], ["page_id"], 3)
    return top.select("page_id", "url", F.col("type").alias("label"), "sample_stem",
                      F.when(F.col("type") != "benign", 0.95).otherwise(0.05).alias("risk"))
