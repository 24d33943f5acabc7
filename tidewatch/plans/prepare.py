"""Shared preparation: labelled URL table with split and suffix keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, split
from ..operators.suffix import netloc_host, with_registered_domain
from ..session import input_signature, stage_table
from ..sources.tables import read_table, url_table

# fixed value: domain key of the fallback runs = host plus first path segment
PATH_KEY = r"^https?://([^/]+/[^/?#]+)"


def labelled_urls(spark: SparkSession, sf_dir: str, nested: bool = True) -> DataFrame:
    """``page_id, url, type, target, split, host, path_key, registered_domain, tld``
    (written once per session and input under the checkpoint directory)."""
    key = (nested, input_signature(f"{sf_dir}/pages.parquet"))
    return stage_table(spark, "labelled_urls", key, lambda: _labelled_urls(spark, sf_dir, nested), ["split"])


def _labelled_urls(spark: SparkSession, sf_dir: str, nested: bool) -> DataFrame:
    u = clean.encode_target(clean.validate_and_clean(url_table(spark, sf_dir)))
    u = split.stratified_split(u, "target", "url", nested=nested)
    u = u.withColumn("host", netloc_host("url")).withColumn(
        "path_key", F.regexp_extract("url", PATH_KEY, 1))
    return with_registered_domain(u)


def lineitem_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows keyed by supplier with parent nation, split 70/30."""
    key = input_signature(f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet")
    return stage_table(spark, "lineitem_labelled", key, lambda: _lineitem_labelled(spark, sf_dir), ["split"])


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("row_key"))


def _lineitem_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey"))
    li = lineitem_rows(spark, sf_dir).join(sup, "l_suppkey", "left")
    return split.stratified_split(li, "l_returnflag", "row_key", nested=False)
