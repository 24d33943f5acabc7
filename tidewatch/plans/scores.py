"""Score table shared by fusion, guard and evaluation queries.

``p_graph``: reputation of the URL's path key with host and global fallback
(the legacy graph engine).  ``p_lex``: the same count-based reputation keyed
by a lexical signature (scheme flag, query parameters, fragments, subdomain
depth): a deterministic, SQL-checkable stand-in for the lexical model, so
fusion and metric operators can be verified exactly.  Trained models (M1,
M2) produce the same columns in ``plans.models``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import feature_columns
from ..functions.probs import prob_array
from ..operators.reputation import reputation
from ..session import input_signature, stage_table
from .prepare import labelled_urls

CLS = [0, 1, 2, 3]
SIG_FEATURES = ["https_flag", "query_param_count", "num_hash", "subdomain_count"]


def lexical_signature() -> F.Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in SIG_FEATURES])


def scored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table (written once per session and input)."""
    key = input_signature(f"{sf_dir}/pages.parquet")
    return stage_table(spark, "scored_urls", key, lambda: _scored_urls(spark, sf_dir), ["split"])


def _scored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = labelled_urls(spark, sf_dir)
    f = u.select("page_id", "url", "target", "split", "path_key", "host", "registered_domain",
                 *[c for c in feature_columns("url")])
    f = f.withColumn("lex_sig", lexical_signature()).withColumn(
        "sig_parent", F.col("https_flag").cast("string"))
    base = f.select("page_id", "url", "target", "split", "path_key", "host", "registered_domain",
                    "lex_sig", "sig_parent")
    g = reputation(base, "path_key", "host", "target", CLS, spread=F.xxhash64("url"))
    g = g.select(*base.columns, prob_array([f"domain_class_{i}_prob" for i in CLS]).alias("p_graph"))
    lx = reputation(g, "lex_sig", "sig_parent", "target", CLS, spread=F.xxhash64("url"))
    lx = lx.select(*g.columns, prob_array([f"domain_class_{i}_prob" for i in CLS]).alias("p_lex"))
    return lx.drop("lex_sig", "sig_parent")
