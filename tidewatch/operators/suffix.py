"""Registered domain and public suffix of a URL (U3, U5) by broadcast joins.

Instead of a per-row parser, the host's trailing label sequences
(``com``, ``co.uk``, ``example.co.uk`` ...) are looked up in the rule table with
one broadcast hash join per depth.  The rule table is bounded (a few thousand
keys), rows never shuffle, and the prevailing rule is picked with column
arithmetic: an exception rule wins, else the longest matching rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.suffix_rules import suffix_rules

# fixed value: a host that is a dotted quad is its own domain
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_HOST = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
IPV6_HOST = r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"
SCHEME = r"^(?:[A-Za-z0-9+\-.]+:)?//"
# fixed value: label separators other than '.', mapped to '.'
IDEOGRAPHIC_DOTS = "\u3002\uff0e\uff61"


def netloc_host(c) -> Column:
    """Host of a URL: strip scheme, path/query/fragment, userinfo and port."""
    c = F.col(c) if isinstance(c, str) else c
    rest = F.regexp_replace(c, SCHEME, "")
    auth = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    no_user = F.substring_index(auth, "@", -1)  # text after the last '@' (userinfo dropped)
    v6 = F.regexp_extract(no_user, r"^(\[[^\]]*\])", 1)  # bracketed IPv6 keeps its colons
    # ideographic and full-width full stops separate labels too
    v4 = F.translate(F.regexp_extract(no_user, r"^([^:]*)", 1), IDEOGRAPHIC_DOTS, "...")
    v4 = F.regexp_replace(v4, r"\.+$", "")  # a fully qualified host ends in a dot
    return F.when(v6 != "", v6).otherwise(v4)


def with_registered_domain(df: DataFrame, url_col: str = "url",
                           spark: SparkSession | None = None,
                           rules: tuple[DataFrame, int] | None = None,
                           domain_col: str = "registered_domain",
                           tld_col: str = "tld", stem_col: str | None = None) -> DataFrame:
    """Append ``registered_domain`` (``domain.suffix`` / ``suffix``) and ``tld``."""
    spark = spark or df.sparkSession
    rule_df, depth = rules or suffix_rules(spark)
    rule_df = F.broadcast(rule_df)  # bounded: one row per public-suffix rule key
    cols = df.columns
    host = netloc_host(url_col)
    # host, its lower-case labels and every trailing label sequence in one projection
    lab = F.split(F.lower(host), r"\.")
    out = df.select("*", host.alias("_h"), F.size(lab).alias("_n"), lab.alias("_lab"))
    out = out.select("*", *[F.when(F.col("_n") >= k, F.array_join(F.slice("_lab", -k, k), ".")).alias(f"_c{k}")
                            for k in range(1, depth + 1)])
    for k in range(1, depth + 1):
        r = rule_df.select(F.col("rule_key").alias(f"_k{k}"),
                           F.col("is_rule").alias(f"_r{k}"),
                           F.col("is_wild_parent").alias(f"_w{k}"),
                           F.col("is_exception").alias(f"_e{k}"))
        out = out.join(r, F.col(f"_c{k}") == F.col(f"_k{k}"), "left")
    # longest normal/wildcard match; an exception match at depth k means k-1
    match_len = F.lit(0)
    for k in range(1, depth + 1):
        hit = F.coalesce(F.col(f"_r{k}"), F.lit(False))
        if k >= 2:
            hit = hit | (F.coalesce(F.col(f"_w{k - 1}"), F.lit(False)) & F.col(f"_c{k}").isNotNull())
        match_len = F.when(hit, F.lit(k)).otherwise(match_len)
    exc_len = F.lit(None).cast("int")
    for k in range(depth, 0, -1):
        exc_len = F.when(F.coalesce(F.col(f"_e{k}"), F.lit(False)), F.lit(k - 1)).otherwise(exc_len)
    is_ip = F.col("_h").rlike(IPV4_HOST) | F.col("_h").rlike(IPV6_HOST)
    slen = F.when(is_ip, F.lit(0)).otherwise(F.coalesce(exc_len, match_len))
    out = out.select("*", slen.alias("_s"))
    orig = F.split(F.col("_h"), r"\.")
    suffix = F.when(F.col("_s") > 0, F.array_join(F.slice(orig, -F.col("_s"), F.col("_s")), ".")) \
        .otherwise(F.lit(""))
    stem = F.when(is_ip, F.col("_h")).when(
        F.col("_n") > F.col("_s"), F.element_at(orig, F.col("_n") - F.col("_s"))).otherwise(F.lit(""))
    out = out.select("*", suffix.alias("_t"), stem.alias("_d"))
    reg = F.when(F.col("_d") != "", F.concat_ws(".", F.col("_d"), F.col("_t"))).otherwise(F.col("_t"))
    extra = [reg.alias(domain_col), F.col("_t").alias(tld_col)]
    if stem_col:
        extra.append(F.col("_d").alias(stem_col))
    return out.select(*[F.col(c) for c in cols if c not in (domain_col, tld_col)], *extra)
