"""Allow list, zero-day flag and rule overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ALLOW_LIST, ALLOW_VECTOR, GUARD_ENTROPY, GUARD_KEYWORDS,
                         GUARD_MIN_KEYWORDS, MALWARE_MARKERS, MALWARE_VECTOR, PHISHING_VECTOR)
from ..functions.lexical import keyword_hits, shannon_entropy


def _vec(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def allow_list_df(spark, domains=ALLOW_LIST) -> DataFrame:
    return spark.createDataFrame([(d,) for d in domains], "allow_domain string")


def flag_allowed(df: DataFrame, domain_col: str = "registered_domain",
                 allow: DataFrame | None = None, out_col: str = "is_allowed") -> DataFrame:
    """Allow-list membership.  The built-in list has 8 entries and is
    broadcast; a caller's table of any size takes the skew-safe join."""
    from .skew import skew_safe_left_join
    fixed = allow is None
    allow = allow_list_df(df.sparkSession) if fixed else allow
    a = allow.select(F.col(allow.columns[0]).alias(domain_col)).distinct().withColumn(out_col, F.lit(True))
    if fixed:
        j = df.join(F.broadcast(a.withColumnRenamed(domain_col, "_allow")),
                    F.col(domain_col) == F.col("_allow"), "left").drop("_allow")
    else:
        j = skew_safe_left_join(df, a, domain_col, None, F.xxhash64(*[F.col(c) for c in df.columns]))
    return j.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(False)))


def flag_unseen(df: DataFrame, key_col: str, known: DataFrame, out_col: str = "is_unseen",
                spread: Column | None = None) -> DataFrame:
    """Key absent from the known key set.

    The known keys are counted (one aggregate), and the lookup is skew-safe:
    keys frequent in the looked-up rows, known or not, are matched through a
    bounded broadcast, the rest by a shuffle join.
    """
    from .skew import skew_safe_left_join
    kc = known.groupBy(F.col(known.columns[0]).alias(key_col)).agg(F.count(F.lit(1)).alias("_seen_n"))
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    j = skew_safe_left_join(df, kc, key_col, "_seen_n", spread)
    return j.withColumn(out_col, F.col("_seen_n").isNull()).drop("_seen_n")


def _malware_marker(url: Column) -> Column:
    low = F.lower(url)
    hit = F.lit(False)
    for m in MALWARE_MARKERS:
        hit = hit | (F.instr(low, F.lit(m)) > 0)
    return hit


def guard_signals(url_col: str = "url") -> list[Column]:
    """U7 + U1 inputs of the guard: distinct keywords present, a malware
    marker present, Shannon entropy of the raw URL."""
    u = F.col(url_col)
    return [keyword_hits(u, GUARD_KEYWORDS).alias("guard_keywords"),
            _malware_marker(u).alias("guard_malware"),
            shannon_entropy(u).alias("guard_entropy")]


def guard_rule(url_col: str = "url", unseen_col: str = "is_unseen", signals: bool = False) -> Column:
    """Which override fires: 'malware', 'phishing' or null.  With
    ``signals=True`` the columns of ``guard_signals`` are read instead of
    being computed again."""
    u = F.col(url_col)
    if signals:
        kw, malware, ent = F.col("guard_keywords"), F.col("guard_malware"), F.col("guard_entropy")
    else:
        kw, malware, ent = keyword_hits(u, GUARD_KEYWORDS), _malware_marker(u), shannon_entropy(u)
    phish = (kw >= GUARD_MIN_KEYWORDS) | ((ent > GUARD_ENTROPY) & (kw >= 1))
    unseen = F.col(unseen_col)
    return (F.when(unseen & malware, F.lit("malware"))
            .when(unseen & phish, F.lit("phishing")))


def apply_guard(p, rule: Column) -> Column:
    """Replace the probability vector when a rule fired."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(rule == "malware", _vec(MALWARE_VECTOR))
            .when(rule == "phishing", _vec(PHISHING_VECTOR)).otherwise(p))


def allow_vector() -> Column:
    return _vec(ALLOW_VECTOR)
