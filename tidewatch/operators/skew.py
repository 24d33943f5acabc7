"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, key: str, fraction: float, weight: Column | None = None) -> DataFrame:
    """Keys holding at least ``fraction`` of ``rows``: at most ``1 / fraction``
    keys qualify (their counts sum to the total), so the result has a proven
    size bound and may be broadcast.  Counts are combined map-side first."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(n.alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))  # one-row side
            .filter(F.col("_n") >= F.lit(fraction) * F.col("_total")).select(key))


def hot_keys_of(rows: DataFrame, keys, fraction: float = 1e-4) -> dict[str, DataFrame]:
    """:func:`hot_keys` of several columns from one pass over ``rows``, written: at most ``1 / fraction`` keys a
    column.  Joins that follow each other take theirs from here; counted on their own input, each would
    run the joins before it once more.  None for a stream, which cannot be counted ahead."""
    from ..session import materialize
    if rows.isStreaming:
        return {k: None for k in keys}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))
                               for i, c in enumerate(keys)]))
    n = rows.select(each.alias("e")).filter("e.v IS NOT NULL").groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("k").agg(F.sum("n").alias("total"))  # one row a column
    found = materialize(n.join(F.broadcast(total), "k").filter(F.col("n") >= F.lit(fraction) * F.col("total")).select("k", "v"),
                        "hot_keys")
    return {c: found.filter(F.col("k") == i).select(F.col("v").cast(rows.schema[c].dataType).alias(c))
            for i, c in enumerate(keys)}


def skew_safe_left_join(big: DataFrame, stats: DataFrame, key: str, count_col: str | None,
                        spread: Column, hot_fraction: float = 1e-4, hot: DataFrame | None = None) -> DataFrame:
    """``big LEFT JOIN stats USING (key)`` where ``stats`` is unique per key.

    Hot keys are found in the rows being joined, whether ``stats`` knows them or
    not; their (bounded) stats rows are broadcast.  For the shuffled join of the
    other keys the hot rows get a non-matching join key spread by ``spread`` (a
    deterministic per-row hash), so no reducer receives a hot key's rows in one
    piece.  NULL keys are spread the same way.  A stream cannot be counted ahead:
    there the keys that are hot in ``count_col`` of the stats are taken.  ``hot``: these
    keys, where they are known already (:func:`hot_keys_of`).

    The cold side is joined on ``key`` as it stands: bucketed by it (``session.bucketed_table``), it does
    not move.
    """
    stat_cols = [c for c in stats.columns if c != key]
    if hot is not None:
        pass
    elif big.isStreaming:
        hot = hot_keys(stats, key, hot_fraction, F.col(count_col)) if count_col else stats.limit(0).select(key)
    else:
        hot = hot_keys(big, key, hot_fraction)
    hot = hot.join(stats, key, "left")
    hot_b = F.broadcast(hot.select(F.col(key).alias("_hk"), F.lit(True).alias("_is_hot"),
                                   *[F.col(c).alias(f"_h_{c}") for c in stat_cols]))
    b = big.join(hot_b, big[key] == F.col("_hk"), "left").drop("_hk")
    # hot rows and NULL keys (which never match) get a spread, non-matching key
    spread_key = F.concat(F.lit("\u0000hot:"), F.pmod(spread, F.lit(1 << 20)).cast("string"))
    jk = F.when(F.col("_is_hot") | F.col(key).isNull(), spread_key).otherwise(F.col(key).cast("string"))
    cold = stats.select(F.col(key).cast("string").alias("_ck"),
                        *[F.col(c).alias(f"_c_{c}") for c in stat_cols])
    j = b.withColumn("_jk", jk).join(cold, F.col("_jk") == F.col("_ck"), "left")
    out = [F.col(c) for c in big.columns]
    out += [F.when(F.col("_is_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c)
            for c in stat_cols]
    return j.select(*out)


def skew_safe_semi_join(big: DataFrame, keys: DataFrame, key: str, spread: Column,
                        hot_fraction: float = 1e-4) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys``, balanced as the join above."""
    known = keys.select(key).distinct().withColumn("_known", F.lit(True))
    return skew_safe_left_join(big, known, key, None, spread, hot_fraction).filter(F.col("_known")).drop("_known")
