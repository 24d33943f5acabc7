"""Deterministic stratified splits and samples.

Membership is decided by the md5 of ``seed || key``: within each class, keys
stand in the order of that hash, and a key takes the part its first row falls
into (floor of 70 % of the class's rows, then half of the rest).  All rows of
one key and class share a part, whatever the partitioning; quotas are exact up
to the rows of the keys at the two cuts (exact for unique keys).  A key that
occurs in several classes is placed in each of them on its own.

Rows are never ranked.  Counts per key give counts per (class, leading hex
digits), those give the range each cut lies in, and only the keys of these
ranges are ordered; rows then compare their hash with the cuts of their class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SPLIT_SEED

ROWS_PER_RANGE = 50_000
BROADCAST_CLASSES = 10_000  # more classes than this are joined by a shuffle on (class, range)


def split_hash(key, seed: str = SPLIT_SEED) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def class_cuts(df: DataFrame, class_col: str, key_col: str, parts: list[tuple[str, Column]],
               seed: str = SPLIT_SEED) -> DataFrame:
    """One row a class: for each ``(name, quota)`` the last ``(hash, key)`` whose
    first row lies within the first ``quota`` rows (null if there is none).
    ``quota`` is an expression over ``_n``, the class's row count."""
    from ..session import materialize
    keys = df.select(F.col(class_col).alias("_c"), F.col(key_col).alias("_k")).groupBy("_c", "_k").agg(
        F.count(F.lit(1)).alias("_cnt")).withColumn("_h", split_hash("_k", seed))
    keys = materialize(keys, "split_keys")
    digits = max(2, math.ceil(math.log(keys.count() / ROWS_PER_RANGE + 1, 16)))
    keys = keys.withColumn("_b", F.coalesce(F.substring("_h", 1, digits), F.lit("")))
    by_class = Window.partitionBy("_c")
    ranges = (keys.groupBy("_c", "_b").agg(F.sum("_cnt").alias("_cnt"))
              .withColumn("_upto", F.sum("_cnt").over(by_class.orderBy("_b")))
              .withColumn("_n", F.sum("_cnt").over(by_class)))
    # the first row of the last key within a quota q has rank <= q: its range is the last with _before < q
    ranges = ranges.withColumn("_before", F.col("_upto") - F.col("_cnt"))
    for name, quota in parts:
        ranges = ranges.withColumn(f"_q_{name}", quota)
    hit = F.lit(False)
    for name, _ in parts:
        hit = hit | ((F.col("_before") < F.col(f"_q_{name}")) & (F.col("_upto") >= F.col(f"_q_{name}")))
    at = ranges.filter(hit).drop("_cnt", "_upto", "_n")
    order = Window.partitionBy("_c", "_b").orderBy("_h", "_k")
    near = (keys.withColumn("_cls", F.struct("_c")).join(at.withColumn("_cls", F.struct("_c")).drop("_c"), ["_cls", "_b"])
            .withColumn("_first", F.col("_before") + F.sum("_cnt").over(order) - F.col("_cnt")))
    cuts = [F.max(F.when(F.col("_first") < F.col(f"_q_{name}"), F.struct("_h", F.col("_k").cast("string").alias("_s"))))
            .alias(f"_cut_{name}") for name, _ in parts]
    return near.groupBy("_c").agg(*cuts)


def stratified_split(df: DataFrame, class_col: str, key_col: str, nested: bool = True,
                     train_pct: int = 70, seed: str = SPLIT_SEED, out_col: str = "split") -> DataFrame:
    """``split`` in {train, val, test} (nested) or {train, test}.

    Per class: train = floor(n * train_pct / 100) first rows, then
    val = floor(rest / 2), test = the others.
    """
    from ..session import materialize
    n_train = F.floor(F.col("_n") * train_pct / 100)
    parts = [("train", n_train)]
    if nested:
        parts.append(("val", n_train + F.floor((F.col("_n") - n_train) / 2)))
    cuts = materialize(class_cuts(df, class_col, key_col, parts, seed), "split_cuts")
    place = F.struct(split_hash(key_col, seed).alias("_h"), F.col(key_col).cast("string").alias("_s"))
    label = F.lit("test")
    for name, _ in reversed(parts):
        label = F.when(place <= F.col(f"_cut_{name}"), F.lit(name)).otherwise(label)
    # one row a class; counted before it is broadcast, else shuffled by class and hash range
    same = F.col(class_col).eqNullSafe(F.col("_c"))
    if cuts.count() <= BROADCAST_CLASSES:
        joined = df.join(F.broadcast(cuts), same, "left")
    else:
        spread = cuts.withColumn("_r", F.explode(F.array(*[F.lit(c) for c in "0123456789abcdef"])))
        joined = df.withColumn("_hr", F.coalesce(F.substring(split_hash(key_col, seed), 1, 1), F.lit("0"))).join(
            spread, same & (F.col("_hr") == F.col("_r")), "left")
    return joined.select(*df.columns, label.alias(out_col))


def bernoulli_split(df: DataFrame, key_col: str, train_pct: int = 70, seed: str = SPLIT_SEED,
                    out_col: str = "split", nested: bool = True) -> DataFrame:
    """Approximate split with no shuffle: the leading 32 bits of the hash
    against the quota (expected, not exact, fractions)."""
    u = F.conv(F.substring(split_hash(key_col, seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    t = train_pct / 100.0
    if nested:
        s = F.when(u < t, "train").when(u < t + (1 - t) / 2, "val").otherwise("test")
    else:
        s = F.when(u < t, "train").otherwise("test")
    return df.withColumn(out_col, s)


def first_k_per_group(df: DataFrame, group_cols, order_cols, k: int, out_col: str = "rn") -> DataFrame:
    """``row_number() <= k`` per group.  Spark plans a partial WindowGroupLimit
    before the shuffle, so each task forwards at most k rows per group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(out_col, F.row_number().over(w)).filter(F.col(out_col) <= k)
