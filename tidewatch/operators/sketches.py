"""Stored distinct counts that merge (A3, A12): one sketch a group, united without reading the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
#: Relative standard error of a sketch of 2^LG_K registers (1.04 / sqrt(k)), also of a union.
ERROR = 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, key: str, by, lg_k: int = LG_K) -> DataFrame:
    """``(by..., n_rows, sketch)``: a HyperLogLog sketch of the keys of each group (at most 2^lg_k bytes),
    combined a task before the shuffle.  Null keys are not counted."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.hll_sketch_agg(F.col(key).cast("string"), lg_k).alias("sketch"))


def united(sketches: DataFrame, by=()) -> DataFrame:
    """Sketches of coarser groups, or of all rows, from stored ones: of other days, batches or clusters too."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Groups with ``n_distinct`` in place of the sketch."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
