"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character keeps its bytes."""
    return F.translate(c, UPPER, LOWER)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the readers nothing but a reread.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns renamed c0, c1, ... so that no input name clashes with a working column."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), list(df.columns)


def place(names: list[str], name: str) -> str:
    """Working name of input column ``name`` after :func:`positional`."""
    return f"c{names.index(name)}"


SPREAD = 4


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key, ``count`` = rows of that key).

    Keys with more than a share of a partition are joined by broadcast: there are at most
    ``SPREAD * partitions`` of them.  The others are shuffled, each small against a partition.
    """
    share = max(1000, total // (SPREAD * shuffle_partitions(rows.sparkSession)))
    hot = keyed.filter(F.col(count) > share)
    cold = keyed.filter(F.col(count) <= share)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return near.unionByName(far)
