"""Operator 2: exact dedup by content sort.

Texts are equal when identical after lower-casing A-Z.  Rows are dealt by sampled splitters
(``repartitionByRange`` on the first bytes of the normalised text and its 64-bit hash), sorted
externally on the whole normalised text, and each row is compared in full with its neighbour: a
change starts a new run, and a run is one group of copies.  The hash only spreads texts that begin
alike; equality is always decided by the full comparison.

Groups of copies larger than a share of a partition are dealt apart first.  Their keys come from a
pre-aggregated count and number at most ``SPREAD * partitions``, which bounds the broadcast.  Every
such group is salted into pieces below the share, each piece is sorted and compared as above, and
one representative of each run (at most ``2 * SPREAD * partitions`` rows) enters a second comparison.

Defined results: a null text counts as empty, empty texts are one group; of rows with the same
text the one with the smallest (or largest) id stays, null ids last, rows tied in the id by their
remaining columns, and exactly one of fully repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, place, positional, shuffle_partitions, staged, text_or_empty

SPREAD = 4
PREFIX = 24
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def _order(keep: str, id_col: str):
    return F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()


def _best(keep: str, c):
    return F.max(c) if keep == "largest" else F.min(c)


def _runs(df: DataFrame, by: list[str]) -> DataFrame:
    """Number the runs of equal ``norm`` within each ``by`` group of sorted rows."""
    w = Window.partitionBy(*by).orderBy("norm")
    step = F.when(F.lag("norm").over(w) == F.col("norm"), 0).otherwise(1)
    return (df.withColumn("step", step)
            .withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("step"))


def mark_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                keep: str = "smallest", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row (all by default) with keep_id, group_size, kept and text_sha256.

    ``keep`` names the row of a group that stays: "smallest" or "largest" id.
    """
    spark = docs.sparkSession
    rows, names = positional(docs)
    tc, ic = place(names, text_col), place(names, id_col)
    out = columns if columns is not None else names
    carried = [place(names, c) for c in out]
    needed = [*carried, *(c for c in dict.fromkeys([tc, ic]) if c not in carried)]
    norm = ascii_lower(text_or_empty(tc))
    rows = rows.select(*needed)
    keyed = rows.withColumn("k2", F.xxhash64(norm))

    share = max(64, docs.count() // (SPREAD * shuffle_partitions(spark)))
    hot = staged(keyed.groupBy("k2").agg(F.count("*").alias("n")).filter(F.col("n") > share)
                 .select("k2", F.ceil(F.col("n") / share).cast("int").alias("pieces")), "hot-texts")
    some_hot = bool(hot.head(1))

    def groups(df: DataFrame, by: list[str]) -> DataFrame:
        """Run-wise decisions of sorted rows; the text itself is needed no longer."""
        light = [c for c in df.columns if c in carried or c == ic]
        runs = _runs(df, by).withColumn("text_sha256", F.sha2(F.col("norm"), 256))
        runs = runs.select(*light, *by, "run", "text_sha256", *(["norm"] if "salt" in by else []))
        whole = Window.partitionBy(*by, "run")
        pick = whole.orderBy(_order(keep, ic), *[c for c in light if c != ic])
        return (runs.withColumn("rank", F.row_number().over(pick))
                .withColumn("keep_id", _best(keep, F.col(ic)).over(whole))
                .withColumn("group_size", F.count("*").over(whole)))

    cold = keyed.join(F.broadcast(hot), "k2", "left_anti") if some_hot else keyed
    cold = (cold.withColumn("k1", F.substring(norm, 1, PREFIX))
            .repartitionByRange("k1", "k2").withColumn("norm", norm))
    done = groups(cold, ["k1", "k2"]).select(
        *carried, "keep_id", "group_size", (F.col("rank") == 1).alias("kept"), "text_sha256")
    if some_hot:
        salt = F.pmod(F.monotonically_increasing_id(), F.col("pieces")).cast("int")
        pieces = (keyed.join(F.broadcast(hot), "k2").withColumn("salt", salt).drop("pieces")
                  .repartition("k2", "salt").withColumn("norm", norm))
        part = groups(pieces, ["k2", "salt"]).withColumn("norm", F.when(F.col("rank") == 1, F.col("norm")))
        part = staged(part, "hot-runs")  # the text stays with one row a run
        reps = _runs(part.filter("rank = 1").select(
            "k2", "salt", F.col("run").alias("piece_run"), "norm", F.col(ic).alias("id"),
            "keep_id", "group_size"), ["k2"])
        whole = Window.partitionBy("k2", "run")
        first = F.row_number().over(whole.orderBy(_order(keep, "id"), "salt", "piece_run"))
        reps = reps.select(
            "k2", "salt", F.col("piece_run").alias("run"), (first == 1).alias("wins"),
            _best(keep, F.col("keep_id")).over(whole).alias("keep_id"),
            F.sum("group_size").over(whole).alias("group_size"))
        marked = part.drop("keep_id", "group_size", "norm").join(reps, ["k2", "salt", "run"])
        done = done.unionByName(marked.select(
            *carried, "keep_id", "group_size",
            (F.col("wins") & (F.col("rank") == 1)).alias("kept"), "text_sha256"))
    return done.toDF(*out, *RESULT)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                keep: str = "smallest") -> DataFrame:
    """``docs`` without the copies: one whole row of each group of equal texts."""
    names = list(docs.columns)
    marked = mark_copies(docs, text_col, id_col, keep).toDF(*[f"c{i}" for i in range(len(names))], *RESULT)
    return marked.filter("kept").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
