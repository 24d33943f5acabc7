"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): equal root if and only if connected.

    Each round every node points to the neighbour (or itself) of the smallest rank, pointers are
    followed twice doubled, and links are rewritten to what their ends point to; links inside one
    node vanish.  Even rounds rank nodes by number, which ends stars around a smallest node at once;
    odd rounds rank them by a hash, which keeps pointer chains short and so shrinks links of any
    shape by a constant factor.  Rounds are written to the shared folder; pointers are joined by
    shuffle at every size.
    """
    edges = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    root = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                  .withColumn("root", F.col("node")), "roots")
    turn = 0
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))

        def rank(c):
            return F.struct((F.xxhash64(c, F.lit(turn)) if turn % 2 else F.col(c)).alias("h"), F.col(c).alias("to"))

        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        own = rank("a")
        step = staged(best.select("a", F.least("best", own)["to"].alias("p")), f"pointers{turn}")
        for _ in range(2):
            nxt = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = step.join(nxt.hint("merge"), ["p"]).select("a", F.col("q").alias("p"))
        step = staged(step, f"jumped{turn}")
        at = step.select(F.col("a").alias("b"), F.col("p").alias("q"))
        ends = edges.join(step.hint("merge"), ["a"]).join(at.hint("merge"), ["b"])
        edges = staged(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
                       .filter("a <> b").distinct(), f"links{turn}")
        moved = step.select(F.col("a").alias("root"), "p")
        root = staged(root.join(moved.hint("merge"), ["root"], "left")
                      .select("node", F.coalesce("p", "root").alias("root")), f"roots{turn}")
        turn += 1
    return root
