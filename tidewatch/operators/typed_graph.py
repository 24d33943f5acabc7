"""Message passing and neighbourhoods on typed nodes and edges.

Nodes are ``(node_type, node, x)`` with vectors whose length depends on the type alone; edges are
``(edge_type, src, dst)`` between node keys that carry their type (:func:`node_key`), in both directions.
Every lookup along an edge is skew-safe: a domain with a third of all URLs is the source of as many edges.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys_of, skew_safe_left_join


def node_key(node_type: str | Column, node: Column) -> Column:
    """Key of a node among all types."""
    t = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(t, F.lit(":"), node.cast("string"))


def typed_edges(df: DataFrame, url_key: str = "page_id", domain: str = "registered_domain", tld: str = "tld") -> DataFrame:
    """URL-domain and distinct domain-suffix edges, both ways, as ``(edge_type, src, dst)``."""
    u, d, t = node_key("url", F.col(url_key)), node_key("domain", F.col(domain)), node_key("tld", F.col(tld))
    up = df.select(F.lit("url_domain").alias("edge_type"), u.alias("src"), d.alias("dst"))
    side = df.select(F.lit("domain_tld").alias("edge_type"), d.alias("src"), t.alias("dst")).distinct()
    edges = up.unionByName(side)
    back = edges.select(F.concat(F.lit("rev_"), "edge_type").alias("edge_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(back).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def _dot(row: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)


def typed_layer(nodes: DataFrame, edges: DataFrame, weights: DataFrame, relu: bool = True) -> DataFrame:
    """One round of mean aggregation: for each edge type ``W_mean * (mean of its sources) + W_self * x + b``, then the
    mean over the edge types that lead to the node's type, then ReLU; ``nodes`` with new vectors.

    ``weights``: one row an edge type, ``(edge_type, dst_type, w_mean, w_self, bias)``.  A node without an
    edge of some type has the mean 0 there; a type that no edge type leads to has no row.
    """
    n = nodes.select("node_type", "node", node_key(F.col("node_type"), F.col("node")).alias("key"), F.col("x").cast("array<double>").alias("x"))
    hot = hot_keys_of(edges, ["src"])["src"]
    spread = F.xxhash64("edge_type", "src", "dst")
    sent = skew_safe_left_join(edges, n.select(F.col("key").alias("src"), F.col("x").alias("x_src")), "src", None, spread, hot=hot)
    # one partial mean a task, node and edge type: a hub's vectors are combined before the shuffle
    means = sent.filter(F.col("x_src").isNotNull()).groupBy("dst", "edge_type").agg(
        Summarizer.mean(array_to_vector("x_src")).alias("m")).select(F.col("dst").alias("key"), "edge_type", vector_to_array("m").alias("mean"))
    # one row a node and edge type that leads to its type; the weights are one row an edge type
    w = F.broadcast(weights.withColumnRenamed("dst_type", "node_type"))
    t = n.join(w, "node_type").join(means, ["key", "edge_type"], "left")
    conv = F.transform("bias", lambda b, i: b + F.coalesce(_dot(F.get("w_mean", i), F.col("mean")), F.lit(0.0))
                       + _dot(F.get("w_self", i), F.col("x")))
    each = t.select("node_type", "node", "edge_type", conv.alias("c"))
    # at most as many vectors a node as there are edge types
    both = each.groupBy("node_type", "node").agg(F.sort_array(F.collect_list(F.struct("edge_type", "c"))).alias("cs"))
    total = F.aggregate(F.slice("cs", F.lit(2), F.greatest(F.size("cs") - 1, F.lit(0))), F.get("cs", F.lit(0))["c"],
                        lambda a, s: F.zip_with(a, s["c"], lambda p, q: p + q))
    out = F.transform(total, lambda v: F.greatest(v / F.size("cs"), F.lit(0.0)) if relu else v / F.size("cs"))
    return both.select("node_type", "node", out.alias("x"))


def typed_layers(nodes: DataFrame, edges: DataFrame, weights: list[DataFrame]) -> DataFrame:
    """Rounds one after the other; the vectors are written between them."""
    from ..session import materialize
    for i, w in enumerate(weights):
        nodes = typed_layer(nodes, edges, w)
        if i < len(weights) - 1:
            nodes = materialize(nodes, "typed_layer")
    return nodes


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """``(node, distance)`` of every node within ``depth`` edges of a seed (column ``node``), or of all that
    can be reached.

    Each step follows the edges of the nodes found last, leaves out what has been found before, and writes
    what is new; it ends where nothing is.
    """
    from ..session import materialize
    hot = hot_keys_of(edges, ["src"])["src"]
    spread = F.xxhash64("src", "dst")
    front = materialize(seeds.select("node").filter("node IS NOT NULL").distinct().withColumn("distance", F.lit(0)), "front")
    found, d = front, 0
    while depth is None or d < depth:
        d += 1
        last = front.select(F.col("node").alias("src"), F.lit(True).alias("_last"))
        step = skew_safe_left_join(edges.select("src", "dst"), last, "src", None, spread, hot=hot).filter("_last")
        new = step.select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        front = materialize(new.withColumn("distance", F.lit(d)), "front")
        if front.limit(1).count() == 0:
            break
        found = found.unionByName(front)
    return found
