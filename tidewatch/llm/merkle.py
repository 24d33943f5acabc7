"""Merkle manifest of a data set, stored every few levels, with proofs by recomputation.

One tree a source, one more over the sources' roots.  A leaf is the SHA-256 of a row's fields, each
prefixed with its byte count.  Only every ``stride``-th level is written, cut into aligned subtrees
of ``fanout ** stride`` nodes, one row each.  A proof needs the levels between: they are computed
again within a subtree from its stored nodes, give each node its siblings, and are not kept.  The
siblings above come from the next stored level, joined a subtree (not a leaf) at a time.

Built-in columns only.  Rows are dealt by range over (source, id, leaf, a row number), so a source
with a third of all rows spreads over its share of the partitions; places within a source are
partition offsets plus a rank inside the partition.  Groups are subtrees: at most ``fanout **
stride`` digests.  No broadcast; every joined key is a (tree, part) or a tree's single top row.

Rows: a null field counts as ``-``, so null and empty differ; null ids come first in their source;
a null source is a source of its own, ahead of all; rows with equal ids stand in the order of their
leaves, and fully equal rows are leaves of their own (interchangeable).  An empty table has no root
and gives no rows.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

FANOUT, STRIDE = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def digest(c: Column) -> Column:
    """Lower-case hex SHA-256 of a string."""
    return F.sha2(c.cast("binary"), 256)


def leaf(fields) -> Column:
    """Digest of columns, each ``-`` if null, else byte count, ``:`` and value."""
    def one(c):
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return digest(F.concat(*[one(F.col(c) if isinstance(c, str) else c) for c in fields]))


def fold(start: Column, path: Column) -> Column:
    """Root that ``start`` leads to by the siblings of ``path``."""
    return F.aggregate(path, start, lambda h, p: digest(F.concat(p["before"], h, p["after"])))


def siblings(path: Column) -> Column:
    """Text of all siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


@dataclass
class Tree:
    """Stored levels of one or many trees: ``(tree, part, final, steps, nodes[, rows])``, a row a subtree."""
    levels: list
    tops: DataFrame  #: (tree, top)
    fanout: int
    stride: int


@dataclass
class Manifest:
    """``sources``: a tree a source; ``whole``: the tree over their roots."""
    sources: Tree
    whole: Tree

    def subroots(self) -> DataFrame:
        """``(tree, top)`` a source; ``tree`` is empty for null, else ``=`` and the source."""
        return self.sources.tops

    def root(self) -> DataFrame:
        return self.whole.tops.select(F.col("top").alias("root"))


def _up(nodes: Column, fanout: int) -> Column:
    """Digests of consecutive runs of ``fanout`` nodes; the last run may be shorter."""
    last = ((F.size(nodes) - 1) / F.lit(fanout)).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, fanout), "")))


def _interior(nodes: Column, steps: Column, fanout: int, stride: int) -> Column:
    """Levels of a subtree from its stored nodes up to its top: ``steps + 1`` arrays."""
    count = F.slice(F.array(*[F.lit(i) for i in range(stride)]), F.lit(1), steps)
    return F.aggregate(count, F.array(nodes),
                       lambda a, _: F.concat(a, F.array(_up(F.element_at(a, -1), fanout))))


def _path(levels: Column, at: Column, steps: Column, fanout: int, stride: int) -> Column:
    """Siblings of node ``at`` at each level of its subtree, before and after it."""
    def step(i):
        own = F.floor(at / F.element_at(F.array(*[F.lit(fanout ** j) for j in range(stride)]), i + 1)).cast("int")
        level, place = F.element_at(levels, i + 1), own % fanout
        return F.struct(F.array_join(F.slice(level, own - place + 1, place), "").alias("before"),
                        F.array_join(F.slice(level, own + 2, fanout - 1 - place), "").alias("after"))
    return F.transform(F.slice(F.array(*[F.lit(i) for i in range(stride)]), F.lit(1), steps), step)


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place within ``tree`` by ``order``, and ``total``, its tree's leaves."""
    parts = shuffle_partitions(leaves.sparkSession)
    dealt = staged(leaves.repartitionByRange(parts, "tree", *order).withColumn("pid", F.spark_partition_id()),
                   "merkle-dealt")
    counts = dealt.groupBy("pid", "tree").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition that a tree touches
    before = Window.partitionBy("tree").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("pid", "tree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
                           F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("pid", "tree").orderBy(*order)) - 1
    ranked = dealt.withColumn("rank", rank)
    return ranked.join(counts, ["pid", "tree"]).withColumn("pos", F.col("ahead") + F.col("rank"))


def _subtrees(placed: DataFrame, fanout: int, stride: int, rows: list[str]) -> DataFrame:
    """Nodes ``(tree, total, pos, h)`` of one stored level, one row an aligned subtree."""
    width = fanout ** stride
    node = F.struct("pos", "h", F.struct(*rows).alias("row")) if rows else F.struct("pos", "h")
    t = placed.groupBy("tree", F.expr(f"pos div {width}").alias("part")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(node)).alias("s"))
    final = F.col("total") <= width
    needed = sum([(F.size("s") > fanout ** j).cast("int") for j in range(stride)], F.lit(0))
    out = [F.col("s.h").alias("nodes")] + ([F.col("s.row").alias("rows")] if rows else [])
    return t.select("tree", "part", "total", final.alias("final"),
                    F.when(final, needed).otherwise(F.lit(stride)).alias("steps"), *out)


def build_trees(leaves: DataFrame, order: list[str], rows: list[str], fanout: int = FANOUT,
                stride: int = STRIDE) -> Tree:
    """Trees over ``leaves`` (columns ``tree``, ``h``, those of ``order`` and of ``rows``).

    Writes the leaves and every ``stride``-th level above as subtrees; ``rows`` stay with the leaves.
    """
    width = fanout ** stride
    levels = [staged(_subtrees(_placed(leaves, order), fanout, stride, rows), "merkle-0")]
    largest = levels[0].agg(F.max("total")).first()[0] or 0
    tops = []
    while True:
        top = F.element_at(F.element_at(_interior(F.col("nodes"), F.col("steps"), fanout, stride), -1), 1)
        done = levels[-1].select("tree", "part", "total", "final", top.alias("h"))
        tops.append(done.filter("final").select("tree", F.col("h").alias("top")))
        if largest <= width:
            break
        largest = -(-largest // width)
        up = done.filter("NOT final").select("tree", F.expr(f"(total + {width - 1}) div {width}").alias("total"),
                                             F.col("part").alias("pos"), "h")
        levels.append(staged(_subtrees(up, fanout, stride, []), f"merkle-{len(levels) * stride}"))
    for t in tops[1:]:
        tops[0] = tops[0].unionByName(t)
    return Tree(levels, staged(tops[0], "merkle-tops"), fanout, stride)


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """One row a leaf: ``tree``, ``h``, ``row``, ``path`` up to the root and the other columns of ``above``.

    ``above``: one row a tree, with ``up``, the path from its top on.
    """
    f, s, width = tree.fanout, tree.stride, tree.fanout ** tree.stride
    more = [c for c in above.columns if c not in ("tree", "up")]
    nodes = None
    for level in reversed(tree.levels):
        t = level.filter("final").join(above, "tree")
        if nodes is not None:
            t = t.unionByName(level.filter("NOT final").join(
                nodes.select("tree", F.col("pos").alias("part"), F.col("path").alias("up"), *more), ["tree", "part"]))
        has_rows = "rows" in level.columns
        t = t.withColumn("levels", _interior(F.col("nodes"), F.col("steps"), f, s))
        t = t.select("*", F.posexplode("nodes").alias("k", "h"))
        own = _path(F.col("levels"), F.col("k"), F.col("steps"), f, s)
        nodes = t.select("tree", (F.col("part") * width + F.col("k")).alias("pos"), "h",
                         F.concat(own, F.col("up")).alias("path"), *more,
                         *([F.get("rows", F.col("k")).alias("row")] if has_rows else []))
    return nodes


def build_manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group: str = "source",
                   keep: dict[str, Column] | None = None, fanout: int = FANOUT, stride: int = STRIDE) -> Manifest:
    """Trees over all rows of ``docs``: one a value of ``group``, and one over their roots.

    ``keep``: further columns that stay with each leaf, by name.
    """
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    keep = {"id": F.col(id_col)} | (keep or {})
    own = docs.select(tree.alias("tree"), leaf(fields).alias("h"), F.monotonically_increasing_id().alias("seq"),
                      *[c.alias(f"r_{n}") for n, c in keep.items()])
    own = staged(own, "merkle-leaves")
    sources = build_trees(own, ["r_id", "h", "seq"], [f"r_{n}" for n in keep], fanout, stride)
    tops = sources.tops.select(F.lit("").alias("tree"), F.col("top").alias("h"), F.col("tree").alias("r_tree"))
    return Manifest(sources, build_trees(tops, ["r_tree"], ["r_tree"], fanout, stride))


def proofs(manifest: Manifest) -> DataFrame:
    """One row a leaf: ``id`` and the other kept columns, ``leaf``, ``subroot``, ``root`` and ``path``."""
    over = manifest.whole.tops.select("tree", F.array().cast(f"array<{STEP}>").alias("up"), F.col("top").alias("root"))
    tops = paths(manifest.whole, over).select(F.col("row.r_tree").alias("tree"), F.col("path").alias("up"),
                                              F.col("h").alias("subroot"), "root")
    t = paths(manifest.sources, tops)
    kept = [f.name for f in t.schema["row"].dataType.fields]
    return t.select(*[F.col(f"row.{c}").alias(c[2:]) for c in kept], F.col("h").alias("leaf"), "subroot", "root", "path")


def without_newlines(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", text: str = "text") -> Column:
    """Leaf of a row whose id's CRC-32 is even, with the line feeds of its text deleted; null where nothing
    changes (an odd or null id, no line feed, a null text)."""
    hit = (F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0) & F.col(text).contains("\n")
    return F.when(hit, leaf([F.replace(F.col(text), F.lit("\n"), F.lit("")) if c == text else c for c in fields]))


def audit(docs: DataFrame) -> DataFrame:
    """Proof of every row, folded again from the row as :func:`without_newlines` leaves it."""
    docs = docs.select(*FIELDS)
    p = proofs(build_manifest(docs, keep={"changed": without_newlines(docs)}))
    p = p.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return p.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                    digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))
