"""Operator 7: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is laid out once as a line of words: its documents in an order permuted by a hash of
the document id.  The mix takes the first ``target`` words of that line, read again from its start
as often as needed (a document is never read more than ``LIMIT`` times).  The line is cut into
blocks of equal words.  How many blocks of each source an output shard receives is drawn by a
splitting tree: the block quotas of a node are divided between its two halves by a multivariate
hypergeometric draw (one conditional hypergeometric draw a source, by inversion of its distribution
function), so that quotas are exact at every level.  Shards then take disjoint ranges of a
permutation of the source's blocks, and rows are shuffled within a shard by a hash.

Nothing is sampled or collected: word positions come from a two-level prefix sum (sums of hash
buckets per source, then a window within a bucket), so a source with a third of all rows is spread
over as many buckets as its rows need.  Source totals, targets and quotas are tables with one row a
source or a shard.  A shard's rows lie in as many partitions as they need, by ranges of the shuffling
hash, so no task holds a whole shard.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; sizes
of 0 take nothing; tied or repeated rows are laid side by side; an empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, place, positional, staged, text_or_empty

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"
BLOCK_WORDS = 4096
LEVELS = 5  # 2 ** LEVELS output shards
ROWS_PER_BUCKET = 20_000
PRIME = (1 << 31) - 1
ROUNDS = 24


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Targets of a table (src, null_source, source_size) with one row a source.

    Filling by weight with a ceiling: sources ordered by ceiling over weight reach it one after the
    other, and the level at the first one that does not is the common share of a unit of weight.
    """
    by_name = Window.orderBy("null_source", "src")
    t = sizes.withColumn("rn", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                            (F.col("rn") % len(weights) + 1).cast("int")))
    t = t.withColumn("ceiling", F.col("source_size") * limit)
    t = t.withColumn("full_at", F.col("ceiling") / F.col("weight"))
    order = Window.orderBy("full_at", "rn")
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("level", (total - before) / after)
    t = t.withColumn("open_level", F.when(F.col("full_at") >= F.col("level"), F.col("level")))
    level = F.first("open_level", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("share", level)
    target = F.when(F.col("share").isNull() | (F.col("full_at") < F.col("share")),
                    F.col("ceiling").cast("double")).otherwise(F.col("share") * F.col("weight"))
    return t.select("src", "null_source", "rn", "source_size", target.alias("target"))


def _log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, Stirling's series beyond (error below 1e-13)."""
    x = n.cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x)
              - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(population: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of ``good`` units among ``draws`` of ``population``, by inversion at ``u``.

    The distribution is summed over twelve standard deviations around its mean; what lies outside
    has less weight than a double can tell.
    """
    n, g, d = (c.cast("double") for c in (population, good, draws))
    low = F.greatest(F.lit(0).cast("long"), draws - (population - good))
    high = F.least(good, draws)
    mean = d * g / n
    spread = F.sqrt(mean * (1 - g / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))) * 12 + 2
    first = F.greatest(low, F.floor(mean - spread).cast("long"))
    last = F.greatest(first, F.least(high, F.ceil(mean + spread).cast("long")))

    def weight(k: Column) -> Column:
        return F.exp(_log_choose(good, k) + _log_choose(population - good, draws - k)
                     - _log_choose(population, draws))

    def step(s: Column, k: Column) -> Column:
        done = s["sum"] >= u
        return F.struct(F.when(done, s["sum"]).otherwise(s["sum"] + weight(k)).alias("sum"),
                        F.when(done, s["k"]).otherwise(k).alias("k"))

    start = F.struct(F.lit(0.0).alias("sum"), first.alias("k"))
    found = F.aggregate(F.sequence(first, last), start, step, lambda s: s["k"])
    return (F.when((population <= 0) | (draws <= 0) | (good <= 0), F.lit(0).cast("long"))
            .when(draws >= population, good).when(good >= population, draws).otherwise(found))


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """(shard, quotas) of one row ``quotas`` (array<long>, blocks of each source): the tree's leaves."""
    t = quotas.select(F.lit(0).alias("node"), F.col("quotas"))
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)

        def draw(s, q):
            i = F.size(s["left"])
            name = F.concat_ws(":", F.lit(seed), F.lit(level), F.col("node"), i)
            u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
            x = hypergeometric(s["population"], q, s["draws"], u)
            return F.struct((s["population"] - q).alias("population"), (s["draws"] - x).alias("draws"),
                            F.concat(s["left"], F.array(x)).alias("left"))

        t = t.withColumn("total", total)
        half = F.floor((F.col("total") + 1) / 2).cast("long")
        start = F.struct(F.col("total").alias("population"), half.alias("draws"),
                         F.array().cast("array<long>").alias("left"))
        t = t.withColumn("left", F.aggregate("quotas", start, draw, lambda s: s["left"]))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        t = t.select(F.posexplode(F.array("left", right)).alias("side", "half"), "node").select(
            (F.col("node") * 2 + F.col("side")).cast("int").alias("node"), F.col("half").alias("quotas"))
    return t.withColumnRenamed("node", "shard")


def round_keys(seed: str = SEED) -> list[tuple[int, int, int]]:
    """(mirror, factor, summand) of each round of :func:`permuted`, below 2^31."""
    out = []
    for r in range(ROUNDS):
        digest = hashlib.md5(f"{seed}:round:{r}".encode()).hexdigest()
        out.append(tuple(int(digest[8 * i:8 * i + 7], 16) + 1 for i in range(3)))
    return out


def source_key(src: Column, null_source: Column, seed: str = SEED) -> Column:
    """28 bits that make a source's permutation its own."""
    name = F.concat(F.lit(seed), F.when(null_source, F.lit(":null")).otherwise(F.lit(":key:")), src)
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long")


def permuted(block: Column, blocks: Column, key: Column, seed: str = SEED) -> Column:
    """Number of ``block`` in a keyed random order of 0 .. blocks - 1 (below 2^31).

    A swap-or-not shuffle: a round mirrors the numbers at a keyed point and swaps a pair of mirrored
    numbers or not, by a keyed bit of the larger one.  Each round maps the range onto itself, whatever
    its length, so the order needs no table of blocks and no shuffle.
    """
    n = F.greatest(blocks, F.lit(1).cast("long"))
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("kac", r)]) for r in round_keys(seed)])

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] + key - x, n)
        bit = F.pmod(F.greatest(x, other) * r["a"] + r["c"] + key, F.lit(PRIME).cast("long")) * 2 > PRIME
        return F.when(bit, other).otherwise(x)

    return F.aggregate(rounds, block, swap)


def _sources(light: DataFrame, levels: int, block_words: int) -> DataFrame:
    """One row a source: target, words to take, blocks, and the shards' upper block numbers."""
    sums = light.groupBy("src", "null_source").agg(F.sum("size").alias("source_size"))
    src = source_targets(sums).withColumn("take", F.round("target").cast("long"))
    src = src.withColumn("blocks", F.ceil(F.col("take") / block_words).cast("long"))
    src = staged(src, "mix-sources")
    quotas = src.agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "blocks"))),
                                 lambda s: s["blocks"]).alias("quotas"))
    leaves = split_quotas(quotas, levels)
    each = leaves.select("shard", F.posexplode("quotas").alias("rn", "quota"))
    upto = F.sum("quota").over(Window.partitionBy("rn").orderBy("shard"))
    uppers = (each.select("rn", "shard", upto.alias("upper")).groupBy("rn")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "upper"))),
                               lambda s: s["upper"]).alias("uppers")))
    return src.join(uppers, "rn").withColumn("key", source_key(F.col("src"), F.col("null_source")))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        columns: list[str] | None = None, levels: int = LEVELS,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """``columns`` of every row (all by default) with size, source_size, target, taken and draws.

    ``draws`` has one entry for each reading of the document: copy, words, the shard whose quota
    holds its block, the block and the key ``place`` by which a shard's rows are shuffled locally.
    """
    rows, names = positional(docs)
    out = columns if columns is not None else names
    carried = [place(names, c) for c in out]
    ic, tc, sc = (place(names, c) for c in (id_col, text_col, source_col))
    source = F.col(sc).cast("string")
    digits = max(2, math.ceil(math.log(max(docs.count(), 1) / ROWS_PER_BUCKET + 1, 16)))
    keyed = rows.select(
        *dict.fromkeys([*carried, ic]), F.coalesce(source, F.lit("")).alias("src"),
        source.isNull().alias("null_source"), word_count(text_or_empty(tc)).alias("size"),
        F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(ic).cast("string"), F.lit("null")))).alias("h"))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, digits))
    light = staged(keyed.groupBy("src", "null_source", "bucket").agg(F.sum("size").alias("size")), "mix-sums")
    sources = _sources(light, levels, block_words)
    upto = F.sum("size").over(Window.partitionBy("src", "null_source").orderBy("bucket"))
    buckets = (light.withColumn("before", upto - F.col("size")).drop("size")
               .join(sources.drop("rn"), ["src", "null_source"]))
    buckets = staged(buckets, "mix-buckets")

    within = Window.partitionBy("src", "null_source", "bucket").orderBy("h", ic, "size")
    t = (keyed.withColumn("start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
         .join(buckets, ["src", "null_source", "bucket"])
         .withColumn("start", F.col("start") + F.col("before")))

    def words(copy: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.col("take") - copy * F.col("source_size") - F.col("start"), F.lit(0)))

    def piece(copy: Column) -> Column:
        block = F.floor((copy * F.col("source_size") + F.col("start")) / block_words).cast("long")
        number = permuted(block, F.col("blocks"), F.col("key"))
        shard = F.aggregate("uppers", F.lit(0), lambda n, u: n + (u <= number).cast("int"))
        return F.struct(copy.cast("int").alias("copy"), words(copy).alias("words"), shard.alias("shard"),
                        block.alias("block"), F.xxhash64(F.lit(SEED), "h", copy).alias("place"))

    copies = F.sequence(F.lit(0).cast("long"), F.lit(LIMIT).cast("long"))
    t = t.withColumn("draws", F.transform(F.filter(copies, lambda c: words(c) > 0), piece))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return t.select(*carried, "size", "source_size", "target", taken.alias("taken"), "draws").toDF(
        *out, "size", "source_size", "target", "taken", "draws")


def sharded_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (shard, the columns of ``docs``), whole documents as often as drawn.

    A shard's rows lie next to each other in the order of ``place``: rows are dealt by (shard, range of
    ``place``) and sorted within the partition.  A source's last document, of which the mix takes only a
    part, is in if at least half of it is.
    """
    names = list(docs.columns)
    cols = [f"c{i}" for i in range(len(names))]
    t = mix(docs, **options).toDF(*cols, "size", "source_size", "target", "taken", "draws")
    t = t.withColumn("draw", F.explode(F.filter("draws", lambda p: p["words"] * 2 >= F.col("size"))))
    shards = 1 << options.get("levels", LEVELS)
    parts = max(1, -(-docs.count() // (shards * ROWS_PER_BUCKET)))
    t = t.select(F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"), *cols)
    t = t.withColumn("part", F.floor((F.col("place") / float(1 << 64) + 0.5) * parts).cast("int"))
    t = t.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "place")
    return t.select("shard", *cols).toDF("shard", *names)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of :func:`sharded_rows`, in their order, with the columns of ``docs`` only."""
    t = sharded_rows(docs, **options)
    cols = [f"c{i}" for i in range(len(docs.columns))]
    return t.toDF("shard", *cols).select(*cols).toDF(*docs.columns)
