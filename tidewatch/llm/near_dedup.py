"""Operator 9: near-duplicate groups by min-max hashing, confirmed on whole shingle sets.

Every permutation of the shingles gives two signature values, its minimum and its maximum, so
``PERMUTATIONS`` evaluations a shingle make twice as many values.  ``ROWS`` values form a band; at the
threshold of 0.8 a pair of texts shares none of the bands with a probability near 1e-7.

Documents with equal shingle sets form one class first (a pre-aggregated minimum), so groups of
copies of any size enter as one row.  No bucket is expanded into its pairs:

1. every class is compared with the first class of each of its buckets, best estimate first, and
   links are confirmed on the whole sets; components of these links are formed;
2. only buckets that still hold several components are looked at again: classes compared with
   further first classes (after a test of the signature estimate that is five deviations below the
   threshold), and the strays outside a bucket's largest component with all rows of that group, set
   against set, in blocks of bounded bytes that give out links only.  Pairs inside one component
   need no comparison, as only components are asked for.

Links are thus the exact ones among all pairs that share a band.  Sketches and bands travel instead
of texts; texts of the classes that share a bucket are fetched by key, in one pass for all steps.

Defined results: a null text, or one without words, has an empty set and is its own component; one
word is a set of one; repeated rows and rows of null id belong to their class like any other (a
component's id is its smallest id that is not null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, spread_join, staged, text_or_empty
from .components import components

SHINGLE = 2
ABOVE, BELOW = 80, 100  # link if BELOW * intersection >= ABOVE * union
PERMUTATIONS = 100
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
SURELY_LESS = 0.65  # estimates below are never at the threshold
BLOCK_BYTES = 2 << 20
_CHUNK = 1 << 15
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _M) | np.uint64(1)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (A-Z lower-cased, split at ASCII blanks)."""
    from xxhash import xxh3_64_intdigest as h64

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(h64, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = _mix(out * _M + h[j:j + n] + np.uint64(j + 1))
    return np.unique(out)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then their maxima."""
    low = high = None
    for i in range(0, len(shingles), _CHUNK):
        v = multipliers[:, None] * shingles[None, i:i + _CHUNK]
        a, b = v.min(axis=1), v.max(axis=1)
        low = a if low is None else np.minimum(low, a)
        high = b if high is None else np.maximum(high, b)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64) * _M
    for j in range(rows):
        key = _mix(key * _M + parts[:, j])
    return key.view(np.int64)


def _signatures(k: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        mult = _multipliers(permutations)
        for batch in batches:
            n, digest, sketch, bands = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                if not len(s):
                    digest.append(None), sketch.append(None), bands.append(None)
                    continue
                sig = signature(s, mult)
                digest.append(xxh3_128_digest(s.tobytes()))
                sketch.append((sig >> np.uint64(24)).astype(np.uint8).tobytes())
                bands.append(band_keys(sig, rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "n", "digest", "sketch", "bands"])
    return run


def _close_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for i in (2, 3))
        same = (x == y).sum(axis=1)
        keep = same >= SURELY_LESS * x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)),
             pa.array(same[keep].astype(np.int64))], names=["a", "b", "same"])


def _estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, same): pairs whose signature estimate does not rule a link out."""
    left = reps.select(F.col("rid").alias("a"), F.col("sketch").alias("x"))
    right = reps.select(F.col("rid").alias("b"), F.col("sketch").alias("y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
            .mapInArrow(_close_sketches, "a long, b long, same long"))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rid", "shingles"])
    return run


def _linked(above: int, below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                v = np.concatenate([x, y])
                v.sort(kind="stable")
                both = int((v[1:] == v[:-1]).sum())
                keep.append(below * both >= above * (len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])
    return run


def _whole_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rid, shingles) of the classes ``ids``: their texts are found by key, one each, by shuffle at every size."""
    keys = staged(ids.join(reps.select("rid", "key"), "rid"), "near-keys")
    texts = docs.join(keys.hint("merge"), ["key"]).select("rid", "text")
    sets = texts.mapInArrow(_sets(k), "rid long, shingles binary")
    return staged(sets.dropDuplicates(["rid"]), "near-sets")


def _confirm(pairs: DataFrame, sets: DataFrame, above: int, below: int) -> DataFrame:
    """Links among ``pairs``, by the whole shingle sets of both texts."""
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return staged(both.mapInArrow(_linked(above, below), "a long, b long"), "near-links")


def _meet(above: int, below: int):
    """Links of strays (left) with the rows of their group (right): one for each stray and component."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        groups = dict(list(right.groupby("top", sort=True)))
        for top, strays in left.groupby("top", sort=True):
            rows = groups.get(top)
            if rows is None:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
            sizes = np.array([len(x) for x in sets])
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            rid, root = rows["rid"].to_numpy(), rows["root"].to_numpy()
            for u, ru, shingles in zip(strays["rid"], strays["root"], strays["shingles"]):
                x = np.frombuffer(shingles, np.uint64)
                lo = np.searchsorted(tokens, x)
                n = np.searchsorted(tokens, x, side="right") - lo
                hits = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[hits], minlength=len(sets))
                fits = (below * both >= above * (len(x) + sizes - both)) & (root != ru)
                at = np.flatnonzero(fits)
                _, first = np.unique(root[at], return_index=True)
                found.extend((u, v) for v in rid[at[first]])
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return run


def _strays(inner: DataFrame, sets: DataFrame, above: int, below: int) -> DataFrame:
    """Links (a, b) between components that meet in a band of ``inner`` (band, rid, root).

    The largest component of a band is its group; rows of other components are the group's strays.
    Strays are held against all rows of their group in blocks of bounded bytes, each pair of blocks
    once, and only links come out: no pair of rows is ever written.
    """
    spark = inner.sparkSession
    top = (inner.groupBy("band", "root").count().groupBy("band")
           .agg(F.max_by("root", F.struct("count", "root")).alias("top")))
    rows = inner.join(top, "band").select("top", "rid", "root").distinct().join(sets, "rid")
    rows = staged(rows.withColumn("stray", F.col("root") != F.col("top")), "near-groups")
    size = F.octet_length("shingles")
    volume = rows.groupBy("top").agg(F.sum(size).alias("all"), F.sum(F.when(F.col("stray"), size)).alias("strays"))
    total = volume.agg(F.sum("all")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), int(total) // BLOCK_BYTES)
    volume = volume.select("top", F.ceil(F.col("all") / BLOCK_BYTES).cast("int").alias("blocks"),
                           F.ceil(F.col("strays") / BLOCK_BYTES).cast("int").alias("asks"))
    rows = rows.join(volume, "top")
    own = F.xxhash64("rid")
    one = (F.col("blocks") <= 1) & (F.col("asks") <= 1)  # small groups share a bucket
    bucket = F.when(one, F.pmod(F.xxhash64("top"), F.lit(buckets))).otherwise(F.col("top") + buckets).alias("bucket")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    kept = ["top", "rid", "root", "shingles"]
    asks = rows.filter("stray").select(bucket, F.pmod(own, "asks").cast("int").alias("ask"),
                                       F.explode(span("blocks")).alias("block"), *kept)
    held = rows.select(bucket, F.pmod(own, "blocks").cast("int").alias("block"),
                       F.explode(span("asks")).alias("ask"), *kept)
    asks, held = asks.toDF(*asks.columns), held.toDF(*held.columns)  # columns of their own
    keys = ["bucket", "ask", "block"]
    return staged(asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_meet(above, below), "a long, b long"),
                  "near-strays")


def near_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) of every row; ``key`` digests id and text."""
    return _rooted(docs, text_col, id_col, **options).drop("root")


def _rooted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
            above: int = ABOVE, below: int = BELOW, permutations: int = PERMUTATIONS,
            rows: int = ROWS) -> DataFrame:
    """The components with ``root``, which also tells those of null ids apart (null without words)."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))
    own = own.withColumn("key", key)
    id_type = own.schema["doc_id"].dataType.simpleString()
    signed = own.select("doc_id", "key", "text").mapInArrow(
        _signatures(shingle, permutations, rows),
        f"doc_id {id_type}, key string, n long, digest binary, sketch binary, bands array<long>")
    light = staged(signed.withColumn("rid", F.monotonically_increasing_id()), "near-signed")
    classes = light.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("rid"))
    reps = staged(light.join(classes.select("rid"), "rid").select("rid", "key", "sketch", "bands"), "near-reps")

    banded = reps.select(F.explode("bands").alias("band"), "rid")
    buckets = (banded.groupBy("band").agg(F.min("rid").alias("first"), F.max("rid").alias("last"), F.count("*").alias("n"))
               .filter("first < last").drop("last"))
    buckets = staged(buckets, "near-buckets")
    members = staged(spread_join(banded, buckets, ["band"], "n", reps.count() * (2 * permutations // rows)).drop("n"),
                     "near-members")
    star = members.filter("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b")).distinct()
    star = staged(_estimate(star, reps), "near-star")
    nearest = star.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")).select("a", "b")
    texts = own.select("key", "text")
    nearest = staged(nearest, "near-first")
    sets = _whole_sets(members.select("rid").distinct(), reps, texts, shingle)
    links = _confirm(nearest, sets, above, below)

    part = components(links)
    of = part.select(F.col("node").alias("rid"), "root")
    inner = members.filter("rid <> first").join(of, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    inner = staged(inner.select("band", "rid", "root"), "near-inner")
    mixed = inner.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    inner = staged(inner.join(mixed, "band"), "near-mixed")
    ra, rb = (part.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    second = (star.select("a", "b").join(ra, "a", "left").join(rb, "b", "left")
              .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
              .join(nearest, ["a", "b"], "left_anti"))
    second = staged(second, "near-second")
    more = _confirm(second, sets, above, below)
    if inner.head(1):
        more = more.union(_strays(inner, sets, above, below))
    if more.head(1):  # join the components that the further links connect
        ends = more.join(ra, "a", "left").join(rb, "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        joined = components(ends)
        alone = joined.join(part, "node", "left_anti")
        part = part.join(joined.select(F.col("node").alias("root"), F.col("root").alias("r")), "root", "left").select(
            "node", F.coalesce("r", "root").alias("root")).union(alone.select("node", "root"))
        part = staged(part, "near-parts")

    of = part.select(F.col("node").alias("rid"), "root")
    classes = (light.filter("n > 0").groupBy("digest").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
        .join(of, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    classes = staged(classes, "near-classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = staged(classes.join(ids, "root").select("digest", "component_id", "copies", "root"), "near-ids")
    some = light.filter("n > 0").select("doc_id", "key", "n", "digest")
    out = spread_join(some, by_class, ["digest"], "copies", light.count()).select("doc_id", "key", "n", "component_id", "root")
    out = out.unionByName(light.filter("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"),
                                                       F.lit(None).cast("long").alias("root")))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "root")


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, whole.

    It is the row of the smallest id (null ids last), then of the smallest key; of rows equal in id
    and text one.  Rows without words are components of their own and stay.
    """
    names = docs.columns
    t = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, text = F.col(f"c{names.index(id_col)}"), text_or_empty(f"c{names.index(text_col)}")
    found = staged(_rooted(docs, text_col, id_col, **options).filter("root IS NOT NULL").select("doc_id", "key", "root"),
                   "near-found")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"))
    stay = stay.select(F.col("least.key").alias("key"), F.lit(True).alias("stays"))
    marks = found.groupBy("key").count().join(stay, "key", "left").filter("stays IS NULL OR count > 1")
    marks = staged(marks.select("key", F.coalesce("stays", F.lit(False)).alias("repeated")), "near-marks")
    key = F.md5(F.concat(F.coalesce(own_id.cast("string"), F.lit("-")), F.lit(":"), text))
    t = t.withColumn("key", key).join(marks, "key", "left")
    kept = t.filter("repeated IS NULL").unionByName(t.filter("repeated").dropDuplicates(["key"]))
    return kept.drop("key", "repeated").toDF(*names)
