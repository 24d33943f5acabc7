"""Operator 3: removal of repeated byte strings by distributed difference-cover suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else (same document or
another) is removed.  Whole-corpus suffix sorting would move every suffix once a recursion level, so
suffixes are first dealt by content in such a way that equal ones always meet:

1. the anchor of a window of ``LENGTH`` bytes is its smallest ``GRAM``-byte gram by a hash (leftmost
   of equals).  Equal windows have equal anchors at equal places, so windows are dealt by anchor;
   consecutive windows with one anchor travel as one segment.  An anchor that occurs once in the
   corpus has no repeated window: a pre-aggregated count removes those, without any loss;
2. segments of one anchor with equal content are one class; a class of several segments is repeated
   as a whole.  Only classes of one segment next to others of the same anchor need their bytes;
3. those are fetched and sorted bucket by bucket (whole anchors a bucket, bounded bytes): sampled
   triples are sorted, names recursed on, the remaining suffixes merged, and neighbours in the
   suffix array compared over their ``LENGTH``-byte prefixes.  Anchors with more than ``CLASSES``
   classes (a short passage in many surroundings) are divided by a second anchor, the smallest
   ``LONG_GRAM``-byte gram of a window, and again only what occurs twice goes on; should that leave a
   group above ``CLASSES``, its windows are counted by a 128-bit digest, which spreads them over all
   tasks.  None of these steps loses a window;
4. flagged windows become byte ranges of each text, which are cut out in a last pass over the texts.

Texts are referred to by two 64-bit hashes, so copies share their segments and ranges.

Defined results: a null text is empty; texts below ``LENGTH`` bytes keep everything; rows are
independent of ids, so null or repeated ids and further columns need no special case (a repeated
row is a repeated text); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, spread_join, staged, text_or_empty
from .suffix_array import suffix_array

LENGTH = 200
GRAM = 32
LONG_GRAM = 128
CLASSES = 2000
BUCKET_BYTES = 1 << 20
_PIECE = 1 << 19  # windows looked at together; positions take 20 bits
_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(random word of each byte, powers of an odd base, powers of its inverse)."""
    if not _TABLES:
        rng = np.random.default_rng(3)
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        size = 2 * _PIECE + 4096
        power = np.full(size, base, np.uint64)
        power[0] = 1
        back = np.full(size, inverse, np.uint64)
        back[0] = 1
        _TABLES["t"] = (rng.integers(0, 1 << 64, 256, np.uint64), np.multiply.accumulate(power),
                        np.multiply.accumulate(back))
    return _TABLES["t"]


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    word, power, back = _tables()
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(word[b] * power[:len(b)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * back[:len(b) - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:len(v)] = v
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(b: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(start, windows, anchor hash) of the runs of valid windows of ``b`` that share an anchor."""
    h = gram_hashes(b, gram)
    place = np.arange(len(h), dtype=np.uint64)
    low = window_minima((h >> np.uint64(20) << np.uint64(20)) | place, length - gram + 1)
    anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, np.empty(0, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    starts = at[first]
    count = np.diff(np.append(np.flatnonzero(first), len(at)))
    return starts, count, h[anchor[starts]].view(np.int64)


def _groups(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into pieces: (bytes, valid windows, text of each window start, its offset there)."""
    parts, total = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for start in range(0, len(t) - length + 1, _PIECE):
            part = t[start:start + _PIECE + length - 1]
            if parts and total + len(part) >= 2 * _PIECE:  # positions would not fit their 20 bits
                yield _join(parts, length)
                parts, total = [], 0
            parts.append((i, start, part))
            total += len(part)
            if total >= _PIECE:
                yield _join(parts, length)
                parts, total = [], 0
    if parts:
        yield _join(parts, length)


def _join(parts: list, length: int):
    b = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    begin = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(parts)), sizes)[:len(b) - length + 1]
    inside = np.arange(len(which)) - begin[which]
    valid = inside <= (sizes - length)[which]
    text = np.array([i for i, _, _ in parts])
    offset = np.array([s for _, s, _ in parts]) - begin
    return b, valid, text[which], offset[which]


def _segment_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h64

        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2).slice(lo, 512)]
                for b, valid, text, offset in _groups(texts, length):
                    starts, count, anchor = segments(b, valid, length, gram)
                    view = memoryview(b)
                    content = np.fromiter((h64(view[s:e]) for s, e in zip(starts.tolist(), (starts + count + length - 1).tolist())),
                                          np.uint64, len(starts)).view(np.int64)
                    rows = pa.array(text[starts] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [k1.take(rows), k2.take(rows), pa.array((starts + offset[starts]).astype(np.int32)),
                         pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(content)],
                        names=["k1", "k2", "s", "w", "anchor", "content"])
    return run


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, content, out = [], [], []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                t = text.as_py().encode("utf-8", "surrogatepass")
                for r in wanted.as_py():
                    anchor.append(r["anchor"]), content.append(r["content"])
                    out.append(t[r["s"]:r["s"] + r["w"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()),
                                              pa.array(out, pa.binary())], names=["anchor", "content", "bytes"])
    return run


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Flags over the windows of ``parts`` (one after the other): those equal to another window."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(parts)), sizes)
    window = np.arange(len(b)) - begin[which] <= (sizes - length)[which]
    order = suffix_array(b.astype(np.int64) + 1)
    order = order[window[order]]
    x, y = order[:-1], order[1:]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([b, np.zeros(8, np.uint8)]), 8)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    same = np.arange(len(x))
    for j in range(0, length, 8):  # neighbours in the suffix array: equal prefixes
        j = min(j, length - 8)
        same = same[words[x[same] + j] == words[y[same] + j]]
    flags = np.zeros(len(b), bool)
    flags[x[same]] = True
    flags[y[same]] = True
    return flags[window]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sort_bucket(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "content", "base"], kind="stable")
        parts = pdf["bytes"].tolist()
        flags, at, rows = repeated_windows(parts, length), 0, []
        for anchor, content, base, part in zip(pdf["anchor"], pdf["content"], pdf["base"], parts):
            n = len(part) - length + 1
            rows.extend((anchor, content, base + a, base + b) for a, b in runs(flags[at:at + n]))
            at += n
        return pd.DataFrame(rows, columns=["anchor", "content", "a", "b"])
    return run


def _divide(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = np.frombuffer(part, np.uint8)
                starts, count, long = segments(b, np.ones(len(b) - length + 1, bool), length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), anchor)), pa.array(np.full(len(starts), content)),
                     pa.array(starts.astype(np.int32)), pa.array(long),
                     pa.array([part[a:a + w + length - 1] for a, w in zip(starts.tolist(), count.tolist())], pa.binary())],
                    names=["anchor", "content", "base", "long", "bytes"])
    return run


def _digest_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for anchor, content, base, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = len(part) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, content)), pa.array(np.arange(base, base + n, dtype=np.int32)),
                     pa.array([xxh3_128_digest(part[i:i + length]) for i in range(n)], pa.binary())],
                    names=["anchor", "content", "a", "digest"])
    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, digest, ranges = [], [], [], [], []
            for text, found in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                t = text.as_py().encode("utf-8", "surrogatepass")
                out: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in found.as_py() or ()):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b + length - 1)
                    else:
                        out.append([a, b + length - 1])
                kept, at = hashlib.sha256(), 0
                for a, b in out:
                    kept.update(t[at:a])
                    at = b
                kept.update(t[at:])
                n.append(len(t)), removed.append(sum(b - a for a, b in out)), spans.append(len(out))
                digest.append(kept.hexdigest())
                ranges.append([{"start": a, "end": b} for a, b in out])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(ranges, kind)],
                names=[*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None,
                   length: int = LENGTH, gram: int = GRAM, long_gram: int = LONG_GRAM) -> DataFrame:
    """``columns`` (all by default) with n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    spark = docs.sparkSession
    names = docs.columns
    out = columns if columns is not None else names
    carried = [f"c{names.index(c)}" for c in out]
    t = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = text_or_empty(f"c{names.index(text_col)}")
    t = t.select(*carried, F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"),
                 text.alias("text"))
    seg = staged(t.select("k1", "k2", "text").mapInArrow(
        _segment_rows(length, gram), "k1 long, k2 long, s int, w int, anchor long, content long"), "repeat-segments")
    total = seg.count()
    again = staged(seg.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "repeat-anchors")
    shared = staged(spread_join(seg, again, ["anchor"], "n", total).drop("n"), "repeat-shared")
    first = F.min(F.struct("k1", "k2", "s", "w")).alias("at")
    classes = staged(shared.groupBy("anchor", "content").agg(F.count("*").alias("n"), first), "repeat-classes")
    several = (classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("least"))
               .filter("classes > 1 AND least = 1").select("anchor", "classes"))
    alone = staged(classes.join(several, "anchor"), "repeat-alone")
    wanted = staged(alone.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("anchor", "content", F.col("at.s").alias("s"), F.col("at.w").alias("w"))).alias("wanted")),
        "repeat-wanted")
    size = alone.agg(F.sum(F.col("at.w") + length - 1).alias("bytes")).first()
    fetched = t.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted")
    fetched = fetched.mapInArrow(_fetch(length), "anchor long, content long, bytes binary")
    fetched = staged(fetched.groupBy("anchor", "content").agg(F.first("bytes").alias("bytes"))
                     .join(several, "anchor"), "repeat-bytes")
    buckets = max(shuffle_partitions(spark), int(size["bytes"] or 0) // BUCKET_BYTES)
    parts = ["anchor", "content", "base", "bytes"]
    few = fetched.filter(F.col("classes") <= CLASSES).select(
        F.xxhash64("anchor").alias("group"), "anchor", "content", F.lit(0).alias("base"), "bytes")
    split = staged(fetched.filter(F.col("classes") > CLASSES).select("anchor", "content", "bytes").mapInArrow(
        _divide(length, long_gram), "anchor long, content long, base int, long long, bytes binary"), "repeat-divided")
    sizes = staged(split.groupBy("anchor", "long").agg(F.count("*").alias("n")).filter("n > 1"), "repeat-long")
    split = staged(spread_join(split, sizes, ["anchor", "long"], "n", split.count()), "repeat-again")
    few = few.unionByName(split.filter(F.col("n") <= CLASSES).select(F.xxhash64("anchor", "long").alias("group"), *parts))
    dealt = few.withColumn("bucket", F.pmod(F.col("group"), F.lit(buckets)))
    sorted_runs = dealt.groupBy("bucket").applyInPandas(_sort_bucket(length), "anchor long, content long, a int, b int")
    crowded = staged(split.filter(F.col("n") > CLASSES).select(*parts).mapInArrow(
        _digest_windows(length), "anchor long, content long, a int, digest binary"), "repeat-crowded")
    met = crowded.groupBy("anchor", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "digest")
    counted = crowded.join(met, ["anchor", "digest"]).select("anchor", "content", "a", (F.col("a") + 1).alias("b"))
    found = staged(sorted_runs.unionByName(counted).groupBy("anchor", "content").agg(
        F.collect_list(F.struct("a", "b")).alias("runs")), "repeat-found")

    whole = classes.filter("n > 1").select("anchor", "content", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"), "n")
    single = (classes.filter("n = 1").join(found, ["anchor", "content"])
              .select("anchor", "content", "runs", "n"))
    flagged = spread_join(shared, staged(whole.unionByName(single), "repeat-flagged"), ["anchor", "content"], "n", total)
    whole_run = F.array(F.struct(F.lit(0).alias("a"), F.col("w").alias("b")))
    flagged = flagged.select("k1", "k2", "s", F.explode(F.coalesce("runs", whole_run)).alias("r"))
    ranges = staged(flagged.groupBy("k1", "k2").agg(F.collect_set(F.struct(
        (F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b")).alias("b"))).alias("found")), "repeat-ranges")
    last = t.join(ranges, ["k1", "k2"], "left").select(*carried, "text", "found")
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in last.schema.fields[:-2]), "n_bytes long",
                       "n_removed long", "n_spans long", "kept_sha256 string", "spans array<struct<start:int,end:int>>"])
    return last.mapInArrow(_cut(length), kinds).toDF(*out, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
