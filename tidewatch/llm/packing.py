"""Operator 4: best-fit packing with certified repacking.

Documents are tokenised (end id appended), documents longer than a sequence are cut so that only the
first piece may be short, and whole sequences are done.  The other pieces are dealt by a hash into
groups of bounded size; each group is packed best-fit decreasing, and a lower bound from
dual-feasible functions over its histogram of lengths certifies its number of sequences.  Groups
with a gap give up every sequence that is not full, certified groups their loosely filled ones;
what is given up is dealt anew, packed again and accepted if that needs fewer sequences.  Rounds end
when nothing is gained.

Groups have at most about ``GROUP`` pieces whatever the input, hold ids and lengths only, and are
independent of the order in which rows arrive.  Each round is written to the shared folder.

Ids are those of the tokenizers library at its defaults for the byte-level vocabulary file (strings of
special tokens get their special id); :mod:`bpe` reads the file and a test compares the two.

Defined results: a null text is empty and has the end id only; every row is packed, also repeated
ones; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, default_path, vocabulary
from .common import staged

CAPACITY = 1024
END_ID = 2
GROUP = 4000
LOOSE = 0.95  # certified groups give up sequences filled less than this


def token_ids(text: str | None, v: Vocabulary) -> np.ndarray:
    """uint32 ids of a whole text with the end id; strings of special tokens get their special id."""
    parts = [v.ids(s) if i % 2 == 0 else np.array([v.special[s]], "<u4") for i, s in enumerate(v.segments(text or ""))]
    return np.concatenate([*parts, np.array([END_ID], "<u4")])


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: only the first may be shorter than capacity."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
           path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): one row a piece, whole texts tokenised."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = t.schema["doc_id"].dataType.simpleString()
    fields = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(path or default_path())
        for batch in batches:
            rows, cols = [], [[] for _ in fields]
            for i, text in enumerate(batch.column(1)):
                ids, start = token_ids(text.as_py(), enc), 0
                for piece, length in enumerate(cut(len(ids), capacity)):
                    part = ids[start:start + length].tobytes()
                    rows.append(i)
                    for c, v in zip(cols, (piece, start, length, zlib.crc32(part), part)):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, types)],
                names=["doc_id", *fields])

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return t.mapInArrow(tokenise, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each item, loads): longest first, each into the fullest bin that has room.

    ``room`` keeps the bins by free space and ``mask`` which free spaces occur, so that the tightest
    fit is the lowest set bit at or above the item's length.
    """
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    loads: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(loads)
            loads.append(0)
        where[i], offset[i] = b, loads[b]
        loads[b] += n
        left = free - n
        if left:
            room[left].append(b)
            mask |= 1 << left
    return where, offset, np.asarray(loads, np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that ``counts[n]`` items of length n can need, over two families of dual-feasible functions."""
    n = np.arange(len(counts))
    total = int((counts * n).sum())
    best = -(-total // capacity)
    for k in range(1, 21):  # u(k): lengths on a multiple of 1/(k+1) keep their size, others round down to 1/k
        whole = (n * (k + 1)) % capacity == 0
        value = np.where(whole, n * k, (n * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    large = np.cumsum(counts[::-1])[::-1]  # items of length >= n
    space = np.cumsum(counts * n)
    for eps in range(1, capacity // 2 + 1):  # above capacity - eps counts whole, below eps not at all
        huge = int(large[capacity - eps + 1]) if capacity - eps + 1 < len(counts) else 0
        middle = int(space[min(capacity - eps, len(counts) - 1)] - space[eps - 1])
        best = max(best, -(-(huge * capacity + middle) // capacity))
    return best


def _pack_groups(pool: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pack (rid, length) group by group: sequence_id, offset, load of its sequence, released."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable")
        rid, lengths = pdf["rid"].to_numpy(), pdf["length"].to_numpy()
        where, offset, loads = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        opener = np.empty(len(loads), np.int64)
        opener[where[offset == 0]] = rid[offset == 0]
        limit = capacity if len(loads) > bound else LOOSE * capacity
        return pd.DataFrame({"rid": rid, "length": lengths, "sequence_id": opener[where],
                             "offset": offset, "released": (loads < limit)[where]})

    dealt = pool.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInPandas(
        pack, "rid long, length long, sequence_id long, offset long, released boolean")


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY,
         path: str | None = None, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with sequence_id (the row number of its first piece) and offset."""
    cut_up = pieces(docs, text_col, id_col, capacity, path, with_ids)
    all_pieces = staged(cut_up.withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    pool = all_pieces.filter(F.col("length") < capacity).select("rid", "length")
    kept: list[DataFrame] = []
    n, before = pool.count(), None
    for turn in itertools.count():  # a round that goes on has gained a sequence, so there are finitely many
        if not n:
            break
        packed = staged(_pack_groups(pool, -(-n // group), turn, capacity), f"pack-round{turn}")
        bins = packed.agg(F.count_distinct("sequence_id").alias("all"), F.count_distinct(
            F.when(F.col("released"), F.col("sequence_id"))).alias("open"),
            F.sum(F.col("released").cast("long")).alias("n")).first()
        if before is not None and bins["all"] >= before[1]:
            break  # no gain: the released sequences stay as they were
        if before is not None:
            kept[-1] = kept[-1].filter(~F.col("released"))
        kept.append(packed)
        before = (packed, bins["open"])
        n = bins["n"] or 0
        pool = packed.filter("released").select("rid", "length")
    out = all_pieces.filter(F.col("length") >= capacity).withColumns(
        {"sequence_id": F.col("rid"), "offset": F.lit(0).cast("long")})
    if kept:
        placed = kept[0]
        for k in kept[1:]:
            placed = placed.unionByName(k)
        out = out.unionByName(all_pieces.join(placed.select("rid", "sequence_id", "offset"), "rid")
                              .select(*out.columns))
    return out.drop("rid")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound over the histogram of all piece lengths)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    used = packed.select(F.count_distinct("sequence_id")).first()[0]
    return used, lower_bound(counts, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence, from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    return packed.groupBy("sequence_id").agg(F.aggregate(
        parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
