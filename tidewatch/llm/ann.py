"""Operator 8: nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, rotated by a seeded random orthogonal matrix and reduced to the sign of each
coordinate, packed to bits, with two correction scalars: the length of the centred vector and the
inner product of its direction with its code.  A rotated query is rounded to ``QUERY_BITS`` bits a
coordinate and cut into bit planes, so that its inner product with a code is a sum of bit counts of
packed words.  From these an inner product is estimated, with an error bound that is proportional
to the query's length and holds what the rounding may add.  The likeliest candidates are scored first; a candidate whose upper bound lies below the ``k``-th best of
them is not looked at again, the others are scored exactly, in double precision, on the original
vectors.

Every vector is coded (nothing is sampled but the centre, a mean of all).  Candidates are dealt into
blocks of ``BLOCK`` rows, queries into blocks of ``QUERY_BLOCK`` rows; each query block meets each
candidate block once (a stated query set against all rows, in blocks) and keeps its ``k`` best.  A
task reads a part of the candidate blocks against a part of the query blocks (a Cartesian product of
the two staged tables, neither shuffled nor broadcast) and gives out the ``k`` best of a query over
all its candidates; the lists of a query from several tasks are merged.  A block is one row of packed
bytes, so a worker holds a batch of block pairs and ``k`` rows a query of its part.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part,
as candidate or as query; vectors of another dimension than the first one by id fail loudly; ties
go to the smaller id; a row with a null id takes no part; rows are told apart by a row number, so
repeated ids each count as a row: a query has its own list for each row of its id, and the other
rows of that id are candidates; an empty table or no query gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

K = 20
BLOCK = 4096
QUERY_BLOCK = 2048
STEP = 256  # queries of a block estimated at a time
TASKS = 4  # tasks, at most, in which blocks meet, for each partition that a shuffle has
SEED = 20
QUERY_BITS = 6  # bits a coordinate of a rotated query
BOUND = 3.5  # deviations of the estimate that the error bound covers
SLACK = 1e-9  # of the largest product there may be, beyond rounding: ties are decided on sums taken in one order
SLICE = 4096  # pairs whose vectors are laid beside each other at a time
DENSE = 16  # where more than this part of a block is left to score, all of its products are taken at once


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length of the centred vector, inner product of its direction with its code)."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = np.divide(rest @ turn, length[:, None], out=np.zeros_like(rest), where=length[:, None] > 0)
    fit = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(unit > 0, axis=1), length, fit


def words(bits: np.ndarray) -> np.ndarray:
    """Packed bytes (last axis) as 64-bit words, the end filled with zeros."""
    gap = -bits.shape[-1] % 8
    filled = np.concatenate([bits, np.zeros((*bits.shape[:-1], gap), np.uint8)], axis=-1)
    return np.ascontiguousarray(filled).view(np.uint64)


def planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes as words, lowest value, step, sum of the rounding errors) of each rotated query."""
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1)
    step = np.where(step > 0, step, 1.0)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    off = np.abs(turned - (low[:, None] + level * step[:, None])).sum(axis=1)
    cut = [words(np.packbits((level >> j) & 1 == 1, axis=1)) for j in range(QUERY_BITS)]
    return np.stack(cut, axis=1), low, step, off


def estimate(bits: np.ndarray, length: np.ndarray, fit: np.ndarray, query: np.ndarray, centre: np.ndarray,
             turn: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, error bounds), one row a query, from the packed codes."""
    dim = query.shape[1]
    code = words(bits)
    cut, low, step, off = planes(query @ turn)
    level = low[:, None] + step[:, None] * np.rint((query @ turn - low[:, None]) / step[:, None])
    # sum of the query's levels where the code has a one, from the highest plane down
    both = np.zeros((len(query), len(code)), np.uint16 if dim << QUERY_BITS < 1 << 16 else np.int64)
    for j in reversed(range(QUERY_BITS)):
        both <<= 1
        for w in range(code.shape[1]):
            both += np.bitwise_count(cut[:, j, w][:, None] & code[:, w][None, :])
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    dot = step[:, None] * both
    dot += low[:, None] * ones[None, :]
    dot *= 2
    dot -= level.sum(axis=1)[:, None]
    safe = np.where(fit > 0, fit, 1.0)
    scale = (length / safe / np.sqrt(dim))[None, :]
    spread = np.sqrt(np.maximum(1 - safe * safe, 0)) / safe * length / np.sqrt(max(dim - 1, 1))
    width = bound * np.linalg.norm(query, axis=1)[:, None] * spread[None, :] + off[:, None] * scale
    dot *= scale
    dot += (query @ centre)[:, None]
    width += 1e-9
    return dot, width


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    return np.cumsum(query * vectors, axis=1)[:, -1]


def of_pairs(query: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`exact` of query ``i`` and vector ``j`` for each pair, ``SLICE`` pairs at a time."""
    cut = range(0, len(i), SLICE)
    return np.concatenate([exact(query[i[a:a + SLICE]], vectors[j[a:a + SLICE]]) for a in cut] or [np.empty(0)])


def first_of_each(at: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by score, then id, in the order of the queries."""
    order = np.lexsort((cid, -score, at))
    at, cid, score = at[order], cid[order], score[order]
    begin = np.flatnonzero(np.diff(at, prepend=-1))  # a query's first row
    rank = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
    return at[rank < k], cid[rank < k], score[rank < k]


def nearest(qrow: np.ndarray, query: np.ndarray, crow: np.ndarray, cid: np.ndarray, vectors: np.ndarray, code: tuple,
            centre: np.ndarray, turn: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, candidate id, score) of the k best of this block for each query."""
    about, width = estimate(*code, query, centre, turn)
    same = qrow[:, None] == crow[None, :]
    about[same] = -np.inf
    few = min(4 * k, len(cid))
    likely = np.argpartition(about, len(cid) - few, axis=1)[:, len(cid) - few:]
    about += width
    slack = SLACK * np.maximum(1, np.abs(query).sum(axis=1) * np.abs(vectors).max())
    slack = np.minimum(slack, np.finfo(float).max)[:, None]

    def kth(score: np.ndarray) -> np.ndarray:
        return np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] >= k else np.full((len(score), 1), -np.inf)

    # the k-th best of the likeliest is a floor that candidates must be able to reach
    score = np.stack([vectors[x] @ q for x, q in zip(likely, query)])
    score[np.take_along_axis(same, likely, axis=1)] = -np.inf
    left = (about >= kth(score) - slack) & ~same
    if np.count_nonzero(left) * DENSE > left.size:  # one product is cheaper than picking so many of them out
        score = np.where(left, query @ vectors.T, -np.inf)
    else:
        score = np.full(left.shape, -np.inf)
        score[left] = of_pairs(query, vectors, *np.nonzero(left))
    left &= score >= kth(score) - slack
    i, j = np.nonzero(left)
    return first_of_each(i, cid[j], of_pairs(query, vectors, i, j), k)


def usable(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, asked, rid) with v array<double>: the rows that take part, numbered."""
    t = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                       F.coalesce(asked, F.lit(False)).alias("asked"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    t = t.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                 & F.coalesce(fine, F.lit(False))).filter(F.exists("v", lambda x: x != 0))
    return staged(t.withColumn("rid", F.monotonically_increasing_id()), "ann-vectors")


def _blocks(t: DataFrame, count: int, centre: np.ndarray, turn: np.ndarray, name: str, coded: bool) -> DataFrame:
    """One row a block: row numbers, ids, vectors and (for candidates) codes as bytes."""
    dim = len(centre)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype("<f8")
        if v.shape[1] != dim:
            raise ValueError(f"vectors of dimension {dim} asked for, {v.shape[1]} found")
        bits, length, fit = encode(v, centre, turn) if coded else (np.empty((0, 0), np.uint8), np.empty(0), np.empty(0))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "rows": [pdf["rid"].to_numpy().astype("<i8").tobytes()],
                             "ids": [pdf["id"].to_numpy().astype("<i8").tobytes()],
                             "v": [v.tobytes()], "bits": [bits.tobytes()], "length": [length.tobytes()],
                             "fit": [fit.tobytes()]})

    dealt = t.select("rid", "id", "v", F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int").alias("block"))
    return staged(dealt.groupBy("block").applyInPandas(
        pack, "block int, rows binary, ids binary, v binary, bits binary, length binary, fit binary"), f"ann-{name}")


def search(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vec_col: str = "embedding",
           k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of every row for which ``asked`` holds."""
    spark = vectors.sparkSession
    base = usable(vectors, asked, id_col, vec_col)
    queries = base.filter("asked")
    schema = "query_id long, rank int, vec_id long, score double"
    first = base.select("id", F.size("v").alias("dim")).orderBy("id").limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema)
    dim = first[0]["dim"]
    means = base.agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
    centre, turn = np.array([m if m is not None else 0.0 for m in means]), rotation(dim)
    n, m = base.count(), queries.count()
    blocks, ask_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    cand = _blocks(base, blocks, centre, turn, "candidates", True)
    ask = _blocks(queries, ask_blocks, centre, turn, "queries", False)
    found_schema = "query_row long, query_id long, vec_id long, score double"

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}  # query block: rows and ids of its queries, and their k best so far
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qrow, qid = np.frombuffer(r.qrows, "<i8"), np.frombuffer(r.qids, "<i8")
                crow, cid = np.frombuffer(r.rows, "<i8"), np.frombuffer(r.ids, "<i8")
                code = (np.frombuffer(r.bits, np.uint8).reshape(len(cid), -1),
                        np.frombuffer(r.length, "<f8"), np.frombuffer(r.fit, "<f8"))
                qv = np.frombuffer(r.qv, "<f8").reshape(len(qid), -1)
                v = np.frombuffer(r.v, "<f8").reshape(len(cid), -1)
                so_far = [best[r.ask][2]] if r.ask in best else []
                for i in range(0, len(qid), STEP):
                    at, c, s = nearest(qrow[i:i + STEP], qv[i:i + STEP], crow, cid, v, code, centre, turn, k)
                    so_far.append((i + at, c, s))
                best[r.ask] = qrow.copy(), qid.copy(), first_of_each(*map(np.concatenate, zip(*so_far)), k)
        for qrow, qid, (at, c, s) in best.values():
            yield pd.DataFrame({"query_row": qrow[at], "query_id": qid[at], "vec_id": c, "score": s})

    # each part of the candidates meets each part of the queries in a task that reads both where they are staged:
    # no pair of blocks is shuffled or broadcast, and the number of tasks doesn't grow with the table
    ways = min(ask_blocks, shuffle_partitions(spark))
    cand = cand.drop("block").coalesce(max(1, -(-TASKS * shuffle_partitions(spark) // ways)))
    ask = ask.select(F.col("block").alias("ask"), F.col("rows").alias("qrows"), F.col("ids").alias("qids"),
                     F.col("v").alias("qv")).coalesce(ways)
    found = cand.crossJoin(ask.hint("shuffle_replicate_nl")).mapInPandas(meet, found_schema)
    place = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
