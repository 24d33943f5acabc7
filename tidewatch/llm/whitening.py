"""Whitening of embeddings onto the leading components of their covariance.

Entries become whole numbers, ``floor(1024 c) + 100000``, so counts and sums are exact.  Passes over
the table: sums per dimension; the covariance, centred before multiplying; the covariance of the
whitened vectors (a check); the output.  Each task adds up its rows and hands on one row a dimension;
these are added up by dimension in ``SALTS`` parts, so that the driver receives ``SALTS`` times the
matrix, whatever the number of tasks.  The eigenpairs (:mod:`spectrum`) are found on the driver from
that matrix alone and reach the tasks with their function.

Rows whose vector is null, empty, or holds a null, a NaN or an infinity take no part, nor do vectors
shorter than the longest one.  Null and repeated ids are rows like others; every column of the input
stays.  An empty table gives no rows.  Components beyond the rank (an eigenvalue below the rounding of
the trace, as for equal vectors or fewer rows than components) have no scale: their whitened value is
null, and the check leaves them out.  ``explained`` is null if the trace is zero.  Entries of 2^42 and more, or
sums and deviations beyond 64 bits, raise ValueError: no exact whole number could be returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import spectrum
from .common import place, positional

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
SALTS = 16
LONG = 1 << 63


@dataclass
class Model:
    n: int
    sums: list[int]  #: of the whole numbers, a dimension each
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: unit vectors, as columns
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # the nearest double of each quotient

    @property
    def used(self) -> int:
        """Components with an eigenvalue above rounding."""
        return int((self.values > len(self.sums) * spectrum.EPS * self.trace).sum())

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors[:, :self.used] / np.sqrt(self.values[:self.used])

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def whole(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of length ``d`` as whole numbers, a row each."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    if np.abs(c).max(initial=0) >= 1 << 42:
        raise ValueError("entries of 2^42 and more have no exact whole number here")
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _added(df: DataFrame, add, kind: str) -> dict[int, np.ndarray]:
    """Arrays by number: ``add(batches)`` gives a task's, equal numbers are added up over all tasks."""
    schema = f"i int, salt int, row array<{kind}>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = add(batches)
        if total:
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_pylist([{"i": i, "salt": salt, "row": r.tolist()} for i, r in total.items()],
                                             pa.schema([("i", pa.int32()), ("salt", pa.int32()), ("row", pa.list_(number))]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for i, salt, row in zip(b["i"].to_pylist(), b["salt"].to_pylist(), b["row"]):
                row = row.values.to_numpy(zero_copy_only=False)
                total[i, salt] = total[i, salt] + row if (i, salt) in total else row
        if total:
            yield pa.RecordBatch.from_pylist([{"i": i, "salt": s, "row": r.tolist()} for (i, s), r in total.items()],
                                             pa.schema([("i", pa.int32()), ("salt", pa.int32()), ("row", pa.list_(number))]))
    number = pa.int64() if kind == "long" else pa.float64()
    out: dict = {}
    rows = df.mapInArrow(local, schema).repartition("i", "salt").mapInArrow(merged, schema).collect()
    for r in sorted(rows, key=lambda r: (r["i"], r["salt"])):  # at most SALTS rows a dimension
        row = np.array(r["row"], dtype=object if kind == "long" else float)
        out[r["i"]] = out[r["i"]] + row if r["i"] in out else row
    return out


def _add_sums(batches):
    """For each length of vector: rows, a bound of the sums in units of 2^20, sums."""
    total: dict = {}
    for b in batches:
        lengths = np.diff(b.column(0).offsets.to_numpy())
        for d in map(int, np.unique(lengths)):
            x = whole(b.column(0).filter(pa.array(lengths == d)), d)
            bound = (np.abs(x).max(axis=1) >> 20).sum() + len(x)
            now = np.concatenate([[len(x), bound], x.sum(axis=0)])
            total[d] = total[d] + now if d in total else now
    return total


def _add_products(centre):
    """Sums of the products of centred vectors, a row of the matrix each; ``centre`` maps an Arrow column to them."""
    def add(batches):
        total = None
        for b in batches:
            y = centre(b.column(0))
            now = y.T @ y
            total = now if total is None else total + now
        return {} if total is None else dict(enumerate(total))
    return add


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Exact sums, covariance, leading eigenpairs; None for a table without usable vectors."""
    v = usable(df.select(F.col(vector).alias("v")), "v").select(F.col("v").cast("array<double>").alias("v"))
    sums = _added(v, _add_sums, "long")
    if not sums:
        return None
    d = max(sums)
    n, bound, *s = map(int, sums[d])
    if bound >= LONG >> 20:
        raise ValueError("the sum of a dimension does not fit in a long")
    v = v.filter(F.size("v") == d)
    mean = np.array([x / n for x in s])
    products = _added(v, _add_products(lambda c: whole(c, d) - mean), "double")
    covariance = np.stack([products[i] for i in range(d)]) / n
    values, vectors = spectrum.leading(covariance, components)
    model = Model(n, s, values, vectors, float(np.trace(covariance)))
    if model.used:
        # one more column of ones gives the sums, so that the check is centred too
        rows = _added(v, _add_products(lambda c: np.column_stack([model.whiten(whole(c, d)), np.ones(len(c))])), "double")
        m = np.stack([rows[i] for i in range(model.used + 1)]) / n
        mean_white = m[:-1, -1]
        off = m[:-1, :-1] - np.outer(mean_white, mean_white) - np.eye(model.used)
        model.identity_error = float(np.abs(off).max())
    return model


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of ``(n x - S)^2`` in whole numbers, a row each."""
    most = max(n * max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, sums)))
    if 2 * most < LONG:
        y = n * x - np.array(sums, np.int64)
        m = int(np.abs(y).max())
        if len(sums) * m * m < LONG:
            return (y * y).sum(axis=1)
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    if max(exact) >= LONG:
        raise ValueError("a deviation does not fit in a long")
    return exact.astype(np.int64)


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
           columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the usable rows with ``n``, ``deviation``, ``whitened`` (an array, null beyond the rank),
    ``explained`` (an array) and ``identity_error``."""
    t, names = positional(df)
    columns = names if columns is None else columns
    at = place(names, vector)
    own = [place(names, c) for c in columns]
    model = fit(df, vector, components)
    t = usable(t, at)
    k = len(model.values) if model else 0
    d = len(model.sums) if model else 0
    t = t.filter(F.size(at) == d).select(*own, F.col(at).cast("array<double>").alias("v"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(b["v"], d)
            w = np.full((len(x), k), np.nan)
            w[:, :model.used] = model.whiten(x)
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(own)], pa.array(_deviation(x, model.n, model.sums)), lists],
                                             [*own, "deviation", "whitened"])
    schema = StructType([*[t.schema[c] for c in own], StructField("deviation", LongType()),
                         StructField("whitened", ArrayType(DoubleType()))])
    out = t.mapInArrow(apply, schema)
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained()]) if k else F.array().cast("array<double>")
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, columns)], F.lit(model.n if model else 0).cast("long").alias("n"),
                      "deviation", "whitened", explained.alias("explained"),
                      F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row a vector and component, numbered from 1 by falling eigenvalue."""
    rest = [c for c in whitened.columns if c not in ("whitened", "explained")]
    pairs = F.arrays_zip("whitened", "explained")
    t = whitened.select(*rest, F.posexplode(pairs).alias("at", "pair"))
    return t.select(*rest, (F.col("at") + 1).alias("component"), F.col("pair.whitened").alias("whitened"),
                    F.col("pair.explained").alias("explained"))
