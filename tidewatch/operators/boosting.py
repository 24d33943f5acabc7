"""Gradient-boosted trees from DataFrame aggregates (M1).

Features are binned once.  A round fits one tree a class to the softmax gradient; a level of all its trees
is one aggregate of gradient and curvature by (class, node, feature, bin): each task adds its rows to a
histogram, batch by batch, and the histograms are summed after a shuffle; then prefix sums over the bins
and the best split of each node.  The driver receives one row a node.  Sums are of whole numbers (2^20 a
unit), so a model does not depend on how rows lie in partitions.  Scores so far are written every few
rounds; between two writings the trees are applied on the way, to whole batches.

Null and NaN features count as 0.  A node is split only where both sides keep ``min_rows`` rows and the
gain is positive; equal gains go to the first feature, then the lowest threshold.  Left is ``x < threshold``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1 << 20


@dataclass
class Params:
    rounds: int = 15
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    min_rows: int = 5
    bins: int = 32
    write_every: int = 5


@dataclass
class BoostedTrees:
    """Log priors and, a class, its trees: heap-ordered feature (-1 at a leaf), threshold and value."""
    features: list[str]
    base: list[float]
    trees: list[list[dict]]
    gains: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        return BoostedTrees(**json.loads(text))

    def scores(self, x: Column) -> Column:
        """Raw score a class of an array of feature values."""
        return _add(F.array(*[F.lit(b) for b in self.base]), self.trees, x)

    def probabilities(self, x: Column) -> Column:
        return softmax(self.scores(x))

    def predict(self, df: DataFrame, out: str = "p_lex") -> DataFrame:
        """``df`` with the class probabilities of every row (batch or stream)."""
        return df.withColumn(out, self.probabilities(values(self.features)))

    def importance(self) -> list[tuple[str, float]]:
        """Share of the total gain of all splits, a feature."""
        total = sum(self.gains.values()) or 1.0
        return [(f, self.gains.get(f, 0.0) / total) for f in self.features]


def values(features) -> Column:
    zero = F.lit(0.0)
    return F.array(*[F.nanvl(F.coalesce(F.col(f).cast("double"), zero), zero) for f in features])


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest is taken off first."""
    def shares(s):
        e = F.transform(s, lambda v: F.exp(v - F.array_max(s)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))
    # through a one-element array the scores are computed once
    return F.transform(F.array(scores), shares)[0]


def _matrix(lists):
    """An Arrow array of equally long lists as rows of a numpy array."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _places(tree: dict, x, steps: int):
    """Heap place that each row of ``x`` has reached in ``tree`` after ``steps``."""
    f, t = np.array(tree["f"]), np.array(tree["t"], dtype=float)
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(steps):
        own = f[at]
        at = np.where(own < 0, at, 2 * at + 1 + (x[rows, np.maximum(own, 0)] >= t[at]))
    return at


def _depth(trees) -> int:
    size = max((len(t["f"]) for c in trees for t in c), default=1)
    return int(math.log2(size + 1)) - 1


def _added(scores, trees: list[list[dict]], x):
    """``scores`` (a row a row, a column a class) plus the values of each class's trees at ``x``."""
    depth, out = _depth(trees), np.array(scores, dtype=float)
    for c, own in enumerate(trees):
        for t in own:
            out[:, c] += np.array(t["v"], dtype=float)[_places(t, x, depth)]
    return out


def _add(scores: Column, trees: list[list[dict]], x: Column) -> Column:
    """``scores`` plus the values of each class's trees at ``x``."""
    if not any(trees):
        return scores

    def add(s: pa.Array, v: pa.Array) -> pa.Array:
        if not len(s):
            return s
        out = _added(_matrix(s), trees, _matrix(v))
        return pa.ListArray.from_arrays(pa.array(range(0, out.size + 1, len(trees)), pa.int32()), pa.array(out.ravel()))
    return F.arrow_udf(add, "array<double>")(scores, x)


def boundaries(train: DataFrame, features, bins: int) -> list[list[float]]:
    """Candidate thresholds a feature: distinct quantiles (at most ``bins`` numbers a feature reach the driver)."""
    clean = train.select(values(features).alias("x")).select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(features))])
    found = clean.approxQuantile(clean.columns, [i / bins for i in range(1, bins)], 1 / (8 * bins))
    low = clean.agg(*[F.min(c).alias(c) for c in clean.columns]).first()
    return [sorted({q for q in qs if q > m}) for qs, m in zip(found, low)]


def binned(train: DataFrame, features, label: str, bounds: list[list[float]], base: list[float]) -> DataFrame:
    """``(x, y, score)``: bin numbers, class and starting scores; a value equal to a threshold lies above it."""
    t = train.select(values(features).alias("v"), F.col(label).cast("int").alias("y"))
    t = t.select("y", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(len(features))])
    used = [i for i, b in enumerate(bounds) if b]
    if used:
        cut = Bucketizer(splitsArray=[[-math.inf, *bounds[i], math.inf] for i in used],
                         inputCols=[f"v{i}" for i in used], outputCols=[f"b{i}" for i in used])
        t = cut.transform(t)
    bins = [F.col(f"b{i}") if b else F.lit(0.0) for i, b in enumerate(bounds)]
    return t.select(F.array(*bins).cast("array<double>").alias("x"), "y", F.array(*[F.lit(b) for b in base]).alias("score"))


def _whole(v):
    """Units of ``v`` as whole numbers, halves away from zero."""
    size = np.abs(v * UNIT)
    low = np.trunc(size)
    return np.copysign(low + (size - low >= 0.5), v)


def _task_histogram(trees: list[dict], waiting: list[list[dict]], k: int, depth: int):
    """Batches of ``(x, y, score)`` to the sums of all of them, by (cls, node, feature, bin)."""
    first, nodes = (1 << depth) - 1, 1 << depth

    def run(batches):
        sums = None  # class, kind (g, h, n), node, feature, bin
        for b in batches:
            if not b.num_rows:
                continue
            x, score = _matrix(b.column(0)), _matrix(b.column(2))
            y = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            score = _added(score, waiting, x)
            e = np.exp(score - score.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            width, bins = x.shape[1], int(x.max(initial=0)) + 1
            if sums is None:
                sums = np.zeros((k, 3, nodes, width, bins), dtype=np.int64)
            elif bins > sums.shape[-1]:
                sums = np.pad(sums, [(0, 0)] * 4 + [(0, bins - sums.shape[-1])])
            shape = sums.shape[2:]
            cell = x.astype(np.int64) + np.arange(width) * shape[2]
            for c in range(k):
                at = _places(trees[c], x, depth) - first
                here = np.flatnonzero(at >= 0)
                cells = (cell[here] + (at[here] * shape[1] * shape[2])[:, None]).ravel()
                q = p[here, c]
                g = np.where(known[here], _whole(q - (y[here] == c)), 0)
                for i, own in enumerate((g, _whole(q * (1 - q)), None)):
                    # sums of a batch stay far below 2^53: exact as doubles
                    own = own if own is None else np.repeat(own, width)
                    found = np.bincount(cells, own, math.prod(shape))
                    sums[c, i] += np.rint(found).astype(np.int64).reshape(shape)
        if sums is None:
            return
        cls, node, feature, place = np.nonzero(sums[:, 2])
        g, h, n = (sums[cls, i, node, feature, place] for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls.astype(np.int32)), pa.array((node + first).astype(np.int32)), pa.array(feature.astype(np.int32)),
             pa.array(place.astype(float)), pa.array(g), pa.array(h), pa.array(n)],
            names=["cls", "node", "feature", "bin", "g", "h", "n"])
    return run


def histogram(rows: DataFrame, trees: list[dict], k: int, depth: int, waiting: list[list[dict]] | None = None) -> DataFrame:
    """Sums by (cls, node, feature, bin) over the nodes of ``trees`` (one a class) at ``depth``.

    ``rows``: ``x`` (bins), ``y`` and ``score``, to which the trees ``waiting`` (some a class) are added.
    A task holds one histogram, classes x nodes x features x bins, whatever its rows.
    """
    of = rows.select("x", F.col("y").cast("int").alias("y"), "score")
    part = of.mapInArrow(_task_histogram(trees, waiting or [[] for _ in range(k)], k, depth),
                         "cls int, node int, feature int, bin double, g long, h long, n long")
    return part.groupBy("cls", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def _term(g: Column, h: Column, l2: float) -> Column:
    return (g / UNIT) * (g / UNIT) / (h / UNIT + F.lit(l2))


def split_gains(hist: DataFrame, l2: float, min_rows: int) -> DataFrame:
    """Each place to split, with its gain (null where it is not allowed) and both sides' sums; ``bin`` is the
    last one on the left."""
    of = Window.partitionBy("cls", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    t = hist.select("*", *[F.sum(c).over(upto).alias(f"{c}_left") for c in "ghn"],
                    *[F.sum(c).over(of).alias(f"{c}_all") for c in "ghn"])
    t = t.select("cls", "node", "feature", "bin", "g_left", "h_left", "n_left", "g_all", "h_all", "n_all",
                 *[(F.col(f"{c}_all") - F.col(f"{c}_left")).alias(f"{c}_right") for c in "ghn"])
    gain = (_term(F.col("g_left"), F.col("h_left"), l2) + _term(F.col("g_right"), F.col("h_right"), l2)
            - _term(F.col("g_all"), F.col("h_all"), l2))
    fine = (F.col("n_left") >= min_rows) & (F.col("n_right") >= min_rows)
    # rounded, so that equal gains are equal whatever the order of operations
    return t.withColumn("gain", F.when(fine, F.round(gain, 9)))


def best_splits(gains: DataFrame, by=("cls", "node")) -> DataFrame:
    """The allowed split of the largest gain, first feature and lowest bin; ``best`` is null without one."""
    s = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "g_left", "h_left", "n_left", "g_right", "h_right")
    return gains.groupBy(*by).agg(F.max(F.when(F.col("gain") > 0, s)).alias("best"))


def log_priors(train: DataFrame, label: str, k: int) -> list[float]:
    """Starting scores: logarithms of the class shares; an absent class counts as half a row."""
    n = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("int").alias("y")).count().collect()}  # one row a class
    total = sum(n.values()) or 1
    return [math.log(max(n.get(c, 0), 0.5) / total) for c in range(k)]


def _grow(rows: DataFrame, waiting: list[list[dict]], k: int, p: Params, gains: dict[int, float]) -> list[dict]:
    """One tree a class, in bin numbers (a split's threshold is the first bin on its right)."""
    size = (1 << (p.depth + 1)) - 1
    trees = [{"f": [-1] * size, "t": [0.0] * size, "v": [0.0] * size} for _ in range(k)]
    for depth in range(p.depth):
        found = best_splits(split_gains(histogram(rows, trees, k, depth, waiting), p.l2, p.min_rows)).collect()
        split = [r for r in found if r["best"] is not None]
        for r in split:
            t, i, b = trees[r["cls"]], r["node"], r["best"]
            t["f"][i], t["t"][i] = -b["f"], -b["b"] + 1
            gains[-b["f"]] = gains.get(-b["f"], 0.0) + b["gain"]
            for child, g, h in ((2 * i + 1, b["g_left"], b["h_left"]), (2 * i + 2, b["g_right"], b["h_right"])):
                t["v"][child] = -p.rate * (g / UNIT) / (h / UNIT + p.l2)
        if not split:
            break
    return trees


def fit_boosted(train: DataFrame, features, label: str = "target", k: int = 4, params: Params | None = None,
                bounds: list[list[float]] | None = None) -> BoostedTrees:
    """Train on all rows of ``train``; ``bounds`` replaces the quantiles as candidate thresholds."""
    from ..session import materialize
    p, features = params or Params(), list(features)
    bounds = bounds if bounds is not None else boundaries(train, features, p.bins)
    base = log_priors(train, label, k)
    state = materialize(binned(train, features, label, bounds, base), "boost_state")
    gains: dict[int, float] = {}
    done: list[list[dict]] = [[] for _ in range(k)]
    waiting: list[list[dict]] = [[] for _ in range(k)]
    for r in range(p.rounds):
        if r and r % p.write_every == 0:
            state = materialize(state.withColumn("score", _add(F.col("score"), waiting, F.col("x"))), "boost_state")
            waiting = [[] for _ in range(k)]
        trees = _grow(state, waiting, k, p, gains)
        if all(t["f"][0] < 0 for t in trees):
            break
        for c in range(k):
            waiting[c].append(trees[c])
            done[c].append(trees[c])
    real = [[{"f": t["f"], "v": t["v"], "t": [bounds[f][int(b) - 1] if f >= 0 else 0.0 for f, b in zip(t["f"], t["t"])]}
             for t in own] for own in done]
    return BoostedTrees(features, base, real, {features[f]: g for f, g in gains.items()})
