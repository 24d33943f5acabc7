"""Boosted trees against a search in plain Python."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosting as B
from tidewatch.plans import models as MD

FEATURES, K = ["a", "b", "c"], 3
BOUNDS = [[1.0, 2.0, 3.0, 4.0], [0.25, 0.5, 0.75], [1.0]]


def rows(n=160):
    rng = random.Random(11)
    out = []
    for _ in range(n):
        a, b, c = rng.randint(0, 5), rng.random(), rng.randint(0, 1)
        y = 0 if a < 2 else 1 if b < 0.5 else 2
        out.append((float(a), b, float(c), y if rng.random() < 0.9 else rng.randrange(K)))
    return out + [(None, float("nan"), 1.0, 1), (0.0, 0.25, 0.0, 0)]


def plain(data, p):
    """The same trees by loops: gradients as whole numbers, every threshold of every node tried."""
    clean = [[0.0 if v is None or math.isnan(v) else v for v in r[:3]] for r in data]
    ys = [r[3] for r in data]
    base = [math.log(sum(y == c for y in ys) / len(ys)) for c in range(K)]
    scores = [list(base) for _ in data]
    term = lambda g, h: (g / B.UNIT) * (g / B.UNIT) / (h / B.UNIT + p.l2)
    trees = [[] for _ in range(K)]
    for _ in range(p.rounds):
        grads = []
        for s, y in zip(scores, ys):
            e = [math.exp(v - max(s)) for v in s]
            q = [v / sum(e) for v in e]
            grads.append([(round((q[c] - (y == c)) * B.UNIT), round(q[c] * (1 - q[c]) * B.UNIT)) for c in range(K)])
        for c in range(K):
            size = (1 << (p.depth + 1)) - 1
            f, t, v = [-1] * size, [0.0] * size, [0.0] * size
            at = [0] * len(data)
            for depth in range(p.depth):
                for node in range((1 << depth) - 1, (1 << (depth + 1)) - 1):
                    mine = [i for i in range(len(data)) if at[i] == node]
                    best = None
                    for j, bounds in enumerate(BOUNDS):
                        for x in bounds:
                            left = [i for i in mine if clean[i][j] < x]
                            right = [i for i in mine if clean[i][j] >= x]
                            if len(left) < p.min_rows or len(right) < p.min_rows:
                                continue
                            sums = [(sum(grads[i][c][0] for i in s), sum(grads[i][c][1] for i in s)) for s in (left, right)]
                            gain = round(sum(term(*s) for s in sums) - term(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1]), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = gain, j, x, sums
                    if best:
                        f[node], t[node] = best[1], best[2]
                        for child, (g, h) in zip((2 * node + 1, 2 * node + 2), best[3]):
                            v[child] = -p.rate * (g / B.UNIT) / (h / B.UNIT + p.l2)
                        for i in mine:
                            at[i] = 2 * node + (2 if clean[i][best[1]] >= best[2] else 1)
            trees[c].append({"f": f, "t": t, "v": v})
            for i in range(len(data)):
                scores[i][c] += v[at[i]]
    return trees, scores


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "a double, b double, c double, target int")


def test_every_split_equals_a_plain_search(spark, data):
    p = B.Params(rounds=4, depth=2, min_rows=4, write_every=2)
    model = B.fit_boosted(data.repartition(5), FEATURES, k=K, params=p, bounds=BOUNDS)
    trees, scores = plain(rows(), p)
    for got, want in zip(model.trees, trees):
        assert [t["f"] for t in got] == [t["f"] for t in want] and [t["t"] for t in got] == [t["t"] for t in want]
        assert all(abs(x - y) < 1e-9 for g, w in zip(got, want) for x, y in zip(g["v"], w["v"]))
    out = model.predict(data.withColumn("i", F.monotonically_increasing_id())).orderBy("i").collect()
    for r, s in zip(out, scores):
        e = [math.exp(v - max(s)) for v in s]
        assert all(abs(x - y / sum(e)) < 1e-9 for x, y in zip(r["p_lex"], e))
    assert abs(sum(v for _, v in model.importance()) - 1) < 1e-9


def test_a_model_does_not_depend_on_partitions_or_on_when_scores_are_written(spark, data):
    one = B.fit_boosted(data.coalesce(1), FEATURES, k=K, params=B.Params(rounds=3, depth=2, write_every=9), bounds=BOUNDS)
    many = B.fit_boosted(data.orderBy(F.rand(3)).repartition(7), FEATURES, k=K, params=B.Params(rounds=3, depth=2, write_every=1), bounds=BOUNDS)
    assert one == many


def test_quantile_thresholds_constant_features_and_absent_classes(spark, data):
    df = data.withColumn("same", F.lit(7.0)).filter("target < 2")
    model = B.fit_boosted(df, [*FEATURES, "same"], k=4, params=B.Params(rounds=2, depth=2))
    assert all(f != 3 for own in model.trees for t in own for f in t["f"])
    p = model.predict(df).agg(F.max(F.get("p_lex", F.lit(3)))).first()[0]
    assert 0 < p < 0.02


def test_saved_and_loaded_and_in_the_lexical_path(spark, data):
    model = B.fit_boosted(data, FEATURES, k=K, params=B.Params(rounds=2, depth=2), bounds=BOUNDS)
    path = tempfile.mkdtemp(prefix="tw-boost-", dir="/tmp") + "/m"
    MD.save_model(model, path)
    assert MD.load_model(path) == model
    assert MD.lexical_probs(model, data).columns == [*data.columns, "p_lex"]
    imp = MD.forest_importance(spark, model).collect()
    assert {r["feature"] for r in imp} == set(FEATURES) and abs(sum(r["importance"] for r in imp) - 1) < 1e-9


def test_no_rows(spark, data):
    model = B.fit_boosted(data.limit(0), FEATURES, k=K, params=B.Params(rounds=2), bounds=BOUNDS)
    assert model.trees == [[], [], []]
    assert all(abs(x - 1 / 3) < 1e-9 for x in model.predict(data).first()["p_lex"])


def test_a_task_sends_one_histogram_however_many_rows_it_has():
    """rows are added up where they lie, not dealt out as a row a class and feature."""
    import numpy as np
    import pyarrow as pa
    rng, k, width = np.random.default_rng(3), 3, 2
    root = {"f": [1, -1, -1], "t": [2.0, 0.0, 0.0], "v": [0.0, -0.5, 0.5]}
    want, batches = {}, []
    for bins in (3, 5):  # the second batch has bins that the first lacks
        x = rng.integers(0, bins, (2000, width)).astype(float)
        y, score = rng.integers(0, k, 2000), rng.normal(size=(2000, k))
        batches.append(pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array([int(v) for v in y], pa.int32()),
                                                   pa.array(score.tolist())], names=["x", "y", "score"]))
        for i in range(2000):
            own = [s + (0.5 if x[i][1] >= 2 else -0.5) if c == 1 else s for c, s in enumerate(score[i])]
            e = [math.exp(s - max(own)) for s in own]
            for c in range(k):
                p = e[c] / sum(e)
                node = 1 + int(x[i][1] >= 2)
                for f in range(width):
                    t = want.setdefault((c, node, f, x[i][f]), [0, 0, 0])
                    t[0] += round((p - (y[i] == c)) * B.UNIT)
                    t[1] += round(p * (1 - p) * B.UNIT)
                    t[2] += 1
    out = list(B._task_histogram([root] * k, [[], [root], []], k, 1)(iter(batches)))
    assert len(out) == 1 and out[0].num_rows == len(want) <= k * 2 * width * 5
    assert {(r["cls"], r["node"], r["feature"], r["bin"]): [r["g"], r["h"], r["n"]] for r in out[0].to_pylist()} == want


def test_histograms_explode_no_rows(spark, data):
    rows = B.binned(data, FEATURES, "target", BOUNDS, [0.0] * K)
    plan = B.histogram(rows, [{"f": [-1], "t": [0.0], "v": [0.0]}] * K, K, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
