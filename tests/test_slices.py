"""Training in slices: best weights, resumption, and the model's numbers restated from its weights."""

import random
import tempfile

import numpy as np
import pytest

from tidewatch.operators.metrics import log_loss
from tidewatch.plans import models as MD

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)

    def rows(n):
        out = []
        for _ in range(n):
            x = [rng.gauss(0, 1) for _ in COLS]
            y = int(x[0] > 0) + 2 * int(x[1] + 0.3 * rng.gauss(0, 1) > 0)
            out.append((*x, y))
        return out
    schema = "a double, b double, c double, target int"
    return spark.createDataFrame(rows(160), schema), spark.createDataFrame(rows(60), schema)


def folder():
    return tempfile.mkdtemp(prefix="tw-slices-", dir="/tmp")


def forward(model, x):
    """The network in numpy, from the stored weights."""
    scaler, net = model.stages[1], model.stages[2]
    x = (x - scaler.mean.toArray()) / scaler.std.toArray()
    w, at, sizes = net.weights.toArray(), 0, [len(COLS), 8, 4]
    for i, (n, m) in enumerate(zip(sizes, sizes[1:])):
        k, b = w[at:at + n * m].reshape(n, m), w[at + n * m:at + n * m + m]
        at += n * m + m
        x = x @ k + b
        x = 1 / (1 + np.exp(-x)) if i == 0 else np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    return x


def test_the_best_slice_is_kept_and_its_numbers_follow_from_its_weights(spark, tables):
    train, val = tables
    place = folder()
    model, table = MD.train_graph_in_slices(train, val, COLS, place, hidden=8, slices=5, slice_iter=4, patience=9)
    t = table.orderBy("slice").collect()
    assert [r["slice"] for r in t] == [0, 1, 2, 3, 4]
    kept = [r for r in t if r["kept"]]
    assert len(kept) == 1 and kept[0]["val_log_loss"] == min(r["val_log_loss"] for r in t)
    rows = MD.graph_probs(model, val, COLS).collect()
    p = forward(model, np.array([[r[c] for c in COLS] for r in rows]))
    assert np.allclose(p, np.array([r["p_graph"] for r in rows]), atol=1e-9)
    loss = -np.mean([np.log(p[i, r["target"]] + 1e-9) for i, r in enumerate(rows)])
    assert abs(loss - kept[0]["val_log_loss"]) < 1e-9
    first = log_loss(MD.graph_probs(MD.load_model(f"{place}/slice=0/model"), train, COLS), "p_graph", "target").first()[0]
    last = log_loss(MD.graph_probs(MD.load_model(f"{place}/slice=4/model"), train, COLS), "p_graph", "target").first()[0]
    assert last < first  # a slice goes on from the one before


def test_training_goes_on_after_the_last_whole_slice(spark, tables, monkeypatch):
    train, val = tables
    whole, there = folder(), folder()
    want = MD.train_graph_in_slices(train, val, COLS, whole, hidden=8, slices=3, slice_iter=3)[1].collect()
    calls = []
    fit = MD.MultilayerPerceptronClassifier._fit

    def lost(self, data):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return fit(self, data)
    with monkeypatch.context() as m:
        m.setattr(MD.MultilayerPerceptronClassifier, "_fit", lost)
        with pytest.raises(RuntimeError):
            MD.train_graph_in_slices(train, val, COLS, there, hidden=8, slices=3, slice_iter=3)
        got = MD.train_graph_in_slices(train, val, COLS, there, hidden=8, slices=3, slice_iter=3)[1].collect()
        assert len(calls) == 4  # one whole, one lost, two more
    assert [(r["slice"], r["kept"]) for r in got] == [(r["slice"], r["kept"]) for r in want]
    assert all(abs(a["val_log_loss"] - b["val_log_loss"]) < 1e-6 for a, b in zip(got, want))


def test_patience_ends_the_training(spark, tables):
    train, val = tables
    _, table = MD.train_graph_in_slices(train, val, COLS, folder(), hidden=8, slices=30, slice_iter=15, patience=1)
    n = table.count()
    assert n < 30 and table.filter("kept").first()["slice"] == n - 2
