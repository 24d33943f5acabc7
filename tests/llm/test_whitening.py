"""Whitening against a dense eigendecomposition, and the counts and iterations on their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import spectrum, whitening

from llm_fixtures import SF001


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [7, 7, 7, 2, 1, 1], [3, 3 - 1e-9, 1, 0, 0, 0], [1] * 6, [1e9, 1, 1e-6, 1e-6, 0, 0],
    [2, 1, 0, -1, -2, -3], [0] * 6, [4.0]])
def test_counts_and_eigenpairs(values):
    rng = np.random.default_rng(3)
    a = symmetric(rng, np.array(values, float))
    for s in (-2.5, -0.25, 0.3, 0.75, 1.5, 2.5, 6):
        assert spectrum.count_above(a, s) == sum(v > s for v in values)
    e, v = spectrum.leading(a, 4)
    scale = max(map(abs, values)) or 1
    assert np.allclose(e, sorted(values, reverse=True)[:4], rtol=0, atol=1e-12 * scale)
    assert np.allclose(v.T @ v, np.eye(len(e)), atol=1e-12)
    assert np.abs(a @ v - v * e).max() <= 1e-12 * scale


def test_many_random_matrices():
    rng = np.random.default_rng(4)
    for _ in range(40):
        d = int(rng.integers(1, 30))
        x = rng.standard_normal((int(rng.integers(1, 60)), d)) * rng.gamma(1, 3, d)
        a = x.T @ x / len(x)
        want = np.linalg.eigvalsh(a)[::-1]
        e, v = spectrum.leading(a, 8)
        assert np.allclose(e, want[:8], rtol=0, atol=1e-12 * want[0])
        assert np.abs(a @ v - v * e).max() <= 1e-11 * want[0]
        s = float(rng.uniform(0, want[0]))
        assert spectrum.count_above(a, s) == (want > s).sum()


def brute(rows):
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in fine], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = (x - s / n).astype(float)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return [i for i, _ in fine], ((n * x - s) ** 2).sum(axis=1), y @ u[:, :8] / np.sqrt(e[:8]), e / np.trace(cov)


def held(got, rows):
    ids, deviation, white, explained = brute(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    sign = {}
    for j, i in enumerate(ids):
        for c in range(k):
            r = by[i][c + 1]
            assert (r["n"], r["deviation"]) == (len(ids), deviation[j])
            assert abs(r["explained"] - explained[c]) <= 1e-9 * explained[c] and r["identity_error"] < 1e-9
            if abs(white[j, c]) > 0.1:
                sign.setdefault(c, np.sign(r["whitened"] * white[j, c]))
            assert abs(r["whitened"] - sign.get(c, 1) * white[j, c]) < 1e-6 or c not in sign
    assert len(sign) == k


def test_the_query_equals_a_dense_decomposition(spark):
    from tidewatch.llm.queries import op13_embedding_whitening
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    held(op13_embedding_whitening(spark, SF001).collect(), rows)


def test_odd_rows_and_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("n", "i", "salt", "row", "v", "c0", "deviation", "whitened")})
    out = whitening.whiten(df, columns=["vec_id"])
    held(whitening.by_component(out).collect(), rows)
    short = df.select("vec_id", "embedding").unionByName(spark.createDataFrame([(200, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    assert whitening.fit(short).n == 60  # a shorter vector takes no part
    twice = df.select("vec_id", "embedding").unionByName(df.select("vec_id", "embedding").filter("vec_id = 3")).unionByName(
        spark.createDataFrame([(None, [0.5] * 5)], "vec_id long, embedding array<double>"))
    kept = whitening.whiten(twice).collect()
    assert len(kept) == 62 and sum(r["vec_id"] is None for r in kept) == 1


def test_no_rows_one_row_and_equal_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.by_component(whitening.whiten(spark.createDataFrame([], schema))).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    for rows in ([(1, [0.5, -0.5])], [(i, [0.5, -0.5]) for i in range(9)]):
        got = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, schema))).collect()
        assert len(got) == 2 * len(rows)
        assert all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in got)
    few = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], schema)).collect()
    assert [x is None for x in few[0]["whitened"]] == [False, True, True] and few[0]["identity_error"] < 1e-9


def test_whole_numbers_beyond_a_long_are_refused(spark):
    schema = "vec_id long, embedding array<double>"
    for far in (1e30, 4e12):
        df = spark.createDataFrame([(1, [far, 0.0]), (2, [-far, 1.0])], schema)
        with pytest.raises(Exception, match="whole number|fit in a long"):
            whitening.whiten(df).collect()
