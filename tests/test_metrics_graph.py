import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.constants import FEATURE_COLS
from tidewatch.operators import graph as GR
from tidewatch.operators import metrics as M
from tidewatch.plans import models as MD

# published hybrid confusion matrix (rows = true class, columns = predicted)
MATRIX = [[61264, 211, 2720, 21], [44, 14368, 51, 5], [1151, 423, 12497, 46], [38, 42, 193, 4605]]


@pytest.fixture(scope="module")
def matrix_rows(spark):
    cells = [(i, j, n) for i, row in enumerate(MATRIX) for j, n in enumerate(row)]
    df = spark.createDataFrame(cells, "y int, yhat int, n int")
    return df.select("y", "yhat", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_")


def test_summary_matches_published_matrix(matrix_rows):
    s = M.summary(matrix_rows, "y", "yhat").first()
    assert s.n_rows == 97679
    assert math.isclose(s.accuracy, 0.949375, abs_tol=1e-6)
    assert math.isclose(s.macro_f1, 0.937398, abs_tol=1e-6)


def test_per_class_and_confusion(matrix_rows):
    pc = {r.label: r for r in M.per_class(M.label_counts(matrix_rows, "y", "yhat")).collect()}
    for lab, (p, r, f) in enumerate([(0.980271, 0.954030, 0.966973), (0.955065, 0.993088, 0.973706),
                                     (0.808292, 0.885245, 0.845020), (0.984606, 0.944034, 0.963893)]):
        assert math.isclose(pc[lab].precision, p, abs_tol=1e-6)
        assert math.isclose(pc[lab].recall, r, abs_tol=1e-6)
        assert math.isclose(pc[lab].f1, f, abs_tol=1e-6)
    conf = {(r.y, r.yhat): r.n for r in M.confusion(matrix_rows, "y", "yhat").collect()}
    assert conf == {(i, j): MATRIX[i][j] for i in range(4) for j in range(4)}
    rep = {r.row: r for r in M.class_report(matrix_rows, "y", "yhat").collect()}
    assert math.isclose(rep["macro avg"].f1, 0.937398, abs_tol=1e-6)


def _brute_auc(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l]
    neg = [s for s, l in zip(scores, labels) if not l]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [(g, round(rnd.random(), 2), rnd.random() < 0.3) for g in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "cls int, score double, is_pos boolean")
    got = {r.cls: r.auc for r in M.auc(df).collect()}
    got_q = {r.cls: r.auc for r in M.auc(df, bucket=M.value_bucket(df, 16)).collect()}
    for g in range(3):
        s = [r[1] for r in rows if r[0] == g]
        lab = [r[2] for r in rows if r[0] == g]
        assert math.isclose(got[g], _brute_auc(s, lab), abs_tol=1e-12)
        assert math.isclose(got_q[g], _brute_auc(s, lab), abs_tol=1e-12)


def _ref_roc(scores, labels):
    """ROC curve as commonly defined: distinct thresholds descending, collinear
    intermediate points dropped, a leading (0, 0) point at +inf."""
    import numpy as np
    order = np.argsort(-np.asarray(scores), kind="mergesort")
    s = np.asarray(scores)[order]
    y = np.asarray(labels, dtype=float)[order]
    idx = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    thr = s[idx]
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fps, tps, thr = np.r_[0, fps], np.r_[0, tps], np.r_[np.inf, thr]
    return list(zip(thr, tps / tps[-1], fps / fps[-1]))


def test_roc_points_match_reference_curve(spark):
    rnd = random.Random(11)
    rows = [(g, round(rnd.random(), 1), rnd.random() < 0.4) for g in range(2) for _ in range(300)]
    df = spark.createDataFrame(rows, "cls int, score double, is_pos boolean")
    for buckets in (M.value_bucket(df, 4), None):
        got = {}
        for r in M.roc_points(df, bucket=buckets).collect():
            got.setdefault(r.cls, []).append((r.threshold, r.tpr, r.fpr))
        for g in range(2):
            ref = _ref_roc([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
            mine = sorted(got[g], key=lambda t: -t[0])
            assert len(mine) == len(ref)
            for (t1, a1, b1), (t2, a2, b2) in zip(mine, ref):
                assert t1 == t2 and math.isclose(a1, a2) and math.isclose(b1, b2)


def test_roc_points_monotone(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(0, rnd.random(), rnd.random() < 0.5) for _ in range(300)],
                               "cls int, score double, is_pos boolean")
    pts = sorted(M.roc_points(df, drop_intermediate=False).collect(), key=lambda r: -r.threshold)
    tpr = [p.tpr for p in pts]
    fpr = [p.fpr for p in pts]
    assert tpr == sorted(tpr) and fpr == sorted(fpr) and tpr[-1] == 1.0 and fpr[-1] == 1.0


@pytest.fixture(scope="module")
def graph_fixture(spark):
    rows = []
    for i in range(20):
        dom = "test1.com" if i % 2 == 0 else "test2.com"
        rows.append((i, f"http://{dom}/path{i}", 0 if i % 2 == 0 else 2, "train" if i < 14 else "test",
                     dom, "com", *[1.0 + 0.1 * i] * len(FEATURE_COLS)))
    schema = ("page_id int, url string, target int, split string, registered_domain string, tld string, "
              + ", ".join(f"{c} double" for c in FEATURE_COLS))
    return spark.createDataFrame(rows, schema)


def test_graph_shape(graph_fixture):
    s = GR.graph_size(graph_fixture).first()
    assert (s.url_nodes, s.domain_nodes, s.tld_nodes) == (20, 2, 1)
    e = GR.graph_edges(graph_fixture)
    assert e.count() == 2 * (20 + 2)


def test_propagation_means(graph_fixture):
    p = {r.page_id: r for r in GR.propagate(graph_fixture, FEATURE_COLS, spread=F.xxhash64("url")).collect()}
    even = sum(1.0 + 0.1 * i for i in range(0, 20, 2)) / 10
    odd = sum(1.0 + 0.1 * i for i in range(1, 20, 2)) / 10
    assert math.isclose(p[0].dom_url_length, even) and math.isclose(p[1].dom_url_length, odd)
    assert math.isclose(p[5].tld_url_length, (even + odd) / 2)


def test_graph_model_scores_sum_to_one(graph_fixture):
    prop = GR.with_suffix_vector(GR.propagate(graph_fixture, FEATURE_COLS, spread=F.xxhash64("url")), "tld",
                                 MD.SUFFIX_BUCKETS)
    cols = MD.graph_feature_cols()
    m = MD.train_graph_model(prop.filter("split = 'train'"), cols, max_iter=20)
    out = MD.export_graph_scores(MD.graph_probs(m, prop, cols)).collect()
    assert len(out) == 20
    for r in out:
        assert math.isclose(sum(r[f"domain_class_{i}_prob"] for i in range(4)), 1.0, abs_tol=1e-9)


def test_cold_start_formula(spark, graph_fixture):
    prof = GR.domain_profile(graph_fixture, ["url_length"])
    glob = GR.global_profile(prof, graph_fixture, ["url_length"])
    q = spark.createDataFrame([(100, "test1.com", 5.0), (101, "new.org", 5.0)],
                              "page_id int, registered_domain string, url_length double")
    out = {r.page_id: r for r in GR.cold_start(q, prof, glob, ["url_length"]).collect()}
    s = sum(1.0 + 0.1 * i for i in range(0, 20, 2))
    assert math.isclose(out[100].cs_url_length, (s + 5.0) / 11) and not out[100].domain_unseen
    assert out[101].domain_unseen


def test_ngram_hash_matches_python(spark):
    import hashlib
    df = spark.createDataFrame([("co.uk",), ("io",), ("x",), ("",)], "t string")
    got = {(r.key, r.bucket): r.weight for r in GR.ngram_hash(df, "t", 37).collect()}

    def ref(t, n=37):
        t = t.strip(".")
        grams = [t[i:i + 2] for i in range(len(t) - 1)] + [t[i:i + 3] for i in range(len(t) - 2)]
        grams = grams or list(t)
        v = {}
        for g in grams:
            b = int(hashlib.md5(g.encode()).hexdigest(), 16) % n
            v[b] = v.get(b, 0) + 1
        return {(t, b): c / sum(v.values()) for b, c in v.items()}
    exp = {}
    for t in ["co.uk", "io", "x"]:
        exp.update(ref(t))
    assert got.keys() == exp.keys()
    for k in exp:
        assert math.isclose(got[k], exp[k])


def test_ngram_vector_equals_long_form(spark):
    df = spark.createDataFrame([("co.uk",), ("io",), ("x",), ("",), (".kawasaki.jp.",)], "t string")
    long = {(r.key, r.bucket): r.weight for r in GR.ngram_hash(df, "t", 16).collect()}
    for r in df.select("t", GR.ngram_hash_vector("t", 16).alias("v")).collect():
        for b, w in enumerate(r.v):
            assert math.isclose(w, long.get((r.t, b), 0.0), abs_tol=1e-12)


def test_the_suffix_vector_hashes_each_gram_once(spark):
    """a step read by the next one many times is computed once; before, each bucket hashed all grams again."""
    df = spark.createDataFrame([("com",), (".co.uk.",), ("x",), ("",), (None,)], "tld string")
    got = {r.tld: r.v for r in df.select("tld", GR.ngram_hash_vector("tld", 4).alias("v")).collect()}
    import hashlib
    for tld, vector in got.items():
        s = (tld or "").strip(".")
        grams = [s[i:i + k] for k in (2, 3) for i in range(len(s) - k + 1)] or list(s)
        place = [int(hashlib.md5(g.encode()).hexdigest(), 16) % 4 for g in grams]
        assert vector == pytest.approx([place.count(b) / len(place) if place else 0.0 for b in range(4)])
    plan = df.select(GR.ngram_hash_vector("tld", 16))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") < 8 and plan.count("regexp_replace(") < 8
