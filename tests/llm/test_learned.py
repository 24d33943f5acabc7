"""Language ID, toxicity and nearest neighbours: held-out accuracy, recall, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ann, language_id as L, toxicity as T
from tidewatch.llm.common import documents

from llm_fixtures import SF01, clashing, nothing, sample  # noqa: F401


def test_held_out_fold(spark):
    got = [r[0] for r in spark.range(50).select(L.held_out(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)]


def test_language_held_out_accuracy(spark):
    docs = documents(spark, SF01)
    out = L.identify(docs).withColumn("held", L.held_out("doc_id")).filter("held").select("lang", "lang_pred", "score").collect()
    assert len(out) > 250
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.96
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd_rows(spark, sample, clashing, nothing):
    out = {r["doc_id"]: r for r in L.identify(clashing).collect()}
    for i in (90, 91, 93):
        assert out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["score"] == 0
    assert {r["lang_pred"] for r in out.values()} <= {"en", "de", "und"}
    assert L.identify(clashing).columns[:len(clashing.columns)] == clashing.columns
    assert L.identify(nothing).count() == 0
    blind = L.identify(sample.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in blind] == ["und"]


def test_numerals_are_no_letters(spark):
    docs = documents(spark, SF01)
    odd = [(-1, "½ ² ③ Ⅷ 12 _ ٣"), (-2, "... 𝟘 ⅔"), (-3, "the ½ of the house and the garden Ⅷ")]
    out = {r["doc_id"]: r for r in L.classify(spark.createDataFrame(odd, "doc_id long, text string"), L.learn(docs)).collect()}
    assert out[-1]["lang_pred"] == out[-2]["lang_pred"] == "und" and out[-3]["lang_pred"] == "en"
    assert L.normalise("a½b Ⅷ c") == b"a b c"


def test_language_does_not_read_the_label_of_a_scored_row(spark):
    docs = documents(spark, SF01)
    model = L.learn(docs)
    a = L.classify(docs, model).select("doc_id", "lang_pred").collect()
    b = L.classify(docs.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred").collect()
    assert sorted(a) == sorted(b)


def toxic_table(spark, n=600):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["zork", "fleem", "quux"]
    docs, labels = [], []
    for i in range(n):
        t = [words[j] for j in rng.integers(0, 400, rng.integers(20, 90))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.integers(1, 5) * toxic):
            t[rng.integers(0, len(t))] = bad[rng.integers(0, 3)]
        docs.append((i, " ".join(t).capitalize() + "."))
        labels.append((i, 0, toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_held_out_and_offsets(spark):
    docs, labels = toxic_table(spark)
    out = T.score(docs, T.learn(docs, labels)).join(labels, "doc_id").filter(L.held_out("doc_id")).collect()
    pred = [r["score"] >= T.THRESHOLD for r in out]
    truth = [any(w in r["text"].lower() for w in ("zork", "fleem", "quux")) for r in out]
    assert np.mean(np.array(pred) == np.array(truth)) > 0.98
    for r in out:
        for s in r["spans"]:
            assert set(r["text"][s.start:s.end].lower().split()) <= {"zork", "fleem", "quux"}
        if any(w in r["text"].lower() for w in ("zork", "fleem")) and r["score"] >= T.THRESHOLD:
            assert r["spans"]


def test_toxic_offsets_where_lower_case_is_longer(spark):
    docs, labels = toxic_table(spark)
    model = T.learn(docs, labels)
    texts = ["İstanbul is fine. zork fleem here", "aİb cİd eİf ZORK fleem tail", "ΣΑΣ zork fleem", "½ zork fleem İ"]
    for r in T.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect():
        found = [w for s in r["spans"] for w in r["text"][s.start:s.end].lower().split()]
        assert found == ["zork", "fleem"], (r["text"], found)


def test_toxicity_odd_rows(spark, sample, clashing, nothing):
    docs, labels = toxic_table(spark, 300)
    model = T.learn(docs, labels)
    out = T.score(clashing, model)
    assert out.columns == clashing.columns + ["score", "spans"]
    assert all(0 <= r["score"] <= 1 and r["spans"] == [] for r in out.filter("doc_id in (90, 91)").collect())
    assert T.score(nothing, model).count() == 0
    one = labels.filter("toxic = 0")
    assert T.learn(docs, one) is None
    assert T.score(docs, None).filter("score <> 0").count() == 0
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert T.learn(docs, twice) is not None


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    c = T.Chain(4)
    c.emit, c.bias, c.move = rng.normal(size=(3, 4)), np.array([-0.3]), rng.normal(size=(2, 2))
    rows = [[1, 2, 0, 3], [2], [0, 0, 1]]
    p, pair = c.marginals(T.padded(rows))
    want_pair = np.zeros((2, 2))
    for i, r in enumerate(rows):
        phi = c.potentials(np.array([r]))[0]
        total, mass = 0.0, np.zeros(len(r))
        local = np.zeros((2, 2))
        for bits in range(1 << len(r)):
            y = [bits >> t & 1 for t in range(len(r))]
            w = np.exp(sum(phi[t] * y[t] for t in range(len(r))) + sum(c.move[y[t], y[t + 1]] for t in range(len(r) - 1)))
            total += w
            mass += w * np.array(y)
            for t in range(len(r) - 1):
                local[y[t], y[t + 1]] += w
        want_pair += local / total
        assert np.allclose(p[i, :len(r)], mass / total)
    assert np.allclose(pair, want_pair)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 24)) + rng.normal(size=24)
    v[100:130] = v[100]
    v[200] *= 1e-3
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [None] + [1.0] * 23), (None, [1.0] * 24),
             (1080, [float("inf")] + [1.0] * 23)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), v


def test_nearest_neighbours_against_brute_force(vectors, monkeypatch):
    df, v = vectors
    monkeypatch.setattr(ann, "BLOCK", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        order = [i for i in sorted(range(900), key=lambda i: (-round(s[i], 12), i)) if i != q][:20]
        found.sort()
        hits += len(set(order) & {f[1] for f in found})
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]])
        assert [f[0] for f in found] == list(range(1, 21))
    assert hits / (20 * len(got)) >= 0.99


def test_blocks_meet_in_tasks_bounded_and_without_copies(vectors, spark, monkeypatch):
    """No pair of blocks is broadcast or shuffled, and tasks don't grow as query blocks times candidate blocks."""
    df, v = vectors
    monkeypatch.setattr(ann, "BLOCK", 10)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 1)
    found = ann.search(df, F.col("vec_id") % 20 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and plan.count("Exchange") == 1, plan
    sc = spark.sparkContext
    sc.setJobGroup("ann-meet", "blocks meet")
    try:
        rows = found.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(x) for j in tracker.getJobIdsForGroup("ann-meet") for x in tracker.getJobInfo(j).stageIds]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stages and max(x.numTasks for x in stages if x) <= (ann.TASKS + 1) * partitions
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 900, 20):
        s = v @ v[q]
        order = [i for i in sorted(range(900), key=lambda i: (-round(s[i], 12), i)) if i != q][:20]
        assert [x for _, x in sorted(got.pop(q))] == order
    assert not got


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_products_taken_at_once_or_picked_out_agree(monkeypatch, scale):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(600, 24)) * scale
    v[300:] = v[rng.integers(0, 300, 300)]  # copies: ties go to the smaller id
    rows, ids = np.arange(600), rng.permutation(600)
    centre, turn = v.mean(axis=0), ann.rotation(24)
    code = ann.encode(v, centre, turn)
    found = []
    for dense in (0, 10**9):
        monkeypatch.setattr(ann, "DENSE", dense)
        monkeypatch.setattr(ann, "SLICE", 100)
        found.append(ann.nearest(rows[:40], v[:40], rows, ids, v, code, centre, turn))
    assert all(np.array_equal(a, b) for a, b in zip(*found))
    at, cid, score = found[0]
    for q in range(40):
        s = ann.exact(v[q][None, :], v)
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], ids[i]))[:20]
        assert list(cid[at == q]) == list(ids[order]) and list(score[at == q]) == list(s[order])


def test_best_of_each_query_in_order():
    at, cid, score = ann.first_of_each(np.array([1, 0, 1, 1, 3]), np.array([9, 4, 7, 2, 5]), np.array([1.0, 2.0, 1.0, 3.0, 0.0]), 2)
    assert at.tolist() == [0, 1, 1, 3] and cid.tolist() == [4, 2, 7, 5] and score.tolist() == [2.0, 3.0, 1.0, 0.0]
    assert all(len(x) == 0 for x in ann.first_of_each(np.empty(0, int), np.empty(0, int), np.empty(0), 2))


def test_few_vectors_and_none(vectors, spark):
    df, _ = vectors
    few = df.filter("vec_id in (0, 1, 2, 1000)")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2
    assert ann.search(df.filter("vec_id >= 1000"), F.col("vec_id") == 1000).count() == 0
    assert ann.search(few, F.col("vec_id") > 5000).count() == 0


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 8))
    ids = [0, 0, 0, *range(3, 40)]
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in zip(ids, v)],
                               "vec_id long, embedding array<double>, v string").withColumn("block", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(df, F.col("vec_id") == 0).collect()]
    want = []
    for q in range(3):
        best = sorted((-(v[q] @ v[c]), ids[c]) for c in range(40) if c != q)[:20]
        want += [(0, i + 1, c, round(-s, 9)) for i, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("dim", [3, 8, 64, 100])
def test_estimates_are_bit_counts_of_rounded_queries(dim):
    """The packed form equals the plain product of the signs with the rounded query."""
    rng = np.random.default_rng(dim)
    v, q = rng.normal(size=(70, dim)), rng.normal(size=(9, dim))
    centre, turn = v.mean(axis=0), ann.rotation(dim)
    bits, length, fit = ann.encode(v, centre, turn)
    about, width = ann.estimate(bits, length, fit, q, centre, turn, bound=0.0)
    signs = np.sign((v - centre) @ turn)
    t = q @ turn
    low, top = t.min(axis=1, keepdims=True), t.max(axis=1, keepdims=True)
    step = (top - low) / (2 ** ann.QUERY_BITS - 1)
    rounded = low + step * np.rint((t - low) / step)
    scale = length / fit / np.sqrt(dim)
    assert np.allclose(about, (q @ centre)[:, None] + rounded @ signs.T * scale)
    plain = (q @ centre)[:, None] + t @ signs.T * scale  # without rounding: within the width
    assert (np.abs(about - plain) <= width).all()


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    v, q = rng.normal(size=(2000, 64)), rng.normal(size=(50, 64))
    centre, turn = v.mean(axis=0), ann.rotation(64)
    about, width = ann.estimate(*ann.encode(v, centre, turn), q, centre, turn)
    assert (np.abs(about - q @ v.T) <= width).mean() > 0.999
