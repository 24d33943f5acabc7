"""Near dedup and components against brute force."""

import random

import numpy as np
import pytest

from tidewatch.llm import near_dedup as N
from tidewatch.llm.components import components

from llm_fixtures import clashing, nothing, sample  # noqa: F401


def shingles(t, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = [shingles(r["text"], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(sets[i]), least.get(find(i)) if sets[i] else r["doc_id"])
                   for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_the_sample(sample, k):
    got = N.near_components(sample, shingle=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(sample.collect(), k)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_near_copies(spark):
    """Drifting copies: neighbours are linked, ends are not, and a bucket holds several components."""
    rng = random.Random(3)
    rows, i = [], 0
    for family in range(4):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(40):
            rows.append((i, " ".join(words)))
            i += 1
            words = list(words)
            words[rng.randrange(60)] = f"w{rng.randrange(500)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = N.near_components(df).collect()
    want = brute(df.collect(), 2)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert len({w[2] for w in want}) > 1


def test_near_dedup_keeps_rows_whole(sample, clashing, nothing):
    out = N.near_dedup(clashing)
    assert out.columns == clashing.columns
    want = {c for _, _, c in brute(sample.collect(), 2) if c is not None}
    ids = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
    assert set(ids) == want
    assert N.near_dedup(nothing).count() == 0 and N.near_components(nothing).count() == 0


def test_one_row_of_a_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "x"), (5, a, "y"), (5, a + " more", "x"), (7, a, "x"), (None, a, "x"), (None, b, "x"),
            (None, b + " more", "x"), (None, b, "y"), (3, c, "x"), (8, "", "x"), (8, None, "x"), (None, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = [(r["doc_id"], (r["text"] or " ")[0]) for r in N.near_dedup(df).collect()]
    assert sorted(out, key=repr) == sorted([(5, "a"), (None, "b"), (3, "c"), (8, " "), (8, " "), (None, " ")], key=repr)


def test_texts_are_fetched_once_and_joined_by_shuffle_at_every_size(sample, monkeypatch):
    plans, own = [], N.staged

    def staged(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return own(df, name)
    monkeypatch.setattr(N, "staged", staged)
    monkeypatch.setattr("tidewatch.llm.components.staged", staged)
    N.near_components(sample).count()
    assert [name for name, _ in plans].count("near-sets") == 1
    joined = [(name, plan) for name, plan in plans if name.startswith(("near-sets", "jumped", "links", "roots")) and "Join" in plan]
    assert {name for name, _ in joined} >= {"near-sets", "jumped0", "links0", "roots0"}
    assert not [name for name, plan in joined if "Broadcast" in plan]


def test_bands_miss_hardly_any_pair_at_the_threshold():
    rng = np.random.default_rng(0)
    mult = N._multipliers(N.PERMUTATIONS)
    missed, estimates = 0, []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 100, np.int64).astype(np.uint64)
        a, b = np.sort(pool[:90]), np.sort(pool[10:])  # 80 of 100 shared
        x, y = N.signature(a, mult), N.signature(b, mult)
        estimates.append((x == y).mean())
        missed += not (N.band_keys(x) == N.band_keys(y)).any()
    assert missed == 0 and abs(np.mean(estimates) - 0.8) < 0.01 and min(estimates) > N.SURELY_LESS


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components_of_links(spark, shape):
    rng = random.Random(1)
    links = {"path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)],
             "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]}[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        if a != b:
            root[find(a)] = find(b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    pairs = {}
    for n in nodes:
        assert pairs.setdefault(find(n), got[n]) == got[n]
    assert len(set(pairs.values())) == len(pairs)
