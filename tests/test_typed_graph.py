"""Typed message passing and neighbourhoods against loops in plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.operators import typed_graph as T

DIM = {"url": 3, "domain": 2, "tld": 1}
TYPES = [("url_domain", "url", "domain"), ("domain_tld", "domain", "tld"), ("rev_url_domain", "domain", "url"), ("rev_domain_tld", "tld", "domain")]


def graph(spark):
    rng = random.Random(3)
    rows = [(i, "hot.com" if i % 2 else f"d{i % 7}.{'net' if i % 3 else 'org'}", None) for i in range(60)]
    rows = [(i, d, d.split(".")[1]) for i, d, _ in rows] + [(60, None, None)]
    df = spark.createDataFrame(rows, "page_id long, registered_domain string, tld string")
    nodes = [("url", str(i), [rng.random() for _ in range(3)]) for i, *_ in rows]
    nodes += [("domain", d, [rng.random() for _ in range(2)]) for d in {d for _, d, _ in rows if d} | {"alone.com"}]
    nodes += [("tld", t, [rng.random()]) for t in {t for *_, t in rows if t}]
    return df, nodes


def weights():
    rng = random.Random(5)
    m = lambda n: [[rng.uniform(-1, 1) for _ in range(n)] for _ in range(3)]
    return [(e, d, m(DIM[s]), m(DIM[d]), [rng.uniform(-1, 1) for _ in range(3)]) for e, s, d in TYPES]


def test_one_round_equals_loops(spark):
    df, nodes = graph(spark)
    w = weights()
    edges = T.typed_edges(df)
    got = T.typed_layer(spark.createDataFrame(nodes, "node_type string, node string, x array<double>"), edges, spark.createDataFrame(
        w, "edge_type string, dst_type string, w_mean array<array<double>>, w_self array<array<double>>, bias array<double>"))
    x = {f"{t}:{n}": v for t, n, v in nodes}
    into = defaultdict(list)
    for e, s, d in edges.collect():
        into[e, d].append(x[s])
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    rows = {f"{r['node_type']}:{r['node']}": r["x"] for r in got.collect()}
    assert rows.keys() == x.keys()
    for t, n, v in nodes:
        convs = []
        for e, dt, wm, ws, b in w:
            if dt == t:
                near = into[e, f"{t}:{n}"]
                mean = [sum(c) / len(near) for c in zip(*near)] if near else []
                convs.append([b[i] + dot(wm[i], mean) + dot(ws[i], v) for i in range(3)])
        want = [max(sum(c) / len(convs), 0.0) for c in zip(*convs)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(rows[f"{t}:{n}"], want))


def test_neighbourhoods_of_any_depth(spark):
    df, _ = graph(spark)
    edges = T.typed_edges(df)
    near = defaultdict(set)
    for _, s, d in edges.collect():
        near[s].add(d)
    for depth in (0, 1, 2, 3, None):
        want, front, k = {"url:0": 0, "url:60": 0, "url:999": 0}, {"url:0", "url:60", "url:999"}, 0
        while front and (depth is None or k < depth):
            k += 1
            front = {d for s in front for d in near[s]} - want.keys()
            want |= dict.fromkeys(front, k)
        seeds = spark.createDataFrame([("url:0",), ("url:0",), ("url:60",), ("url:999",), (None,)], "node string")
        got = T.neighbourhood(edges, seeds, depth).collect()
        assert {r["node"]: r["distance"] for r in got} == want and len(got) == len(want)


def test_a_chain_ends_where_nothing_is_new_and_no_seed_gives_nothing(spark):
    chain = spark.createDataFrame([("e", str(i), str(i + 1)) for i in range(6)] + [("e", "6", "0")], "edge_type string, src string, dst string")
    start = spark.createDataFrame([("2",)], "node string")
    assert T.neighbourhood(chain, start).agg(F.max("distance")).first()[0] == 6
    assert T.neighbourhood(chain, start.limit(0)).count() == 0
