"""Merkle manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle

from llm_fixtures import SCHEMA, clashing, nothing, sample  # noqa: F401


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(d):
    return H("".join("-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in merkle.FIELDS))


def levels(hs, fanout):
    out = [hs]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(lv, k, fanout):
    out = []
    for level in lv[:-1]:
        r = k // fanout * fanout
        out.append(("".join(level[r:k]), "".join(level[k + 1:r + fanout])))
        k //= fanout
    return out


def brute(docs, fanout=3):
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for j, s in enumerate(names):
        for k, (_, _, h, d) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], k, fanout) + path(top, j, fanout)
            f = h
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and d["text"] is not None:
                f = leaf(d | {"text": d["text"].replace("\n", "")})
            for b, a in steps:
                f = H(b + f + a)
            out.append((d["doc_id"], h, trees[s][-1][0], top[-1][0], H("".join(b + a for b, a in steps)), f, f == top[-1][0]))
    return out


def listed(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_audit_equals_trees_in_plain_python(sample):
    rows = sample.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nend"))).otherwise(F.col("text")))
    got, want = merkle.audit(rows).collect(), brute([r.asDict() for r in rows.collect()])
    assert listed(got) == listed(want)
    assert {True, False} == {r["verified"] for r in got}


@pytest.mark.parametrize("fanout,stride", [(2, 1), (3, 1), (2, 3), (5, 2)])
def test_any_fanout_and_any_distance_of_stored_levels(spark, fanout, stride):
    """Many levels, runs of one, a source with most rows, lone leaves, thirty sources."""
    docs = [(i, f"text {i}", None, "hot" if i % 3 else f"s{i % 30}", i) for i in range(140)] + [(900, "alone", "en", "z", 1)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    m = merkle.build_manifest(df, fanout=fanout, stride=stride)
    p = merkle.proofs(m).collect()
    want = {r[0]: r for r in brute([r.asDict() for r in df.collect()], fanout)}
    assert len(p) == len(docs) and m.root().first()[0] == want[900][3]
    for r in p:
        steps = [(s["before"], s["after"]) for s in r["path"]]
        assert (r["leaf"], r["subroot"], r["root"], H("".join(b + a for b, a in steps))) == want[r["id"]][1:5]
    most = 93  # leaves of the largest source
    stored = [level.count() for level in m.sources.levels]
    assert len(stored) == 1 + sum(most > (fanout ** stride) ** i for i in range(1, 12))  # only every stride-th level


def test_a_changed_row_is_found(spark, sample):
    m = merkle.build_manifest(sample, keep={"changed": F.lit(None).cast("string")})
    p = merkle.proofs(m).withColumn("again", merkle.fold(F.col("leaf"), F.col("path")))
    assert p.filter("again <> root").count() == 0
    p = p.withColumn("again", merkle.fold(merkle.digest(F.concat("leaf", F.lit("x"))), F.col("path")))
    assert p.filter("again = root").count() == 0


def test_odd_tables(spark, nothing, clashing):
    assert merkle.audit(nothing).collect() == []
    assert merkle.build_manifest(nothing).root().collect() == []
    assert listed(merkle.audit(clashing).collect()) == listed(brute([r.asDict() for r in clashing.collect()]))
    one = [(5, "a\nb", None, None, 3)]
    df = spark.createDataFrame(one, SCHEMA)
    assert listed(merkle.audit(df).collect()) == listed(brute([r.asDict() for r in df.collect()]))
    same = spark.createDataFrame([(None, "x", "en", "s", 1)] * 40 + [(1, "", "en", "s", 0), (1, None, "en", "s", 0)], SCHEMA)
    assert listed(merkle.audit(same).collect()) == listed(brute([r.asDict() for r in same.collect()]))
    long = spark.createDataFrame([(2, "é\n" * 2_000_000, "fr", "s", 1), (3, "", "fr", "t", 1)], SCHEMA)
    assert listed(merkle.audit(long).collect()) == listed(brute([r.asDict() for r in long.collect()]))
