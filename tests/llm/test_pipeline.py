"""The corpus pipeline: each stage on its predecessor's rows, against brute force; registered queries."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from tidewatch.llm import language_id
from tidewatch.llm.mixing import mix

from llm_fixtures import SF001  # noqa: F401
from test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(P.staged(f(spark, out[-1], SF001), "test-stage"))
    return out


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_stage_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = (Counter(r["doc_id"] for r in s.collect()) for s in stages[:2])
    assert after <= before and sum(after.values()) > 0.97 * sum(before.values())
    model = language_id.learn(stages[0])
    rejected = {r["doc_id"] for r in language_id.classify(stages[0], model).filter("rejected").collect()}
    assert set(before) - set(after) == rejected


def test_exact_stage(stages):
    least = {}
    for r in stages[1].collect():
        least[lowered(r["text"])] = min(least.get(lowered(r["text"]), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(least.values())


def test_near_stage(stages):
    want = sorted({c for _, _, c in brute(stages[2].collect(), 5)})
    assert sorted(r["doc_id"] for r in stages[3].collect()) == want


def test_mixing_stage(stages):
    want = Counter()
    for r in mix(stages[3]).collect():
        want[r["doc_id"]] += sum(d.words * 2 >= r["size"] for d in r["draws"])
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +want


def test_packing_stage(stages):
    seqs = defaultdict(int)
    rows = stages[5].collect()
    for r in rows:
        seqs[r["sequence_id"]] += r["length"]
    assert max(seqs.values()) <= 1024
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in stages[4].collect())


def test_run_is_the_chain_of_stages(spark, stages):
    pick = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(P.run(spark, SF001).select(*pick).collect()) == sorted(stages[5].select(*pick).collect())


@pytest.mark.parametrize("name", ["op1_pii", "op2_exact_dedup", "op3_suffix_array_dedup", "op7_mixing", "op8_ann",
                                  "op9_minhash_near_dedup"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    norm = lambda v: round(v, 7) if isinstance(v, float) else v
    at = [rel.columns.index(c) for c in df.columns]
    a = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)
    assert a == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_every_operator_is_registered(spark):
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_queries_without_sql_return_every_row(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    n = docs.count()
    for name in ("op5_token_files", "op6_toxicity", "op10_language_id"):
        out = E.queries()[name](spark, SF001)
        assert out.count() == n and out.select("doc_id").distinct().count() == n
    packed = E.queries()["op4_packing"](spark, SF001)
    assert packed.filter("piece = 0").count() == n
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
