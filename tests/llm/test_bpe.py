"""Encoding with shared chunks against an untouched tokenizer, and decoding."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, chunks

from llm_fixtures import SF001, clashing, nothing, sample  # noqa: F401

PATH = bpe.default_path()
PARTS = [" ", "  ", "\n", "\n\n", "'s", "'", "'ll", "l", "s", "a", "Hello", "the", "12", "9", "!", "...", "é", "ß", "日本語", "。", "、",
         "\xa0", "　", "​", "᠎", "😀", "👩‍👩‍👧", "x" * 40, "\t ", "٣", "½", "\x1c", "\x85", "\x00", "İ", "<|endoftext|>", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_joins_equal_the_whole_text(library):
    """Random texts cut anywhere, also within words, runs of white space and contractions."""
    rng, v = random.Random(5), bpe.vocabulary(PATH)
    for _ in range(4000):
        s = "".join(rng.choice(PARTS[:-2]) for _ in range(rng.randint(1, 60)))
        at = [0, *sorted(rng.sample(range(1, len(s) + 1), min(len(s), rng.randint(0, 4)))), len(s)]
        got = bpe.assemble(v, [(v.ids(s[a:b]), a == 0 and i == 0) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a])
        assert got.tolist() == ids_of(library, s)


def test_every_character_has_the_library_s_ids(library):
    v = bpe.vocabulary(PATH)
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)} .{chr(c)}  {chr(c)}{chr(c)}x" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for i in range(0, len(texts), 20000):
        want = library.encode_batch(texts[i:i + 20000], add_special_tokens=False)
        assert v.encoder.encode_ordinary_batch(texts[i:i + 20000], num_threads=4) == [w.ids for w in want]


def test_chunks_depend_on_their_text_alone(monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ü\n") for _ in range(n))
    passage = text(6000)
    texts = [passage, text(777) + passage, text(50) + passage + text(90), "", "a" * 20000, "x", text(3000)]
    edges = list(chunks.chunk_edges(texts))
    pieces = [[t[a:b] for a, b in zip(e, e[1:])] for t, e in zip(texts, edges)]
    assert ["".join(p) for p in pieces] == texts
    assert all(chunks.LEAST <= len(x) <= chunks.MOST for p in pieces for x in p[:-1])
    for p in pieces[1:3]:
        assert len(set(p) & set(pieces[0])) >= len(pieces[0]) - 3
    monkeypatch.setattr(chunks, "GROUP", 1000)  # long texts hashed piece by piece
    assert list(chunks.chunk_edges(texts)) == edges


def held(rows, texts, library):
    """Every row's ids and decoded text equal the library's, as multisets."""
    want = sorted((str(k), np.array(ids_of(library, t), "<u4").tobytes(), library.decode(ids_of(library, t), skip_special_tokens=False))
                  for k, t in texts)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in rows) == want


def shared(spark, sample):
    rng = random.Random(2)
    passage = "".join(rng.choice(PARTS) for _ in range(900))
    rows = [(1000 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80))) + passage * (i % 3)
             + rng.choice(["", "ll", "'", "<|endoftext|>", passage[:1500]])) for i in range(30)]
    return sample.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)


@pytest.mark.parametrize("bits", [26, 18])
def test_encode_and_decode(spark, sample, library, bits, monkeypatch):
    df = shared(spark, sample)
    rows = bpe.decode(bpe.encode(df, bits=bits, decoded="back")).collect()
    assert all(r["back"] == r["decoded"] for r in rows)
    held(rows, [tuple(r) for r in df.select("doc_id", "text").collect()], library)


def test_chunks_in_very_many_texts_are_handed_out_in_copies(spark, library):
    rng = random.Random(4)
    line = "".join(rng.choice(PARTS) for _ in range(700))
    df = spark.createDataFrame([(i, line + f" {i}") for i in range(4000)], "doc_id long, text string").repartition(4)
    rows = bpe.decode(bpe.encode(df)).collect()
    want = {i: hashlib.sha256(np.array(ids_of(library, line + f" {i}"), "<u4").tobytes()).digest() for i in range(0, 4000, 97)}
    assert len(rows) == 4000 and all(r["decoded"] == line + f" {r['doc_id']}" for r in rows)
    assert all(hashlib.sha256(r["ids"]).digest() == want[r["doc_id"]] for r in rows if r["doc_id"] in want)


def test_odd_tables(spark, nothing, clashing, library):
    assert bpe.decode(bpe.encode(nothing)).collect() == []
    more = clashing.withColumns({c: F.lit("x") for c in ("key", "no", "ref", "chunk", "first", "own", "one", "parts", "c0")})
    out = bpe.encode(more)
    assert out.columns == [*more.columns, "ids"]
    assert out.filter("key = 'x' AND no = 'x' AND ref = 'x' AND one = 'x' AND c0 = 'x'").count() == more.count()
    held(bpe.decode(out).collect(), [tuple(r) for r in more.select("doc_id", "text").collect()], library)
    twice = "word and 42 " * 30_000
    long = spark.createDataFrame([(1, twice), (2, "日本語" * 40_000), (None, twice), (1, None), (1, "")], "doc_id long, text string")
    held(bpe.decode(bpe.encode(long)).collect(), [tuple(r) for r in long.collect()], library)


def test_decoding_of_any_ids(spark, library):
    lists = [[50256, 220, 50256], [187, 98, 40], list(range(200, 260)), [], [99, 60000, 12]]
    df = spark.createDataFrame([(bytes(np.array(x, "<u4").tobytes()),) for x in lists] + [(None,)], "ids binary")
    got = [r["decoded"] for r in bpe.decode(df).collect()]
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists] + [None]


def test_the_query_equals_the_library(spark, library):
    from tidewatch.llm.queries import op12_bpe_reuse
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op12_bpe_reuse(spark, SF001).collect()))
    want = []
    for k, t in docs:
        ids = ids_of(library, t)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
