"""Repeated spans, packing and token files: brute force, bounds and exact round trips."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import id_codec, packing, repeated_spans as R, token_files, word_ids
from tidewatch.llm.bpe import default_path, vocabulary
from tidewatch.llm.suffix_array import suffix_array

from llm_fixtures import clashing, nothing, sample  # noqa: F401


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 60))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def cut_brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out.append((len(d), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,classes", [(200, 32, 2000), (40, 16, 2000), (40, 16, 3), (40, 16, 1)])
def test_repeated_spans(sample, length, gram, classes, monkeypatch):
    """Also with anchors divided by a longer one, and with windows counted by digest."""
    monkeypatch.setattr(R, "CLASSES", classes)
    rows = R.repeated_spans(sample, length=length, gram=gram, long_gram=length - 12).collect()
    want = cut_brute([r["text"] for r in rows], length)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == want
    assert any(w[1] and w[1] < w[0] for w in want)


def test_repeated_spans_of_runs_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 6, n))
    passage = text(450)
    rows = ["a" * 700, "ab" * 400, text(900) + passage + text(10), passage[100:400] + text(300), passage[:199], text(50) + "ü" * 150,
            "x" + passage[200:], text(3000) + passage + text(2000) + passage]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = R.repeated_spans(df).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == cut_brute(rows, 200)


def test_repeated_spans_columns_and_empty(clashing, nothing):
    assert R.repeated_spans(clashing).columns[:len(clashing.columns)] == clashing.columns
    assert R.repeated_spans(nothing).count() == 0


def test_joined_texts_stay_within_the_bits_of_a_position():
    rng = np.random.default_rng(6)
    long = rng.integers(97, 123, 600_000, np.uint8).tobytes()
    texts = [long[:524_280], long]
    windows, rows = 0, []
    for b, valid, text, offset in R._groups(texts, 200):
        assert len(b) < 1 << 20
        starts, count, anchor = R.segments(b, valid)
        windows += int(count.sum())
        rows += zip(text[starts].tolist(), (starts + offset[starts]).tolist(), count.tolist(), anchor.tolist())
    assert windows == sum(len(t) - 199 for t in texts)
    at = [{s + j: a for i, s, n, a in rows if i == k for j in range(n)} for k in (0, 1)]
    assert all(at[1][s] == a for s, a in at[0].items())  # equal windows, equal anchors


def bpe(name):
    """The library as it is."""
    return Tokenizer.from_file(public_tokenizers.path(name))


ODD = ["", None, "The THE the,the. the! don't I'LL", "ΣΑΣ σας İstanbul ﬁn ½ Ⅷ", "áb é, x y z\x1cq\r\n\t.,!|",
       "<|endoftext|> <|startoftext|>x", "1234 5,6.7!8", "foo),bar ).,! (a.-b", "😀😀 👩‍👩‍👧 ...!!!", "x" * 5000, "word, " * 300]


def test_ids_are_those_of_the_tokenizers_library(sample):
    texts = ODD + [r["text"] for r in sample.collect()]
    for name, own in (("byte_bpe_50k.json", lambda ts: [packing.token_ids(t, vocabulary(default_path())) for t in ts]),
                      ("word_bpe_49k.json", token_files.tokenise)):
        t = bpe(name)
        for text, got in zip(texts, own(texts)):
            assert got.tolist() == t.encode(text or "", add_special_tokens=False).ids + [2], (name, text)


def test_capitals_that_compose_only_in_lower_case_keep_the_ids_of_the_library():
    nfc = lambda s: unicodedata.normalize("NFC", s)
    pairs = [chr(c) + chr(m) for c in range(0x41, 0x250) for m in range(0x300, 0x370)
             if nfc(chr(c).lower() + chr(m)) != nfc(chr(c) + chr(m)).lower()]
    assert len(pairs) > 40 and "J\u030c" in pairs
    t = bpe("word_bpe_49k.json")
    texts = pairs + [f"A {p}an, THE.{p}. I{p}\nX" for p in pairs] + ["ΣΑΣ. THE. ΣΑΣ, J\u030c"]
    for text, got in zip(texts, token_files.tokenise(texts)):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids + [2], text


def test_every_kind_of_neighbour_gets_the_ids_of_the_library():
    rng = random.Random(2)
    signs = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x250, 0x30000, 97) if not 0xD800 <= c < 0xE000]
    texts = [f"A{c}b {c}{c}9 x'S{c}'ll DON'T{c}" for c in signs] + ["".join(rng.choices(signs[:0x250], k=30)) for _ in range(2000)]
    texts += ["a <|endoftext|> b<|startoftext|>C<|ENDOFTEXT|><|end <|endoftext|>", "word " * 30_000 + "ж end"]
    t = bpe("word_bpe_49k.json")
    for text, got in zip(texts, token_files.tokenise(texts)):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids + [2], ascii(text[:200])


def test_known_stretches_survive_full_caches(monkeypatch):
    """Also where all stretches share few places of the table, and with more of them than it keeps."""
    monkeypatch.setattr(word_ids, "CACHE", 50)
    monkeypatch.setattr(word_ids, "SLOT_BITS", 3)
    own = word_ids.WordIds(public_tokenizers.path("word_bpe_49k.json"), 2)
    rng, t = random.Random(3), bpe("word_bpe_49k.json")
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcé'.9", k=rng.choice([1, 3, 9, 40]))) for _ in range(30)) for _ in range(4)]
        for text, got in zip(texts, own.encode(texts)):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids + [2], text


def test_packing(sample):
    rows = packing.pack(sample, with_ids=True, group=20).collect()
    enc, by_text = bpe("byte_bpe_50k.json"), {}
    docs = defaultdict(list)
    for r in sample.collect():
        ids = enc.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        docs[r["doc_id"]].append(np.array(ids, "<u4"))
    pieces = defaultdict(Counter)
    for r in rows:
        pieces[r["doc_id"]][(r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc, texts in docs.items():
        want = Counter()
        for ids in texts:
            at = 0
            for i, n in enumerate(packing.cut(len(ids))):
                want[(i, at, n, zlib.crc32(ids[at:at + n].tobytes()))] += 1
                at += n
        assert pieces[doc] == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_packing_reaches_its_bound_by_exchange(spark):
    rng = np.random.default_rng(2)
    text = [" ".join(["the"] * int(n)) for n in rng.integers(20, 900, 1500)]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    used, bound = packing.certificate(packing.pack(df, group=500))
    assert bound <= used <= 1.01 * bound
    used, bound = packing.certificate(packing.pack(df))
    assert bound <= used <= bound + 1


def test_packing_of_nothing(nothing, spark):
    assert packing.pack(nothing).count() == 0
    df = spark.createDataFrame([(1, "the " * 5000, "x")], "doc_id long, text string, sequence_id string")
    assert sorted(r["length"] for r in packing.pack(df).collect())[1:] == [1024] * 4


def test_lower_bound_is_one(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        items = rng.integers(1, 31, rng.integers(1, 9))
        counts = np.bincount(items, minlength=31)

        def best(rest, bins):
            if not rest:
                return len(bins)
            n, tried, low = rest[0], set(), 99
            for i, b in enumerate(bins):
                if b + n <= 30 and b not in tried:
                    tried.add(b)
                    low = min(low, best(rest[1:], bins[:i] + [b + n] + bins[i + 1:]))
            return min(low, best(rest[1:], bins + [n]))
        exact = best(sorted(items.tolist(), reverse=True), [])
        _, _, loads = packing.best_fit_decreasing(items, 30)
        assert packing.lower_bound(counts, 30) <= exact <= len(loads) and loads.max() <= 30


def test_codec_round_trips():
    rng = np.random.default_rng(1)
    for n, steps in ((0, 16), (1, 16), (5, 4), (1000, 64), (30000, 700), (20000, 9000)):
        for ids in (rng.integers(0, 1 << 16, n), np.minimum(rng.zipf(1.3, n), 65535), np.zeros(n)):
            ids = ids.astype(np.uint16)
            assert (id_codec.decode(id_codec.encode(ids, steps), n, steps) == ids).all()


def test_codec_needs_less_than_order_0_and_zlib():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").slice(0, 1500).to_pylist()
    ids = np.concatenate(token_files.tokenise(docs))
    n = np.bincount(ids)[np.unique(ids)]
    order_0 = -(n * np.log2(n / len(ids))).sum() / 8
    size = sum(map(len, id_codec.encode(ids, id_codec.block_length(len(ids)))))
    assert size < 0.85 * order_0 and size < 0.85 * len(zlib.compress(ids.tobytes(), 6))


def test_blocks_are_decoded_alone_and_in_any_company():
    ids = np.minimum(np.random.default_rng(4).zipf(1.4, 4000), 900).astype(np.uint16)
    model, *blocks = id_codec.encode(ids, 500)
    assert len(blocks) == 8
    for i, b in enumerate(blocks):
        assert (id_codec.decode([model, b], 500, 500) == ids[500 * i:500 * i + 500]).all()
    assert (id_codec.decode([model, blocks[5], blocks[2]], 1000, 500) == np.concatenate([ids[2500:3000], ids[1000:1500]])).all()


def test_codec_gains_on_repeating_ids_and_files_are_checked():
    ids = np.tile(np.arange(50, dtype="<u2"), 200)
    content = token_files.write_file([3, None], [ids, ids[:7]])
    assert len(content) < len(ids)
    keys, back = token_files.read_file(content)
    assert keys == [3, None] and (back[0] == ids).all() and (back[1] == ids[:7]).all()
    for at in (len(content) - 9, 60):
        damaged = bytearray(content)
        damaged[at] ^= 4
        with pytest.raises((ValueError, zlib.error)):
            token_files.read_file(bytes(damaged))


def test_token_files_in_document_order(sample, nothing, clashing):
    enc = bpe("word_bpe_49k.json")
    docs = sorted(((r["doc_id"], r["text"] or "") for r in sample.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    want, at = [], 0
    for doc, text in docs:
        ids = np.array(enc.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    files = token_files.write_token_files(clashing, file_ids=3000)
    got = sorted((tuple(r) for r in token_files.token_index(files).collect()), key=lambda r: r[1])
    assert got == want and files.count() > 3
    assert token_files.token_index(token_files.write_token_files(nothing)).count() == 0
