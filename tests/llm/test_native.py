"""PII, exact dedup and mixing against brute force in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing, pii
from tidewatch.llm.exact_dedup import exact_dedup, mark_copies
from tidewatch.llm.mixing import hypergeometric, mix, mixed_rows, permuted, sharded_rows, split_quotas

from llm_fixtures import clashing, nothing, sample  # noqa: F401

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in s) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PII_TEXTS = [
    "mail a.b+c@d-e.org, x@y z@w.co.uk.", "a@b.cd+x@y.z", "@@a@b@c.d.e", "1.2.3.4.5.6.7.8 and 256.1.1.1 0001.02.3.255",
    "card 4539 1488 0343 6467 and 4539148803436468", "4539-1488-0343-6467-4539-1488-0343-6467", "9" * 40 + " 1 2 3",
    "+1 (606) 555-7814 and +12 and +1(((9", "é+44 20 7946 0958ü 😀 +4420794609", "", "no data at all",
    "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013001", "ssn 078-05-1120, 000-12-3456, 5078-05-1120",
    "1 2 " * 30000, "a" * 50000 + "@", "7" * 60000, ".".join(["1"] * 20000)]


def test_pii_base_spans_match_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)) + [(99, None)], "i int, text string")
    got = {r["i"]: r for r in pii.find_pii(df).select("i", pii.digest(F.concat(
        *[F.col(f"pii.{k.name}") for k in pii.KINDS if k.base])).alias("s"), "pii").collect()}
    for i, t in enumerate(PII_TEXTS):
        assert got[i]["s"] == base_spans(t), t[:80]
    assert got[99]["s"] == ""
    assert [(s.start, s.end) for s in got[11]["pii"]["iban"]] == [(5, 32)]
    assert [(s.start, s.end) for s in got[12]["pii"]["ssn"]] == [(4, 15)]


def test_pii_keeps_other_columns_and_empty_tables(spark, clashing, nothing):
    out = pii.find_pii(clashing)
    assert out.columns == clashing.columns + ["pii"] and out.count() == clashing.count()
    assert pii.find_pii(nothing).count() == 0


def groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")].append(r["doc_id"])
    return by


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup(spark, sample, keep, hot):
    df = sample
    if hot:  # one text with more copies than a partition's share
        more = spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.lit("Same TEXT").alias("text"),
                                              F.lit("en").alias("lang"), F.lit("s0").alias("source"), F.lit(1).cast("long").alias("n_chars"))
        df = sample.unionByName(more)
    rows = df.collect()
    want = groups(rows)
    got = mark_copies(df, keep=keep).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        n = re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")
        ids = [i for i in want[n] if i is not None]
        pick = max if keep == "largest" else min
        assert r["keep_id"] == (pick(ids) if ids else None) and r["group_size"] == len(want[n])
        assert r["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()
        kept[n] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert set(kept) == set(want) and set(kept.values()) == {1}


def test_exact_dedup_rows_columns_and_empty(sample, clashing, nothing):
    out = exact_dedup(clashing)
    assert out.columns == clashing.columns
    assert out.count() == len(groups(sample.collect()))
    assert exact_dedup(nothing).count() == 0 and mark_copies(nothing).count() == 0


def water(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_targets_and_taken(sample):
    rows = sample.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want, taken = water(sizes), defaultdict(int)
    got = mix(sample).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(d.words for d in r["draws"])
        assert all(0 <= d.shard < 2 ** mixing.LEVELS for d in r["draws"])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(want[s] + 0.5) for s in sizes)


def test_mix_agrees_over_partitionings_and_takes_odd_tables(sample, clashing, nothing):
    pick = ["doc_id", "text", "source", "taken"]
    a = sorted(map(repr, mix(sample.repartition(1)).select(*pick).collect()))
    b = sorted(map(repr, mix(sample.repartition(7, "n_chars")).select(*pick).collect()))
    assert a == b
    assert mix(clashing).columns[:len(clashing.columns)] == clashing.columns
    assert mix(nothing).count() == 0 and mixed_rows(nothing).count() == 0
    assert mix(sample.filter("doc_id in (91, 92)")).filter("taken > 0 or target > 0").count() == 0


def test_mixed_rows_repeat_whole_documents(sample):
    want = sum(sum(d.words * 2 >= r["size"] for d in r["draws"]) for r in mix(sample).collect())
    out = mixed_rows(sample)
    assert out.count() == want and out.columns == sample.columns


def plain_permutation(n, key):
    """The swap-or-not order of 0 .. n - 1, number by number."""
    out = []
    for x in range(n):
        for k, a, c in mixing.round_keys():
            y = (k + key - x) % n
            if (max(x, y) * a + c + key) % mixing.PRIME * 2 > mixing.PRIME:
                x = y
        out.append(x)
    return out


def test_permuted_is_a_keyed_bijection(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).orderBy("id").select(
            permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long"))).collect()]
        assert sorted(got) == list(range(n)) and got == plain_permutation(n, 12345)
    assert len({(b - a) % 1000 for a, b in zip(got, got[1:])}) > 500  # no rotation, no stride
    other = plain_permutation(1000, 54321)
    assert sum(a == b for a, b in zip(got, other)) < 20


def test_blocks_of_a_shard_are_drawn_as_the_tree_says(spark, sample):
    """Block by block: the tree's quotas are laid over the permuted numbers of each source."""
    rows = mix(sample, block_words=64).collect()
    blocks = {r["source"]: -(-int(r["target"] + 0.5) // 64) for r in rows}
    names = sorted(s for s in blocks if s is not None) + [None]
    leaves = split_quotas(spark.createDataFrame([([blocks[s] for s in names],)], "quotas array<long>")).collect()
    leaves.sort(key=lambda r: r["shard"])
    shard_of = {}
    for i, s in enumerate(names):
        key = int(hashlib.md5((mixing.SEED + (":null" if s is None else ":key:" + s)).encode()).hexdigest()[:7], 16)
        drawn = [r["shard"] for r in leaves for _ in range(r["quotas"][i])]
        assert len(drawn) == blocks[s]
        shard_of[s] = [drawn[x] for x in plain_permutation(blocks[s], key)]
    seen = set()
    for r in rows:
        for d in r["draws"]:
            assert d.shard == shard_of[r["source"]][d.block]
            seen.add(d.shard)
    assert len(seen) > 8


def test_shards_are_laid_one_by_one_and_shuffled(sample, clashing, nothing):
    plan = mix(sample, block_words=64)
    want = Counter()
    for r in plan.collect():
        want.update((d.shard, r["doc_id"], r["text"]) for d in r["draws"] if d.words * 2 >= r["size"])
    out = sharded_rows(sample, block_words=64)
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert Counter((r["shard"], r["doc_id"], r["text"]) for r in got) == want
    place = {}
    for shard in {r["shard"] for r in got}:  # a small shard is one run of rows of one partition
        at = [i for i, r in enumerate(got) if r["shard"] == shard]
        assert at == list(range(at[0], at[-1] + 1)) and len({got[i]["part"] for i in at}) == 1
        place[shard] = [got[i]["doc_id"] for i in at]
    longest = [i for i in max(place.values(), key=len) if i is not None]
    assert len(longest) > 4 and longest != sorted(longest)
    assert [r[:-1] for r in got] == [tuple(r) for r in sharded_rows(sample.repartition(5), block_words=64).collect()]
    assert sharded_rows(clashing).columns == ["shard", *clashing.columns] and sharded_rows(nothing).count() == 0


def test_split_quotas_are_exact_and_hypergeometric(spark):
    quotas = [7, 0, 100, 33, 1]
    leaves = split_quotas(spark.createDataFrame([(quotas,)], "quotas array<long>"), levels=3).collect()
    assert sorted(r["shard"] for r in leaves) == list(range(8))
    assert [sum(r["quotas"][i] for r in leaves) for i in range(5)] == quotas
    assert {sum(r["quotas"]) for r in leaves} <= {17, 18}
    # inversion of the distribution function: frequencies over a fine grid of u
    grid = spark.range(2000).select(hypergeometric(
        F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 2000).alias("k"))
    from math import comb
    seen = {r["k"]: r["count"] / 2000 for r in grid.groupBy("k").count().collect()}
    for k in range(11):
        assert abs(seen.get(k, 0) - comb(20, k) * comb(30, 10 - k) / comb(50, 10)) < 2e-3
