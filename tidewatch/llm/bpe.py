"""Byte-level BPE encoding that encodes shared passages once, and decoding.

Texts are cut into content-defined chunks (:mod:`chunks`).  Hashes of all chunks are counted; chunks
that occur again, anywhere, are encoded once each and their ids handed to every place they stand at.
The text between them is encoded where it lies.  A join of two pieces is then repaired: the tokens on
both sides are taken back to the nearest place where a word of the tokenizer's pattern starts whatever
stands around it (so the whole text's scan and both pieces' scans agree there), and what lies between
is encoded again.  A window without such a place grows to the ends of the pieces, so the ids
always equal those of the whole text.

Texts without a shared chunk are encoded in place and never move.  Of the others, ids and references
move, not the text; shared chunks move once a task.  Which chunks are shared reaches the tasks as a
bitmap of 2^26 bits (8 MB, whatever the size of the data); a false bit only sends a chunk round.
References are 128-bit digests; chunks are told apart by their text, and a reference with two texts is
an error.  A chunk that stands in very many texts is handed out in ``n / share`` copies.

Ids are those of the tokenizers library for the file at ``path`` (byte-level BPE, no normaliser, no
added prefix, GPT-2's word pattern) with ``add_special_tokens=False``: strings of special tokens in a
text get their special id.  The merges are carried out by tiktoken from the vocabulary of that file.
``ids`` holds little-endian unsigned 32-bit numbers.

Rows: a null or empty text has no ids; repeated rows and null or repeated ids are rows like others;
other columns stay, whatever their names; an empty table gives no rows.  Texts of any length are
taken whole; a text must fit in a task.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .chunks import chunk_edges
from .common import place, positional, shuffle_partitions, staged

BITS = 26
SPREAD = 4
BATCH = 4 << 20
ROWS = 256  # texts put together at a time
# fixed value: the word pattern of the byte-level pre-tokenizer
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CJK, _STOPS = "ぁ-ゖァ-ヺ一-龥", "、。！，？"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, which may open a word like 's
#: Places where a word starts in every context: white space after anything else, and between letters, digits
#: and marks.  Only characters whose class never changed are used.
SURE = re.compile(rf"(?<=[^\s᠎])[ \t\n\r\x0b\x0c]|(?<=[A-Za-z])[0-9'{_MARKS}]|(?<=[0-9])[A-Za-z'{_MARKS}]"
                  rf"|(?<=[{_MARKS}])[A-Za-z0-9]|(?<=[{_CJK}])[{_STOPS}]|(?<=[{_STOPS}])[{_CJK}]")
FIRST = 16  # tokens a side of a window to begin with


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Encoder and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE")
        # the format writes bytes as printable characters: those that are, as they are, the others from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.ranks, self.special = ranks, special
        longest_first = sorted(special, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for table in (ranks, {k.encode(): v for k, v in special.items()}):
            for k, v in table.items():
                self.bytes[v] = k
        self.lengths = np.array([len(b) for b in self.bytes])

    @functools.cached_property
    def encoder(self) -> tiktoken.Encoding:
        """Made where it is used: decoding does without it."""
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text without special strings."""
        return np.array(self.encoder.encode_ordinary(text), "<u4")

    def segments(self, text: str) -> list[str]:
        """Text cut at special strings: every second entry is one."""
        return self.splitter.split(text) if self.splitter else [text]

    def text(self, ids) -> bytes:
        known = self.bytes
        return b"".join([known[i] for i in ids if i < len(known)])

    def decoded(self, ids: bytes) -> str:
        """Text of stored ids; bytes that are no UTF-8 become U+FFFD."""
        return self.text(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _head(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of the first tokens; a character that is cut at their end is left out."""
    return v.text(ids.tolist()).decode("utf-8", "ignore")


def join(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of two neighbouring texts as one, from the ids of each.

    ``left`` starts where a word of the whole text starts.
    """
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    back = ahead = FIRST
    while True:
        tail, head = left[-back:], right[:ahead]
        whole_left, whole_right = len(tail) == len(left), len(head) == len(right)
        before = v.text(tail.tolist())
        skipped = 0 if whole_left else next((i for i in range(4) if i >= len(before) or before[i] & 0xC0 != 0x80), 4)
        a = before[skipped:].decode("utf-8")
        b = _head(v, head)
        places = [m.start() for m in SURE.finditer(a + b)]
        p = max([x for x in places if x <= len(a)], default=0 if whole_left else None)
        q = min([x for x in places if x >= len(a)], default=len(a + b) if whole_right else None)
        if p is not None and q is not None:
            # in tokens: how many of either side stay
            stay = np.concatenate([[0], np.cumsum(v.lengths[tail])])
            cut = len(a[:p].encode()) + skipped
            i = int(np.searchsorted(stay, cut))
            taken = np.concatenate([[0], np.cumsum(v.lengths[head])])
            end = len((a + b)[len(a):q].encode())
            j = int(np.searchsorted(taken, end))
            if stay[i] == cut and taken[j] == end:
                middle = v.ids((a + b)[p:q])
                return np.concatenate([left[:len(left) - len(tail) + i], middle, right[j:]])
        if whole_left and whole_right:
            return v.ids(a + b)
        if p is None or not whole_left and q is not None:
            back *= 2
        if q is None or not whole_right and p is not None:
            ahead *= 2


def assemble(v: Vocabulary, pieces) -> np.ndarray:
    """Ids of a text from its pieces ``(ids, fresh)``; a fresh piece starts a segment and is not joined."""
    done, left = [], np.zeros(0, "<u4")
    for ids, fresh in pieces:
        if fresh:
            done.append(left)
            left = ids
        else:
            left = join(v, left, ids)
    return np.concatenate([*done, left])


def _slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``BATCH`` bytes of a column (or one row), so that a worker holds few texts at a time."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _chunked(v: Vocabulary, texts: list[str | None]):
    """Every text's segments, and of each ordinary segment the ends of its chunks."""
    split = [v.segments(t or "") for t in texts]
    edges = chunk_edges([s for parts in split for s in parts[::2]])
    for parts in split:
        yield [(s, next(edges) if i % 2 == 0 else None) for i, s in enumerate(parts)]


def _hashes(parts) -> list[int]:
    return [xxhash.xxh3_64_intdigest(s[a:b]) for s, ends in parts if ends for a, b in zip(ends, ends[1:])]


def _shared_bits(docs: DataFrame, path: str, bits: int) -> np.ndarray:
    """Bitmap over hash values: chunks that occur more than once in all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in _slices(batches):
            h = [x for parts in _chunked(v, b.column(0).to_pylist()) for x in _hashes(parts)]
            h, n = np.unique(np.array(h, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    again = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    # functions of the built-in bitmaps number bits from 1; at most 2^bits / 32768 rows of 4 KB
    bit = F.expr(f"pmod(h, {1 << bits}L) + 1")
    rows = again.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _marked(bitmap: np.ndarray, bits: int, hashes: list[int]) -> np.ndarray:
    h = np.array(hashes, np.uint64) & np.uint64((1 << bits) - 1)
    return (bitmap[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pieces(parts, shared: Iterator[bool]) -> list[tuple[str, bool, bool]]:
    """Pieces ``(text, fresh, is shared chunk)``; neighbouring chunks that are not shared make one piece."""
    out = []
    for s, ends in parts:
        if ends is None:
            out.append((s, True, False))
            continue
        fresh = True
        run = 0
        for a, b in zip(ends, ends[1:]):
            if next(shared):
                if run < a:
                    out.append((s[run:a], fresh, False))
                    fresh = False
                out.append((s[a:b], fresh, True))
                fresh, run = False, b
        if run < len(s):
            out.append((s[run:], fresh, False))
    return out


def _reference(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


def encode(docs: DataFrame, text: str = "text", columns: list[str] | None = None, path: str | None = None,
           bits: int = BITS, decoded: str | None = None) -> DataFrame:
    """``columns`` of every row and ``ids``, the binary ids of its text.

    ``decoded`` names a further column: the text of these ids, as :func:`decode` gives it, made in the same task.
    """
    path = path or default_path()
    more = ["decoded"] if decoded else []
    spark = docs.sparkSession
    t, names = positional(docs)
    columns = names if columns is None else columns
    own = [place(names, c) for c in columns]
    t = t.select(F.col(place(names, text)).alias("text"), *own)
    held = spark.sparkContext.broadcast(_shared_bits(t.select("text"), path, bits))

    def each(batch: pa.RecordBatch):
        """Row, its pieces and whether one of them is a shared chunk."""
        v = vocabulary(path)
        chunked = list(_chunked(v, batch.column(0).to_pylist()))
        hashes = [_hashes(parts) for parts in chunked]
        marks = _marked(held.value, bits, [h for hs in hashes for h in hs])
        at = 0
        for i, (parts, hs) in enumerate(zip(chunked, hashes)):
            mine = marks[at:at + len(hs)]
            at += len(hs)
            yield i, parts, mine

    def local_ids(v, piece, fresh):
        return np.array([v.special[piece]], "<u4") if fresh and piece in v.special else v.ids(piece)

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a shared chunk."""
        v = vocabulary(path)
        for b in _slices(batches):
            rows, ids = [], []
            for i, parts, mine in each(b):
                if not mine.any():
                    rows.append(i)
                    ids.append(assemble(v, [(local_ids(v, s, f), f) for s, f, _ in _pieces(parts, iter(mine))]).tobytes())
            if rows:
                taken = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns[1:], *_results(v, ids, more)], [*own, "ids", *more])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the other texts: a row a piece (ids or reference), and the shared chunks, once a slice."""
        v = vocabulary(path)
        key = TaskContext.get().partitionId() << 33
        for b in _slices(batches):
            out: dict[str, list] = {k: [] for k in ("row", "key", "no", "fresh", "ref", "ids", "chunk", "n")}
            chunks: dict[bytes, list] = {}

            def add(*values):
                for c, x in zip(out.values(), values):
                    c.append(x)
            for i, parts, mine in each(b):
                if not mine.any():
                    continue
                for no, (s, fresh, shared) in enumerate(_pieces(parts, iter(mine))):
                    if shared:
                        ref = _reference(s)
                        chunks.setdefault(ref, [s, 0])[1] += 1
                        if chunks[ref][0] != s:
                            raise ValueError("two chunks with one reference")
                        add(i if no == 0 else None, key, no, fresh, ref, None, None, None)
                    else:
                        add(i if no == 0 else None, key, no, fresh, None, local_ids(v, s, fresh).tobytes(), None, None)
                key += 1
            for ref, (s, n) in chunks.items():
                add(None, None, None, None, ref, None, s, n)
            if out["key"]:
                # the input's columns stand on a text's first piece
                taken = b.take(pa.array(out["row"], pa.int64()))
                first = pa.array([i is not None for i in out["row"]])
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(list(out.values())[1:], kinds)]
                yield pa.RecordBatch.from_arrays([*taken.columns[1:], first, *cols],
                                                 [*own, "first", *list(out)[1:]])
    fields = [t.schema[c] for c in own]
    plain = t.mapInArrow(in_place, StructType([*fields, *_result_fields(more)]))
    kinds = dict(first="boolean", key="long", no="int", fresh="boolean", ref="binary", ids="binary", chunk="string", n="long")
    moved = t.mapInArrow(apart, StructType([*[StructField(f.name, f.dataType) for f in fields],
                                            *[StructField(c, _type(k)) for c, k in kinds.items()]]))
    moved = staged(moved, "bpe-pieces")
    out = plain.unionByName(_gathered(moved, own, path, more))
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, columns)], "ids", *[F.col("decoded").alias(decoded) for _ in more])


def _results(v: Vocabulary, ids: list[bytes], more: list[str]) -> list[pa.Array]:
    return [pa.array(ids, pa.binary()), *[pa.array([v.decoded(x) for x in ids], pa.string()) for _ in more]]


def _result_fields(more: list[str]) -> list[StructField]:
    return [StructField("ids", _type("binary")), *[StructField(c, _type("string")) for c in more]]


def _type(name: str):
    return StructType.fromDDL(f"x {name}")["x"].dataType


def _encoded_chunks(moved: DataFrame, path: str) -> DataFrame:
    """``(ref, n, ids)``: every shared chunk, encoded once, with the number of its places."""
    one = moved.filter("chunk IS NOT NULL").groupBy("ref", "chunk").agg(F.sum("n").alias("n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = pa.array([v.ids(s).tobytes() for s in b["chunk"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b["ref"], b["n"], ids], ["ref", "n", "ids"])
    return staged(one.select("ref", "n", "chunk").mapInArrow(work, "ref binary, n long, ids binary"), "bpe-chunks")


def _gathered(moved: DataFrame, own: list[str], path: str, more: list[str]) -> DataFrame:
    """Texts put together from their pieces and the ids of the shared chunks."""
    spark = moved.sparkSession
    chunks = _encoded_chunks(moved, path)
    pieces = moved.filter("chunk IS NULL")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    share = max(1000, total // (SPREAD * shuffle_partitions(spark)))
    # at most SPREAD times the partitions: references and counts of the chunks that fill a share of one
    often = chunks.filter(F.col("n") > share).select("ref", F.expr(f"n div {share} + 1").cast("int").alias("copies"))
    uses = pieces.filter("ref IS NOT NULL").select("key", "no", "ref").join(F.broadcast(often), "ref", "left")
    uses = uses.select("key", "no", "ref", F.expr("coalesce(pmod(xxhash64(key, no), copies), 0)").cast("int").alias("copy"))
    copies = chunks.join(F.broadcast(often), "ref", "left").select(
        "ref", "ids", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    given = uses.join(copies, ["ref", "copy"]).select("key", "no", "ids")
    parts = pieces.filter("ref IS NULL").select("key", "no", "ids").unionByName(given)
    plan = pieces.groupBy("key").agg(F.first(F.when(F.col("first"), F.struct(F.lit(1).alias("one"), *own)), True).alias("own"),
                                     F.sort_array(F.collect_list(F.struct("no", "fresh"))).alias("marks"))
    parts = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    rows = plan.join(parts, "key").select(F.col("parts.ids").alias("parts"), F.col("marks.fresh").alias("fresh"), "own.*").drop("one")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = [assemble(v, [(np.frombuffer(x, "<u4"), f) for x, f in zip(p, fresh)]).tobytes()
                   for p, fresh in zip(b["parts"].to_pylist(), b["fresh"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *_results(v, ids, more)], [*own, "ids", *more])
    fields = [StructField(c, moved.schema[c].dataType) for c in own]
    return rows.mapInArrow(work, StructType([*fields, *_result_fields(more)]))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Every row with ``out``, the text of its ids, special tokens included; bytes that are no UTF-8 become
    U+FFFD and unknown ids nothing.  A null stays null."""
    path = path or default_path()
    t, names = positional(rows)
    at, fields = names.index(ids), [*t.columns, "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in _slices(batches, at):
            texts = [None if x is None else v.decoded(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], fields)
    done = t.mapInArrow(work, StructType([*t.schema.fields, StructField("decoded", _type("string"))]))
    return done.toDF(*names, out)
