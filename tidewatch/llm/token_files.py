"""Operator 5: token ids in compressed, checksummed binary files, in ascending document order.

Documents are dealt by ranges of their id and sorted, so that partition after partition holds them
in ascending order.  Each task tokenises its documents and writes files of about ``FILE_IDS`` ids, cut
between documents: a header, the documents' lengths, and the blocks of :mod:`id_codec`, each with the
crc32 of its payload.  Files are rows of a Parquet table in the shared folder (part, file, n_ids,
content), so they live where Spark writes and can be read from any machine.  Reading checks every
checksum, decodes all blocks of a file at once and gives the documents back.

A file, a batch of texts and the stretches that :mod:`word_ids` keeps bound a task's memory; one document
longer than ``FILE_IDS`` makes a file of its own size.

File format, little endian: ``TWID``, version u16, block length u32, blocks u32, ids u64, documents
u32, size and crc32 of the document table (u32), size and crc32 of the coder's model (u32); per block
payload size u32 and crc32 u32; the document table (zlib: ids i64 with a null mask u8, then lengths
u64); the model; the payloads.

Special strings of the vocabulary in a text get their ids, as the library gives them; documents are
told apart by the document table, not by an id.

Defined results: a null text is empty and has the end id only; null ids come first, ties in the id
are ordered by text, and ranges go on by its first characters, so that different texts of one id need
not lie in one task; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import id_codec
from .common import staged, text_or_empty
from .word_ids import WordIds

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FILE_IDS = 2 << 20
_HEAD = struct.Struct("<4sHIIQIIIII")
_STATE: dict = {}


def tokenise(texts: list[str | None], path: str | None = None) -> list[np.ndarray]:
    """uint16 ids of whole texts with the end id; a worker keeps its tokenizer."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = WordIds(path, END_ID)
    return _STATE[path].encode(texts)


def write_file(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """One file of whole documents."""
    lengths = np.array([len(x) for x in ids], "<u8")
    stream = np.concatenate(ids)
    steps = id_codec.block_length(len(stream))
    model, *payloads = id_codec.encode(stream, steps)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    table = zlib.compress(keys.tobytes() + null.tobytes() + lengths.tobytes(), 1)
    head = _HEAD.pack(b"TWID", 2, steps, len(payloads), len(stream), len(ids), len(table), zlib.crc32(table),
                      len(model), zlib.crc32(model))
    index = np.array([(len(p), zlib.crc32(p)) for p in payloads], "<u4").tobytes()
    return b"".join([head, index, table, model, *payloads])


def read_file(content: bytes) -> tuple[list, list[np.ndarray]]:
    """(document ids, their token ids); raises if a checksum or a count does not fit."""
    magic, version, steps, blocks, n, docs, size, crc, model_size, model_crc = _HEAD.unpack_from(content)
    if magic != b"TWID" or version != 2:
        raise ValueError("not a token file of version 2")
    at = _HEAD.size
    index = np.frombuffer(content, "<u4", 2 * blocks, at).reshape(blocks, 2)
    at += 8 * blocks
    table = content[at:at + size]
    if zlib.crc32(table) != crc:
        raise ValueError("document table damaged")
    at += size
    model = content[at:at + model_size]
    if zlib.crc32(model) != model_crc:
        raise ValueError("model damaged")
    at += model_size
    payloads = []
    for length, check in index.tolist():
        payloads.append(content[at:at + length])
        at += length
        if zlib.crc32(payloads[-1]) != check:
            raise ValueError(f"block {len(payloads) - 1} damaged")
    raw = zlib.decompress(table)
    keys, null = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 8 * docs)
    lengths = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
    if lengths.sum() != n:
        raise ValueError("document lengths do not add up")
    ids = id_codec.decode([model, *payloads], n, steps)
    return ([None if z else int(k) for k, z in zip(keys, null)],
            np.split(ids, np.cumsum(lengths)[:-1]) if docs else [])


def write_token_files(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      path: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """(part, file, n_ids, content): the files, written to the shared folder; documents ascend."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    t = t.repartitionByRange("doc_id", F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([write_file(keys, ids)], pa.binary())], names=["part", "file", "n_ids", "content"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                few = batch.slice(i, 1024)
                for key, x in zip(few.column(0).to_pylist(), tokenise(few.column(1).to_pylist(), path)):
                    if held and held + len(x) > file_ids:
                        yield file()
                        number, keys, ids, held = number + 1, [], [], 0
                    keys.append(key), ids.append(x)
                    held += len(x)
        if keys:
            yield file()

    return staged(t.mapInArrow(write, "part int, file int, n_ids long, content binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(part, file, doc_id, at, n_tokens, ids_crc32): documents read back; ``at`` counts from the file's start."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(*(batch.column(i) for i in range(3))):
                keys, ids = read_file(content.as_py())
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part.as_py()), pa.int32()), pa.array(np.full(len(n), number.as_py()), pa.int32()),
                     pa.array(keys, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n),
                     pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                    names=["part", "file", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.select("part", "file", "content").mapInArrow(
        read, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files; start counts over all files."""
    def ahead(order) -> Column:
        return F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # one row a task
    parts = parts.select("part", ahead(Window.orderBy("part")).alias("base"))
    inside = files.select("part", "file", ahead(Window.partitionBy("part").orderBy("file")).alias("inside"))
    starts = inside.join(parts, "part").select("part", "file", (F.col("base") + F.col("inside")).alias("ahead"))
    return (read_token_files(files).join(starts, ["part", "file"])
            .select("doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
