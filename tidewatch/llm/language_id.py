"""Operator 10: language ID by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is filled with excerpts of a bounded sample of
labelled rows.  A text is cut into blocks, every block is compressed with every dictionary, and the
language with the fewest bytes in sum over the whole text wins; the margin to the second decides
whether the decision is firm or rejected.

Parameters that bound the model: ``ROWS`` sampled rows a language (chosen by a hash of the id among
all labelled rows), ``EXCERPT`` bytes of each and ``DICT_BYTES`` a dictionary.  The driver holds the
dictionaries only, one a language.  Scoring is row-wise over all documents, in Arrow batches.

Defined results: a null text or one without a letter gets ``und``, score 0 and is rejected; ties go
to the first language in code-point order; with no labelled row every document is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

ROWS = 96
EXCERPT = 2048
DICT_BYTES = 192 << 10
BLOCK = 4096
LEVEL = 6
MARGIN = 0.002
SHORT, TURNS = 1024, 8
PAD = b" " * 256  # so that a short block is compressible at all and not stored as it is
NO_LANGUAGE = "und"
LETTER = r"\p{L}"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Word characters that are no letters either: numerals like a half, a superscript or a Roman one.
_NUMERALS = frozenset(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha())


def normalise(text: str) -> bytes:
    """Lower case; each run of anything but letters becomes one space."""
    text = _NOT_LETTERS.sub(" ", text.lower())
    if not text.isascii() and not _NUMERALS.isdisjoint(text):
        text = " ".join("".join(" " if c in _NUMERALS else c for c in text).split())
    return text.strip().encode("utf-8", "replace")


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          rows: int = ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content of each language, from labelled rows that are not held out.

    Per language about ``8 * rows`` rows are drawn by the hash of their id and the ``rows`` first of
    them by that hash are used, so the choice does not depend on partitioning.
    """
    t = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                    F.col(id_col).alias("id")).filter(F.col("lang").isNotNull() & ~held_out("id"))
    per_lang = t.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    draw = F.xxhash64(F.lit("lang"), "id")
    unit = F.pmod(draw, F.lit(1 << 30)).cast("double") / float(1 << 30)
    cut = F.substring("text", 1, 4 * EXCERPT)
    drawn = (t.filter(F.rlike("text", F.lit(LETTER)))
             .join(F.broadcast(per_lang), "lang").filter(unit * F.col("n") < 8 * rows)
             .select("lang", draw.alias("draw"), "id", cut.alias("text")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    sample = drawn.withColumn("rank", first).filter(F.col("rank") <= rows).collect()
    content: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.lang, -r["rank"])):
        content.setdefault(r.lang, []).append(normalise(r.text)[:EXCERPT])
    return {lang: b" ".join(parts)[-dict_bytes:] for lang, parts in sorted(content.items())}


def _compressors(model: dict[str, bytes], fine: bool = False) -> list:
    """One compressor a language; ``fine`` ones look for matches of three bytes on."""
    import zstandard as zstd

    made = []
    for content in model.values():
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        if fine:
            how = zstd.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=18, search_log=6, min_match=3,
                                                 target_length=32, strategy=zstd.STRATEGY_BTLAZY2,
                                                 write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=how)
            made.append(zstd.ZstdCompressor(compression_params=how, dict_data=d))
        else:
            d.precompute_compress(level=LEVEL)
            made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                            write_content_size=False, write_dict_id=False))
    return made


def sizes(data: bytes, compressors: list, fine: list | None = None) -> list[int]:
    """Compressed bytes of the whole text, block by block, with each dictionary.

    Texts below ``SHORT`` bytes are encoded by the ``fine`` compressors in up to ``TURNS`` rotations
    of their words, so that neither whole bytes nor storing hides a small margin.
    """
    if len(data) < SHORT:
        words = data.split(b" ")
        starts = sorted({len(words) * i // TURNS for i in range(TURNS)})
        blocks = [PAD + b" ".join(words[i:] + words[:i]) + b" " for i in starts]
        compressors = fine or compressors
    else:
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def classify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN,
             columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with lang_pred, score (relative margin to the second) and rejected."""
    names = docs.columns
    out = columns if columns is not None else names
    t = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = t.select(*[f"c{names.index(c)}" for c in out], F.col(f"c{names.index(text_col)}").alias("t"))
    schema = StructType([*t.schema.fields[:-1], StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(shared.value)
        compressors, fine = _compressors(shared.value), _compressors(shared.value, fine=True)
        for batch in batches:
            preds, scores, rejected = [], [], []
            for text in batch.column(batch.num_columns - 1):
                data = normalise(text.as_py() or "")
                if not data or not langs:
                    preds.append(NO_LANGUAGE), scores.append(0.0), rejected.append(True)
                    continue
                n = sizes(data, compressors, fine)
                best = min(range(len(n)), key=n.__getitem__)
                second = min((x for i, x in enumerate(n) if i != best), default=2 * n[best])
                gap = 1.0 - n[best] / second
                preds.append(langs[best]), scores.append(gap), rejected.append(gap < margin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return t.mapInArrow(score, schema).toDF(*out, "lang_pred", "score", "rejected")


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
             margin: float = MARGIN, columns: list[str] | None = None) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and classify all of its rows."""
    return classify(docs, learn(docs, text_col, lang_col, id_col), text_col, margin, columns)
