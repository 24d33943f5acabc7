"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows
its predecessor kept.  ``run`` writes every stage as Parquet in the shared checkpoint folder and
rereads it for the next.  The result has one row a packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import documents, staged
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.language_id import identify
from tidewatch.llm.mixing import mixed_rows
from tidewatch.llm.near_dedup import near_dedup
from tidewatch.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no compressor, so the first stage cannot be stated in it; tests hold every stage against
#: a brute-force version.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told firmly; learns from the labelled rows of its own input."""
    docs = docs.select(*COLUMNS)
    found = identify(docs)
    return found.filter("NOT rejected").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the smallest doc_id."""
    return exact_dedup(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles."""
    return near_dedup(docs.select(*COLUMNS), shingle=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixed_rows(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
