"""Tables that are kept up to date in place: committed versions, keyed sums, key dictionaries.

A table is a folder of data folders and a log.  A version writes its data first and is there once its log
entry is: the entry is written aside and renamed, and the rename fails if another writer was first.  An
entry names every data folder of the table, so readers see one version, whatever is being written.
Versions carry the caller's epoch: an epoch that is in the log already changes nothing, so a stream may
repeat its last batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed the version first; read again and repeat."""


class VersionLog:
    """Log of a table's versions: JSON entries named by version number, below ``root/_log``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.folder = self._path(f"{self.root}/_log")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def entry(self, number: int) -> dict:
        f = self.fs.open(self._path(f"{self.root}/_log/{number}.json"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def last(self) -> tuple[int, dict]:
        """Number and entry of the newest version; -1 and an empty entry for a new table."""
        numbers = self.numbers()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (-1, {})

    def commit(self, number: int, entry: dict) -> None:
        self.fs.mkdirs(self.folder)
        aside = self._path(f"{self.root}/_log/{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, self._path(f"{self.root}/_log/{number}.json"), never_over)
        except Exception as e:  # noqa: BLE001
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} of {self.root} exists") from e
            raise

    def forget(self, keep: int) -> int:
        """Drop all but the newest ``keep`` entries, and data folders that none of those names."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"{self.root}/_log/{n}.json"), False)
        named = {p for n in numbers[-keep:] for p in self.entry(n)["folders"]}
        gone = 0
        data = self._path(f"{self.root}/data")
        for version in self.fs.listStatus(data) if self.fs.exists(data) else []:
            for part in self.fs.listStatus(version.getPath()):
                name = f"{version.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    self.fs.delete(part.getPath(), True)
                    gone += 1
        return gone


class _Bucketed:
    """Rows in hash buckets of a key; a version replaces the folders of the buckets it touches."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.log = VersionLog(spark, root)
        self.schema = schema

    def bucket(self, c: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if c is None else c), F.lit(self.buckets)).cast("int")

    def read(self, entry: dict | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a version (the newest), or of some of its buckets."""
        entry = self.log.last()[1] if entry is None else entry
        folders = [f for f in entry.get("folders", []) if only is None or int(f.rsplit("=", 1)[1]) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.log.root}/data/{f}" for f in folders])

    def _write(self, rows: DataFrame, tag: str) -> list[str]:
        """Rows (with ``_b``, their bucket) as one folder a bucket; a bucket is one file."""
        rows.repartition("_b").write.partitionBy("_b").parquet(f"{self.log.root}/data/{tag}")
        path = self.log._path(f"{self.log.root}/data/{tag}")
        return sorted(f"{tag}/{s.getPath().getName()}" for s in self.log.fs.listStatus(path) if s.isDirectory())


class KeyedSums(_Bucketed):
    """Counts and sums a key, kept up to date batch by batch.

    A batch is aggregated first (one row a key it holds); only the buckets of those keys are read and
    written again.  The sums merge, so any cut of the rows into batches gives the same table (up to the
    rounding of sums of doubles).
    """

    def __init__(self, spark: SparkSession, root: str, key: str, sums, buckets: int = 64):
        self.sums = list(sums)
        schema = ", ".join([f"`{key}` string, n bigint", *[f"`sum_{c}` double" for c in self.sums]])
        super().__init__(spark, root, key, schema, buckets)

    def merge(self, batch: DataFrame, epoch: int) -> bool:
        """Add the rows of ``batch``; False if this epoch, or a later one, is in the table already."""
        from ..session import materialize
        number, entry = self.log.last()
        if epoch <= entry.get("epoch", -1):
            return False
        new = batch.groupBy(F.col(self.key).cast("string").alias(self.key)).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in self.sums])
        new = materialize(new.withColumn("_b", self.bucket()), "keyed_sums")
        touched = {r[0] for r in new.select("_b").distinct().collect()}  # at most the number of buckets
        folders = entry.get("folders", [])
        if touched:
            old = self.read(entry, touched).withColumn("_b", self.bucket())
            both = old.unionByName(new).groupBy("_b", self.key).agg(
                F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in self.sums])
            written = self._write(both, f"{number + 1}-{uuid.uuid4().hex}")
            folders = [f for f in folders if int(f.rsplit("=", 1)[1]) not in touched] + written
        self.log.commit(number + 1, {"epoch": epoch, "folders": folders})
        return True

    def profile(self, prefix: str = "dom") -> DataFrame:
        """The table as ``graph.domain_profile`` gives it: ``{prefix}_n``, ``{prefix}_sum_*``, means ``{prefix}_*``."""
        t = self.read()
        return t.select(self.key, F.col("n").alias(f"{prefix}_n"),
                        *[F.col(f"sum_{c}").alias(f"{prefix}_sum_{c}") for c in self.sums],
                        *[(F.col(f"sum_{c}") / F.col("n")).alias(f"{prefix}_{c}") for c in self.sums])


class KeyDictionary(_Bucketed):
    """Stable ids of keys (J7): a known key keeps its id, new keys take the next numbers without gaps.

    New keys are told by an anti-join with the buckets they fall into; they are numbered by partition
    offsets in the order of their text, and written as folders beside the old ones, which stay as they
    are.  Of two writers that start from one version the second gets :class:`Conflict` and nothing of it
    is seen; :meth:`add` then repeats from the new version.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        super().__init__(spark, root, key, f"`{key}` string, id bigint", buckets)

    def add(self, rows: DataFrame, epoch: int | None = None, tries: int = 5) -> int:
        """Give every key of ``rows`` an id; returns how many were new.  Null keys get none."""
        from ..session import materialize
        keys = rows.select(F.col(self.key).cast("string").alias(self.key)).filter(F.col(self.key).isNotNull()).distinct()
        keys = materialize(keys.withColumn("_b", self.bucket()), "dictionary_keys")
        for _ in range(tries):
            number, entry = self.log.last()
            if epoch is not None and epoch <= entry.get("epoch", -1):
                return 0
            try:
                return self._add(keys, number, entry, epoch)
            except Conflict:
                continue
        raise Conflict(f"{self.log.root}: no version committed in {tries} tries")

    def _add(self, keys: DataFrame, number: int, entry: dict, epoch: int | None) -> int:
        from .graph import dense_index
        touched = {r[0] for r in keys.select("_b").distinct().collect()}  # at most the number of buckets
        new = keys.join(self.read(entry, touched).select(self.key), self.key, "left_anti")
        first = entry.get("next", 0)
        numbered = dense_index(new, [self.key], "id").select(self.key, "_b", (F.col("id") + first).alias("id"))
        written = self._write(numbered, f"{number + 1}-{uuid.uuid4().hex}")
        added = self.read({"folders": written}).count() if written else 0
        self.log.commit(number + 1, {"epoch": entry.get("epoch", -1) if epoch is None else epoch, "next": first + added,
                                     "folders": entry.get("folders", []) + written})
        return added

    def compact(self) -> None:
        """Buckets of many folders written as one folder each; ids stay."""
        number, entry = self.log.last()
        if number >= 0:
            written = self._write(self.read(entry).withColumn("_b", self.bucket()), f"{number + 1}-{uuid.uuid4().hex}")
            self.log.commit(number + 1, entry | {"folders": written})
