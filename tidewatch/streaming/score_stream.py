"""Streaming URL scoring.

The scoring plan is stateless (projections and joins with static tables), so
a stream of URL rows is scored in append mode without watermarks.  Output and
checkpoint folders belong to the caller: a query started again with the same
two folders goes on where the last one stopped and delivers every row once.
``foreach_batch_score`` is the micro-batch form for sinks that need batch writes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import KeyDictionary, KeyedSums
from ..plans.scoring import Engines, score

Transform = Callable[[DataFrame], DataFrame]


def url_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None,
               file_glob: str | None = None) -> DataFrame:
    """File-source stream of URL rows (parquet files in directory ``path``,
    optionally only file names matching ``file_glob``).  ``max_files`` bounds a
    micro-batch; by default Spark takes all files that are there."""
    r = spark.readStream.schema(schema)
    if max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    return r.parquet(path)


def table_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream of a parquet table that is one file or a folder of files.

    The file source takes folders only: of a single file, its folder is watched for that name.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return url_stream(spark, path, schema, max_files)
    return url_stream(spark, at.getParent().toString(), schema, max_files, at.getName())


def finish(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for the query to end.  A failure of the query is raised; so is a
    ``timeout_s`` that runs out, after stopping the query: its checkpoint is
    intact, and starting it again delivers the rest."""
    ended = query.awaitTermination(timeout_s) if timeout_s is not None else query.awaitTermination()
    if timeout_s is not None and not ended:
        query.stop()
        raise TimeoutError(f"stream not finished after {timeout_s} s; restart it with the same checkpoint")
    if query.exception() is not None:
        raise query.exception()


def stream_into(source: DataFrame, transform: Transform, out_dir: str, checkpoint_dir: str,
                available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Start ``transform(source)`` into a Parquet sink; the caller waits (``finish``) or stops it."""
    w = (transform(source).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start(out_dir)


def run_stream_score(source: DataFrame, eng: Engines, out_dir: str, checkpoint_dir: str,
                     timeout_s: float | None = None) -> str:
    """Score everything the source holds now into ``out_dir``."""
    finish(stream_into(source, lambda s: score(s, eng), out_dir, checkpoint_dir), timeout_s)
    return out_dir


def stream_batches_into(source: DataFrame, transform: Transform, out_dir: str,
                        checkpoint_dir: str) -> StreamingQuery:
    """Micro-batches written as batches: each epoch overwrites its own
    partition directory, so a repeated epoch leaves its rows once."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    return (source.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def foreach_batch_score(source: DataFrame, eng: Engines, out_dir: str, checkpoint_dir: str,
                        timeout_s: float | None = None) -> str:
    """Micro-batch scoring with batch writes per epoch."""
    finish(stream_batches_into(source, lambda b: score(b, eng), out_dir, checkpoint_dir), timeout_s)
    return out_dir


def keep_sums(source: DataFrame, table: KeyedSums, checkpoint_dir: str, transform: Transform | None = None) -> StreamingQuery:
    """Keep a table of counts and sums up to date with a stream: one merge a micro-batch.

    A batch that is run again after a failure has its epoch in the table's log and changes nothing.
    """
    def merge(batch: DataFrame, epoch_id: int) -> None:
        table.merge(transform(batch) if transform else batch, epoch_id)

    return (source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def keep_ids(source: DataFrame, table: KeyDictionary, checkpoint_dir: str) -> StreamingQuery:
    """Give the keys of a stream stable ids: one addition a micro-batch."""
    def add(batch: DataFrame, epoch_id: int) -> None:
        table.add(batch, epoch_id)

    return (source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
