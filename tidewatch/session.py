"""Spark session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on, given only where the user has set none.  AQE
# re-plans joins from runtime statistics (a shuffled join whose side turns out
# small becomes a broadcast join, skewed partitions are split).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# for a local master only, at session start
_LOCAL = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark records the Python call site of every DataFrame/Column call for
    # error messages; that stack walk costs ~1 ms per call when plans are built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def is_local(master: str) -> bool:
    """One JVM on this machine (``local-cluster`` has executors of its own)."""
    return master == "local" or master.startswith("local[")


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tidewatch") -> SparkSession:
    """The running session, or a new one.

    Settings given on the command line, in a defaults file or by a running
    session stay as they are; the settings above fill in what is unset, and
    local defaults (8 shuffle partitions, driver memory, no web page) are for a
    local master only.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    # under spark-submit the JVM and its settings exist already
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "--conf" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if master and is_local(master) and not submitted:
        for k, v in _LOCAL.items():
            b = b.config(k, v)
        b = b.config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEM", "8g"))
    spark = b.getOrCreate()
    conf = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if not conf.contains(k):
            spark.conf.set(k, v)
    if shuffle_partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif is_local(spark.sparkContext.master) and not conf.contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    # the L-BFGS line search of the MLP logs recoverable step-size retries
    jvm = spark.sparkContext._jvm
    try:
        jvm.org.apache.logging.log4j.core.config.Configurator.setLevel(
            "breeze.optimize", jvm.org.apache.logging.log4j.Level.OFF)
    except Exception:  # noqa: BLE001
        pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory of the session (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a scratch folder; any other master is
    an error, as executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    cdir = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not cdir:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        cdir = tempfile.mkdtemp(prefix="tidewatch-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(cdir)
    return sc.getCheckpointDir() or cdir


_MATERIALIZED: dict = {}
_UNKEYED: list = []


def input_signature(*paths: str) -> tuple:
    """Identity of input paths for memoised stages: path, size and modification
    time of every file below them, as their own file system lists them."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    sig = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            sig.append((p, None))
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            sig.append((p, f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(sig, key=repr))


def _memo(spark, name: str, key: tuple) -> tuple:
    return (spark.sparkContext.applicationId, name, key)


def stage_table(spark, name: str, key: tuple, build, partition_by=None):
    """Memoised ``materialize(build(), name)``: within one session a stage
    with the same name and input signature is written once and read back
    afterwards (the plan of ``build`` is not even constructed again)."""
    memo = _memo(spark, name, key)
    if memo in _MATERIALIZED:
        return spark.read.parquet(_MATERIALIZED[memo])
    return materialize(build(), name, key, partition_by)


def materialize(df, name: str = "stage", key: tuple | None = None, partition_by=None):
    """Write ``df`` as a Parquet table under the shared checkpoint directory
    and return a DataFrame reading it back.

    Cuts the lineage of tables that several later stages read (each reader
    then scans only the columns it needs) and survives executor loss: the
    files live in the cluster's shared checkpoint folder, not on one machine.
    Tables without a ``key`` go with ``release_stages`` or when Python ends.
    """
    import uuid
    spark = df.sparkSession
    memo = _memo(spark, name, key) if key is not None else None
    if memo is not None and memo in _MATERIALIZED:
        return spark.read.parquet(_MATERIALIZED[memo])
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    if memo is not None:
        _MATERIALIZED[memo] = path
    else:
        _UNKEYED.append((spark, path))
    return spark.read.parquet(path)


def bucketed_table(df, name: str, key: str, buckets: int | None = None):
    """Write ``df`` under the shared checkpoint directory, bucketed and sorted by ``key``, and read it back.

    A join on ``key`` reads the buckets as they lie: only its other side is shuffled, to as many
    partitions.  ``buckets`` is the number of shuffle partitions unless given (with fewer, Spark may
    shuffle both sides to use its cores).
    """
    import uuid
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{table}"
    # one task a bucket writes one file
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table))
    _UNKEYED.append((spark, path))
    return spark.table(table)


def release_stages(spark: SparkSession | None = None) -> int:
    """Delete the unkeyed stage tables written so far (of ``spark``, or all);
    frames that still read them must not be used afterwards."""
    mine = [(s, p) for s, p in _UNKEYED if spark is None or s is spark]
    for s, p in mine:
        path = s._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(s._jsc.hadoopConfiguration()).delete(path, True)
        _UNKEYED.remove((s, p))
    return len(mine)


@atexit.register
def _release_at_exit() -> None:
    try:
        release_stages()
    except Exception:  # noqa: BLE001  (the session is gone already)
        pass


def recommended_conf(input_bytes: int, executor_cores_total: int,
                     target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run sized from the input volume.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least two waves of the cluster's cores); AQE coalesces small ones
    and splits skewed ones at run time.
    """
    parts = max(2 * executor_cores_total, input_bytes // target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
