"""Metric documents and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def fusion_metrics_doc(search: DataFrame, summary: DataFrame, confusion: DataFrame,
                       y: str = "target", yhat: str = "pred") -> DataFrame:
    """One-row document: alpha_tested, best_alpha, validation_best_f1,
    test_f1, test_confusion_matrix (rows in label order).  Every collected
    list is bounded by the alpha grid or the class count."""
    tested = search.agg(F.sort_array(F.collect_list(F.struct(
        F.col("alpha_pos"), F.col("alpha"), F.col("validation_macro_f1")))).alias("_t"))
    tested = tested.select(F.transform("_t", lambda s: F.struct(
        s["alpha"].alias("alpha"), s["validation_macro_f1"].alias("validation_macro_f1"))).alias("alpha_tested"))
    rows = confusion.groupBy(y).agg(F.sort_array(F.collect_list(F.struct(yhat, "n"))).alias("_r"))
    matrix = rows.agg(F.sort_array(F.collect_list(F.struct(y, "_r"))).alias("_m")).select(
        F.transform("_m", lambda r: F.transform(r["_r"], lambda c: c["n"])).alias("test_confusion_matrix"))
    return (tested.crossJoin(summary.select("best_alpha", "validation_best_f1", "test_f1"))
            .crossJoin(matrix))


def experiment_summary(model_metrics: DataFrame, info: DataFrame) -> DataFrame:
    """One row with every model's metrics side by side plus dataset info."""
    metrics = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]
    p = model_metrics.groupBy().pivot("model", ["lexical", "graph", "hybrid"]).agg(
        *[F.first(m).alias(m) for m in metrics])
    return p.crossJoin(info)


def comparison_record(model_metrics: DataFrame, info: DataFrame) -> DataFrame:
    """Lexical vs hybrid record with a run timestamp."""
    lex = F.max(F.when(F.col("model") == "lexical", F.col("macro_f1")))
    hyb = F.max(F.when(F.col("model") == "hybrid", F.col("macro_f1")))
    r = model_metrics.agg(lex.alias("lightgbm_macro_f1"), hyb.alias("hybrid_macro_f1"))
    r = r.withColumn("improvement_percent", F.when(F.col("lightgbm_macro_f1") != 0,
                                                   (F.col("hybrid_macro_f1") - F.col("lightgbm_macro_f1"))
                                                   / F.col("lightgbm_macro_f1") * 100.0).otherwise(0.0))
    return r.crossJoin(info).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def append_runs(records: DataFrame, path: str, run_id: str, finished: str) -> None:
    """Add a run's records (one row a model) to the run table; a run written again replaces its own
    partition and no other."""
    r = records.withColumn("finished", F.lit(finished).cast("timestamp")).withColumn("run_id", F.lit(run_id))
    r.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def run_table(spark: SparkSession, path: str) -> DataFrame:
    """Every record; the run id is text, whatever it looks like."""
    schema = StructType([f if f.name != "run_id" else StructField("run_id", StringType())
                         for f in spark.read.parquet(path).schema])
    return spark.read.schema(schema).parquet(path)


def latest_runs(spark: SparkSession, path: str, by: str = "model") -> DataFrame:
    """Each model's record of the run that ended last (of runs that ended together, the larger id)."""
    t = run_table(spark, path)
    newest = t.groupBy(by).agg(F.max(F.struct("finished", "run_id")).alias("_last"))
    t = t.join(newest, by)
    return t.filter((F.col("finished") == F.col("_last.finished")) & (F.col("run_id") == F.col("_last.run_id"))).drop("_last")
