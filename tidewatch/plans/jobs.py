"""Batch jobs mirroring the original command-line steps, chained in one
Spark session (no sub-processes): feature table, legacy reputation table,
graph scores, lexical model, fusion metrics, evaluation, batch scoring.

    python -m tidewatch features --raw-data-path urls.csv --output-path out/features
    python -m tidewatch legacy   --data-path out/features --output-path out/graph_features
    python -m tidewatch graph    --data-path out/features --output-path out/gnn_features
    python -m tidewatch lexical  --data-path out/features --model-path out/lexical_model [--lexical boosted]
    python -m tidewatch fusion   --data-path out/graph_features --model-path out/lexical_model \\
                                 --output-path out/hybrid_metrics [--alpha 0.7]
    python -m tidewatch evaluate --data-path out/graph_features --model-path out/lexical_model \\
                                 --output-path out/reports
    python -m tidewatch all      --raw-data-path urls.csv --work-dir out [--skip-prep] [--mode legacy|gnn]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALPHA_GRID, CLASSES, FEATURE_COLS, SERVING_ALPHA
from ..functions.lexical import feature_columns
from ..functions.probs import argmax, prob_array
from ..operators import clean, fusion, graph, metrics, reputation, split
from ..operators.suffix import with_registered_domain
from ..session import materialize
from ..sources import io
from . import models as MD
from .reports import comparison_record, fusion_metrics_doc

CLS = list(range(len(CLASSES)))


def feature_job(spark: SparkSession, raw_path: str, output_path: str, fix_bias: bool = False) -> dict:
    """S1 -> (C1) -> C3 -> L1-L40 -> C4 -> split (P2) -> S3, plus the class
    distribution (A1).  The split is stored: every later job reads this one."""
    raw = io.read_raw_csv(spark, raw_path)
    if fix_bias:
        raw = clean.bias_fix(raw)
    df = clean.validate_and_clean(raw)
    df = df.select("*", *feature_columns("url"))
    df = split.stratified_split(clean.encode_target(df), "target", "url", nested=True)
    io.write_parquet(df, output_path)
    out = spark.read.parquet(output_path)
    dist = {CLASSES[r["target"]]: r["n_rows"] for r in reputation.class_distribution(out, "target").collect()}
    return {"rows": sum(dist.values()), "features": len(FEATURE_COLS), "class_distribution": dist}


def _with_keys(df: DataFrame) -> DataFrame:
    if "registered_domain" in df.columns and "tld" in df.columns:
        return df
    return with_registered_domain(df)


def _with_split(df: DataFrame, target: str) -> DataFrame:
    """The stored split; a table that has none (not from ``feature_job``) gets one."""
    return df if "split" in df.columns else split.stratified_split(df, target, "url", nested=True)


def legacy_job(spark: SparkSession, data_path: str, output_path: str) -> dict:
    """Reputation table (legacy graph mode): U3 -> 70/30 split -> A4-A7 + J1-J3."""
    df = spark.read.parquet(data_path)
    tcol = clean.resolve_target(df)
    df = _with_split(_with_keys(df), tcol)
    rep = reputation.reputation(df, "registered_domain", "tld", tcol, CLS, spread=F.xxhash64("url"))
    io.write_parquet(rep, output_path)
    out = spark.read.parquet(output_path)
    return {"rows": out.count(), "domains": out.select(F.countDistinct("registered_domain")).first()[0]}


def graph_job(spark: SparkSession, data_path: str, output_path: str, max_iter: int = 40) -> dict:
    """Graph engine (gnn mode): propagate -> MLP -> domain_class_{i}_prob (M2, M4)."""
    df = spark.read.parquet(data_path)
    tcol = clean.resolve_target(df)
    df = _with_split(_with_keys(df), tcol)
    prop = graph.with_suffix_vector(graph.propagate(df, FEATURE_COLS, spread=F.xxhash64("url")), "tld",
                                    MD.SUFFIX_BUCKETS)
    prop = materialize(prop, "graph_features", partition_by=["split"])
    cols = MD.graph_feature_cols()
    model, _ = MD.select_graph_model(prop.filter(F.col("split") == "train"), prop.filter(F.col("split") == "val"),
                                     cols, label=tcol, candidates=((max_iter, 42), (max_iter, 7)))
    scored = MD.graph_probs(model, prop, cols)
    ll = metrics.log_loss(scored.filter(F.col("split") == "val"), "p_graph", tcol).first()
    out = MD.export_graph_scores(scored.drop(*[c for c in cols if c not in FEATURE_COLS]))
    io.write_parquet(out, output_path)
    return {"val_log_loss": ll["log_loss"], "val_accuracy": ll["accuracy"]}


def lexical_job(spark: SparkSession, data_path: str, model_path: str, kind: str = "forest") -> dict:
    """M1 (``kind``: forest or boosted) on the train split; model saved with S7."""
    df = spark.read.parquet(data_path)
    tcol = clean.resolve_target(df)
    df = _with_split(df, tcol)
    train = materialize(df.filter(F.col("split") == "train"), "lexical_train")
    model = (MD.train_boosted_model if kind == "boosted" else MD.train_lexical_model)(train, label=tcol)
    MD.save_model(model, model_path)
    return {"trees": sum(map(len, model.trees)) if kind == "boosted" else len(model.stages[-1].trees)}


def _fusion_input(spark: SparkSession, data_path: str, model_path: str) -> tuple[DataFrame, str]:
    df = spark.read.parquet(data_path)
    tcol = clean.resolve_target(df)
    gcols = fusion.graph_prob_columns(df, len(CLS))
    df = _with_split(df, tcol)
    df = df.withColumn("p_graph", prob_array(gcols))
    df = MD.lexical_probs(MD.load_model(model_path), df.withColumn(tcol, F.col(tcol).cast("int")))
    return materialize(df, "fusion_input"), tcol


def fusion_job(spark: SparkSession, data_path: str, model_path: str, output_path: str,
               alpha: float | None = None) -> dict:
    """F2/F3 with the metrics document written as JSON."""
    df, tcol = _fusion_input(spark, data_path, model_path)
    search, summ = fusion.fusion_report(df, "p_lex", "p_graph", tcol, alpha=alpha, alphas=ALPHA_GRID)
    best = fusion.best_alpha(search)
    test = df.filter(F.col("split") == "test").crossJoin(F.broadcast(best))
    test = fusion.fused_prediction(test, "p_lex", "p_graph", F.col("best_alpha"))
    doc = fusion_metrics_doc(search, summ, metrics.confusion(test, tcol, "pred"), y=tcol)
    io.write_json(doc.coalesce(1), output_path)
    return json.loads(doc.toJSON().first())


def evaluation_job(spark: SparkSession, data_path: str, model_path: str, output_path: str,
                   alpha: float = SERVING_ALPHA) -> dict:
    """E1-E10 on the test split, for the lexical, the graph and the hybrid engine:
    reports written as JSON / CSV tables."""
    df, tcol = _fusion_input(spark, data_path, model_path)
    test = fusion.fused_prediction(df.filter(F.col("split") == "test"), "p_lex", "p_graph", alpha)
    engines = {"lexical": argmax("p_lex"), "graph": argmax("p_graph"), "hybrid": F.col("pred")}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), yhat.alias("yhat")) for m, yhat in engines.items()]))
    models = test.select(F.col(tcol).alias("y"), each.alias("e")).select("e.model", "y", "e.yhat")
    summary = metrics.summary(models, "y", "yhat", ["model"])
    io.write_json(metrics.class_report(models, "y", "yhat", ["model"]), f"{output_path}/classification_report")
    io.write_json(metrics.confusion(models, "y", "yhat", ["model"]), f"{output_path}/confusion_matrix")
    for name, p in (("", "p_final"), ("_lexical", "p_lex")):
        ovr = metrics.one_vs_rest(test, p, tcol, len(CLS))
        io.write_json(metrics.auc(ovr), f"{output_path}/auc{name}")
        io.write_json(metrics.roc_points(ovr), f"{output_path}/roc_points{name}")
    # Importances of the lexical forest, all 40 (40 numbers reach the driver)
    imp = MD.forest_importance(spark, MD.load_model(model_path))
    imp = imp.select(F.col("feature").alias("Feature"), F.col("importance").alias("Importance"))
    io.write_csv(imp.orderBy(F.col("Importance").desc(), "Feature").coalesce(1), f"{output_path}/feature_importance")
    info = metrics.dataset_info(df, len(FEATURE_COLS))
    rec = comparison_record(summary, info)
    io.write_json(rec.coalesce(1), f"{output_path}/model_comparison")
    return json.loads(rec.toJSON().first())


def all_job(spark: SparkSession, raw_path: str, work_dir: str, mode: str = "legacy",
            skip_prep: bool = False, alpha: float = SERVING_ALPHA, kind: str = "forest") -> dict:
    """Chain of the steps above; ``skip_prep`` reuses an existing feature table."""
    feats = f"{work_dir}/features"
    if skip_prep:
        def missing():
            raise FileNotFoundError(f"--skip-prep needs an existing feature table at {feats}")
        io.stage(spark, feats, missing)
    else:
        feature_job(spark, raw_path, feats, fix_bias=True)
    lexical_job(spark, feats, f"{work_dir}/lexical_model", kind)
    gpath = f"{work_dir}/graph_features"
    (legacy_job if mode == "legacy" else graph_job)(spark, feats, gpath)
    res = fusion_job(spark, gpath, f"{work_dir}/lexical_model", f"{work_dir}/hybrid_metrics", alpha)
    return {"test_f1": round(res["test_f1"], 4), "best_alpha": res["best_alpha"]}


def _alpha(given: float | None) -> float:
    """The blend weight asked for (0 is one), else the serving default."""
    return SERVING_ALPHA if given is None else given


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tidewatch")
    p.add_argument("step", choices=["features", "legacy", "graph", "lexical", "fusion", "evaluate", "all"])
    p.add_argument("--raw-data-path")
    p.add_argument("--data-path")
    p.add_argument("--model-path")
    p.add_argument("--output-path")
    p.add_argument("--work-dir")
    p.add_argument("--alpha", type=float, default=None)
    p.add_argument("--mode", choices=["legacy", "gnn"], default="legacy")
    p.add_argument("--lexical", choices=["forest", "boosted"], default="forest")
    p.add_argument("--skip-prep", action="store_true")
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    from ..session import get_session
    spark = get_session(a.master)
    if a.step == "features":
        r = feature_job(spark, a.raw_data_path, a.output_path)
    elif a.step == "legacy":
        r = legacy_job(spark, a.data_path, a.output_path)
    elif a.step == "graph":
        r = graph_job(spark, a.data_path, a.output_path)
    elif a.step == "lexical":
        r = lexical_job(spark, a.data_path, a.model_path, a.lexical)
    elif a.step == "fusion":
        r = fusion_job(spark, a.data_path, a.model_path, a.output_path, a.alpha)
    elif a.step == "evaluate":
        r = evaluation_job(spark, a.data_path, a.model_path, a.output_path, _alpha(a.alpha))
    else:
        r = all_job(spark, a.raw_data_path, a.work_dir, a.mode, a.skip_prep, _alpha(a.alpha), a.lexical)
    print(json.dumps(r, default=str))
