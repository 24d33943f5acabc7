"""Lexical and graph classifiers on Spark ML.

M1: VectorAssembler + RandomForestClassifier on the 40 lexical features
(native multiclass probabilities), or gradient-boosted trees (operators.boosting).  M2: the graph engine as "propagate, then
classify": two mean-aggregation hops (operators.graph.propagate) produce
``[x, domain mean, suffix mean]`` and a StandardScaler + multilayer
perceptron (hidden 64, softmax over 4 classes) classifies them.  Both train
distributed on the train split only.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASSES, FEATURE_COLS
from ..operators.boosting import BoostedTrees, Params, fit_boosted

K = len(CLASSES)


SUFFIX_BUCKETS = 16


def graph_feature_cols(feature_cols=FEATURE_COLS, suffix_buckets: int = SUFFIX_BUCKETS) -> list[str]:
    """URL features, domain mean, suffix mean and the suffix's n-gram hash embedding."""
    return (list(feature_cols) + [f"dom_{c}" for c in feature_cols] + [f"tld_{c}" for c in feature_cols]
            + [f"tldv_{i}" for i in range(suffix_buckets)])


def _padded(prob: Column, k: int = K) -> Column:
    """Probability vector as ARRAY<DOUBLE> of exactly k classes."""
    arr = vector_to_array(prob)
    return F.when(F.size(arr) >= k, F.slice(arr, 1, k)).otherwise(
        F.concat(arr, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(arr))))


def train_lexical_model(train: DataFrame, feature_cols=FEATURE_COLS, label: str = "target",
                        num_trees: int = 40, max_depth: int = 8, seed: int = 42) -> PipelineModel:
    """M1: random forest on the lexical features."""
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="lex_vec", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="lex_vec", labelCol=label, probabilityCol="lex_prob",
                                rawPredictionCol="lex_raw", predictionCol="lex_pred",
                                numTrees=num_trees, maxDepth=max_depth, seed=seed)
    data = train.select(*[F.col(c).cast("double") for c in feature_cols],
                        F.col(label).cast("double").alias(label))
    return Pipeline(stages=[asm, rf]).fit(data)


def train_boosted_model(train: DataFrame, feature_cols=FEATURE_COLS, label: str = "target",
                        params: Params | None = None) -> BoostedTrees:
    """M1: gradient-boosted trees on the lexical features, one tree a class and round."""
    return fit_boosted(train, feature_cols, label, K, params)


def lexical_probs(model: PipelineModel | BoostedTrees, df: DataFrame, out: str = "p_lex") -> DataFrame:
    """Class probabilities of either lexical model."""
    if isinstance(model, BoostedTrees):
        return model.predict(df, out)
    cols = df.columns
    return model.transform(df).select(*cols, _padded(F.col("lex_prob")).alias(out))


def forest_importance(spark, model: PipelineModel | BoostedTrees, feature_cols=FEATURE_COLS) -> DataFrame:
    """``(feature, importance)`` of a fitted lexical model, one row a feature."""
    if isinstance(model, BoostedTrees):
        return spark.createDataFrame(model.importance(), "feature string, importance double")
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(feature_cols, values)],
                                 "feature string, importance double")


def train_graph_model(train: DataFrame, cols, label: str = "target", hidden: int = 64,
                      max_iter: int = 60, seed: int = 42) -> PipelineModel:
    """M2: scaler + MLP [d, hidden, 4] on propagated graph features."""
    asm = VectorAssembler(inputCols=list(cols), outputCol="g_vec", handleInvalid="keep")
    sc = StandardScaler(inputCol="g_vec", outputCol="g_scaled", withMean=True, withStd=True)
    mlp = MultilayerPerceptronClassifier(featuresCol="g_scaled", labelCol=label,
                                         probabilityCol="g_prob", rawPredictionCol="g_raw",
                                         predictionCol="g_pred", layers=[len(cols), hidden, K],
                                         maxIter=max_iter, seed=seed)
    data = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
                        F.col(label).cast("double").alias(label))
    # L-BFGS reads its input once per iteration: keep it in memory, spilling to disk
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=[asm, sc, mlp]).fit(data)
    finally:
        data.unpersist()


def select_graph_model(train: DataFrame, val: DataFrame, cols, label: str = "target",
                       candidates=((40, 42), (40, 7)), hidden: int = 64):
    """M2/M3: train one MLP per ``(max_iter, seed)`` candidate and keep the
    one with the lowest validation log loss (returns model, loss table)."""
    from ..operators.metrics import log_loss
    best, rows = None, []
    for it, seed in candidates:
        m = train_graph_model(train, cols, label=label, hidden=hidden, max_iter=it, seed=seed)
        ll = log_loss(graph_probs(m, val, cols), "p_graph", label).first()
        rows.append((it, seed, float(ll["log_loss"]), float(ll["accuracy"])))
        if best is None or ll["log_loss"] < best[1]:
            best = (m, ll["log_loss"])
    table = train.sparkSession.createDataFrame(rows, "max_iter int, seed int, val_log_loss double, val_accuracy double")
    return best[0], table


def train_graph_in_slices(train: DataFrame, val: DataFrame, cols, folder: str, label: str = "target", hidden: int = 64,
                          slices: int = 8, slice_iter: int = 10, patience: int = 3, seed: int = 42):
    """M2 as the original trains it: after every slice of iterations the validation loss, the best weights kept.

    A slice starts from the weights of the one before it and stores its model and losses below ``folder``.
    Training ends after ``slices``, or ``patience`` of them without a lower validation loss.  Called
    again with the same folder (a lost driver), it goes on after the last slice that was stored
    whole.  Returns the model of the lowest validation loss (of equal ones the first) and the table of losses.
    """
    from ..operators.metrics import log_loss
    spark = train.sparkSession
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]
    stored = _stored_slices(spark, folder)
    scale = weights = data = None
    losses = []
    for i in range(slices):
        place = f"{folder.rstrip('/')}/slice={i}"
        if i in stored:
            model = PipelineModel.load(f"{place}/model")
        else:
            if data is None:  # only where a slice is left to train
                scale = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="g_vec", handleInvalid="keep"),
                                         StandardScaler(inputCol="g_vec", outputCol="g_scaled", withMean=True, withStd=True)])
                scale = scale.fit(train.select(*filled))
                data = scale.transform(train.select(*filled, F.col(label).cast("double").alias(label)))
                data = data.select("g_scaled", label).persist(StorageLevel.MEMORY_AND_DISK)
            mlp = MultilayerPerceptronClassifier(
                featuresCol="g_scaled", labelCol=label, probabilityCol="g_prob", rawPredictionCol="g_raw",
                predictionCol="g_pred", layers=[len(cols), hidden, K], maxIter=slice_iter, seed=seed)
            if weights is not None:
                mlp = mlp.setInitialWeights(weights)
            model = PipelineModel(stages=[*scale.stages, mlp.fit(data)])
            model.write().overwrite().save(f"{place}/model")
            ll = log_loss(graph_probs(model, val, cols), "p_graph", label).first()
            row = [(i, float(ll["log_loss"]), float(ll["accuracy"]))]
            # written last: a slice without its losses does not count
            spark.createDataFrame(row, SLICES).coalesce(1).write.mode("overwrite").parquet(f"{place}/losses")
        weights = model.stages[-1].weights
        losses.append(tuple(spark.read.schema(SLICES).parquet(f"{place}/losses").first()))
        best = min(losses, key=lambda r: (r[1], r[0]))
        if i - best[0] >= patience:
            break
    if data is not None:
        data.unpersist()
    return (PipelineModel.load(f"{folder.rstrip('/')}/slice={best[0]}/model"),
            spark.createDataFrame([(*r, r[0] == best[0]) for r in losses], SLICES + ", kept boolean"))


SLICES = "slice int, val_log_loss double, val_accuracy double"


def _stored_slices(spark: SparkSession, folder: str) -> set[int]:
    """Slices from 0 on whose losses were written; one that is missing ends the row."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    out: set[int] = set()
    while fs.exists(path(f"{folder.rstrip('/')}/slice={len(out)}/losses/_SUCCESS")):
        out.add(len(out))
    return out


def graph_probs(model: PipelineModel, df: DataFrame, cols, out: str = "p_graph") -> DataFrame:
    keep = df.columns
    filled = df.select(*[F.col(c) for c in keep if c not in cols],
                       *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return model.transform(filled).select(*keep, _padded(F.col("g_prob")).alias(out))


def export_graph_scores(df: DataFrame, p: str = "p_graph") -> DataFrame:
    """M4: per-class score columns ``domain_class_{i}_prob``."""
    return df.select(*[c for c in df.columns if c != p],
                     *[F.element_at(F.col(p), i + 1).alias(f"domain_class_{i}_prob") for i in range(K)])


def save_model(model: PipelineModel | BoostedTrees, path: str) -> None:
    """Persist a fitted model."""
    if isinstance(model, BoostedTrees):
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(model.to_json(),)], "boosted_trees string").write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | BoostedTrees:
    """Either kind: a Spark ML pipeline keeps a ``metadata`` folder, boosted trees are a one-row table."""
    spark = SparkSession.getActiveSession()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    return BoostedTrees.from_json(spark.read.parquet(path).first()["boosted_trees"])
