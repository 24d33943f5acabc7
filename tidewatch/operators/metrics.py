"""Classification metrics as aggregates.

Everything is computed from one small per-label aggregate: each scored row
contributes (true label) and (predicted label) once, so a single partial
hash aggregate yields tp / support / predicted counts for any number of
groups (models, alphas, splits) at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EPS


def label_counts(df: DataFrame, y: str, yhat: str, group_cols=()) -> DataFrame:
    """Per (group, label): ``tp``, ``support`` (true count), ``n_pred``."""
    g = [F.col(c) for c in group_cols]
    rows = F.explode(F.array(
        F.struct(F.col(y).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col(y) == F.col(yhat)).cast("int").alias("tp")),
        F.struct(F.col(yhat).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(0).alias("tp"))))
    e = df.select(*g, rows.alias("_e")).select(*g, "_e.*")
    return e.groupBy(*group_cols, "label").agg(
        F.sum("tp").cast("long").alias("tp"), F.sum("t").cast("long").alias("support"),
        F.sum("p").cast("long").alias("n_pred"))


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 per label (zero division -> 0)."""
    tp, sup, npred = F.col("tp"), F.col("support"), F.col("n_pred")
    return counts.select(
        "*",
        F.when(npred > 0, tp / npred).otherwise(0.0).alias("precision"),
        F.when(sup > 0, tp / sup).otherwise(0.0).alias("recall"),
        F.when(sup + npred > 0, 2.0 * tp / (sup + npred)).otherwise(0.0).alias("f1"))


def summary(df: DataFrame, y: str, yhat: str, group_cols=()) -> DataFrame:
    """Accuracy, macro and weighted precision / recall / F1."""
    pc = per_class(label_counts(df, y, yhat, group_cols))
    sup = F.sum("support")
    return pc.groupBy(*group_cols).agg(
        (F.sum("tp") / sup).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / sup).alias("weighted_f1"),
        sup.alias("n_rows"))


def class_report(df: DataFrame, y: str, yhat: str, group_cols=()) -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows."""
    pc = per_class(label_counts(df, y, yhat, group_cols)).withColumn(
        "row", F.col("label").cast("string"))
    base = pc.select(*group_cols, "row", "precision", "recall", "f1", "support")
    sup = F.sum("support")
    macro = pc.groupBy(*group_cols).agg(
        F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), sup.alias("support"))
    wavg = lambda c: (F.sum(F.col(c) * F.col("support")) / sup).alias(c)
    weighted = pc.groupBy(*group_cols).agg(
        F.lit("weighted avg").alias("row"), wavg("precision"), wavg("recall"), wavg("f1"),
        sup.alias("support"))
    return base.unionByName(macro).unionByName(weighted)


def confusion(df: DataFrame, y: str, yhat: str, group_cols=()) -> DataFrame:
    """Dense confusion matrix in long form over the union of labels."""
    counts = df.groupBy(*group_cols, y, yhat).agg(F.count(F.lit(1)).alias("n"))
    labels = (df.select(*group_cols, F.col(y).alias("lab"))
              .union(df.select(*group_cols, F.col(yhat).alias("lab"))).distinct())
    # labels x labels per group: bounded by (number of classes)^2
    grid = labels.withColumnRenamed("lab", y).join(
        labels.withColumnRenamed("lab", yhat), list(group_cols)) if group_cols else \
        labels.withColumnRenamed("lab", y).crossJoin(labels.withColumnRenamed("lab", yhat))
    return grid.join(counts, [*group_cols, y, yhat], "left").select(
        *group_cols, y, yhat, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def log_loss(df: DataFrame, p: str, y: str, group_cols=()) -> DataFrame:
    """M3: mean of -log(p[y] + 1e-9) and accuracy of argmax."""
    py = F.element_at(F.col(p), F.col(y) + 1)
    r = F.transform(F.col(p), lambda x: F.round(x, 9))
    pred = F.array_position(r, F.array_max(r)) - 1
    return df.groupBy(*group_cols).agg(
        F.avg(-F.log(py + F.lit(EPS))).alias("log_loss"),
        F.avg((pred == F.col(y)).cast("double")).alias("accuracy"))


def one_vs_rest(df: DataFrame, p: str, y: str, k: int, group_cols=()) -> DataFrame:
    """E5: rows ``(class, score, is_pos)`` for each class of a probability vector."""
    g = [F.col(c) for c in group_cols]
    e = df.select(*g, F.col(y), F.posexplode(F.col(p)).alias("cls", "score"))
    return e.select(*g, F.col("cls").cast("int").alias("cls"), "score",
                    (F.col(y) == F.col("cls")).alias("is_pos"))


def _roc_base(scored: DataFrame, group: str, bucket) -> DataFrame:
    """Distinct scores per group with positives/negatives strictly above.

    The ordering is split in two levels so no task sees a whole group: a tiny
    ``(group, bucket)`` table gives the counts above each bucket, then ranks
    inside each ``(group, bucket)`` finish the prefix sums.
    """
    s = bucket(scored) if callable(bucket) else scored.withColumn("_bk", bucket)
    d = s.groupBy(group, "_bk", "score").agg(
        F.sum(F.col("is_pos").cast("long")).alias("pos"),
        F.sum((~F.col("is_pos")).cast("long")).alias("neg"))
    bt = d.groupBy(group, "_bk").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = Window.partitionBy(group).orderBy(F.col("_bk").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    wt = Window.partitionBy(group)
    bt = bt.select(group, "_bk",
                   F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_pa"),
                   F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_na"),
                   F.sum("_bp").over(wt).alias("P"), F.sum("_bn").over(wt).alias("N"))
    # (group, bucket) offsets: at most n_groups * n_buckets rows
    d = d.join(F.broadcast(bt), [group, "_bk"])
    wi = Window.partitionBy(group, "_bk").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    return d.select(group, "_bk", "score", "pos", "neg", "P", "N",
                    (F.col("_pa") + F.coalesce(F.sum("pos").over(wi), F.lit(0))).alias("pos_above"),
                    (F.col("_na") + F.coalesce(F.sum("neg").over(wi), F.lit(0))).alias("neg_above"))


def prob_bucket(score: Column, buckets: int = 1024) -> Column:
    """Fixed-width bucket of a score in [0, 1]."""
    return F.least(F.greatest(F.floor(score * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")


def value_bucket(scored: DataFrame, buckets: int = 1024):
    """Quantile buckets of an unbounded score: boundaries come from
    approxQuantile (only ``buckets`` numbers reach the driver, never rows) and
    a Bucketizer assigns rows by binary search."""
    from pyspark.ml.feature import Bucketizer
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(scored.approxQuantile("score", probs, 1.0 / (4 * buckets))))
    if not bounds:  # no score at all
        return lambda df: df.withColumn("_bk", F.lit(0))
    splits = [float("-inf")] + [float(b) for b in bounds] + [float("inf")]

    def apply(df: DataFrame) -> DataFrame:
        b = Bucketizer(splits=splits, inputCol="score", outputCol="_bkd", handleInvalid="keep")
        return b.transform(df).withColumn("_bk", F.col("_bkd").cast("int")).drop("_bkd")
    return apply


def roc_points(scored: DataFrame, group: str = "cls", bucket=None,
               drop_intermediate: bool = True) -> DataFrame:
    """ROC points per group, as a ROC curve routine reports them: a
    leading ``(0, 0)`` point at threshold +inf, then one point per distinct
    score in descending order; with ``drop_intermediate`` a point is dropped
    when the next point adds the same positives and negatives (collinear
    steps), except the first and the last.

    The next point of the last score in a bucket is the first point of the
    next lower bucket, taken from a (group, bucket) table (bounded, broadcast)
    so no window spans a whole group.  Buckets default to approximate score
    quantiles; ``prob_bucket`` gives fixed-width buckets without that pass.
    """
    b = _roc_base(scored, group, bucket if bucket is not None else value_bucket(scored))
    pts = b.select(group, F.col("score").alias("threshold"),
                   F.try_divide(F.col("pos_above") + F.col("pos"), F.col("P")).alias("tpr"),
                   F.try_divide(F.col("neg_above") + F.col("neg"), F.col("N")).alias("fpr"),
                   "pos", "neg", "pos_above", "neg_above", "_bk")
    if drop_intermediate:
        w = Window.partitionBy(group, "_bk").orderBy(F.col("threshold").desc())
        pts = pts.select("*", F.lead("pos").over(w).alias("_np"), F.lead("neg").over(w).alias("_nn"))
        firsts = pts.groupBy(group, "_bk").agg(
            F.max_by(F.struct("pos", "neg"), "threshold").alias("_f"))
        wb = Window.partitionBy(group).orderBy(F.col("_bk").desc())
        # one row per (group, bucket): the first point of the next lower bucket
        nxt = firsts.select(group, "_bk", F.lead("_f").over(wb).alias("_nf"))
        pts = pts.join(F.broadcast(nxt), [group, "_bk"])
        np_, nn_ = F.coalesce("_np", F.col("_nf.pos")), F.coalesce("_nn", F.col("_nf.neg"))
        first = (F.col("pos_above") == 0) & (F.col("neg_above") == 0)
        keep = first | np_.isNull() | (np_ != F.col("pos")) | (nn_ != F.col("neg"))
        pts = pts.filter(keep)
    pts = pts.select(group, "threshold", "tpr", "fpr")
    origin = b.select(group, "P", "N").distinct().select(
        group, F.lit(float("inf")).alias("threshold"),
        F.try_divide(F.lit(0.0), F.col("P")).alias("tpr"), F.try_divide(F.lit(0.0), F.col("N")).alias("fpr"))
    return origin.unionByName(pts)


def auc(scored: DataFrame, group: str = "cls", bucket=None) -> DataFrame:
    """Trapezoid area under the ROC per group (ties count one half)."""
    b = _roc_base(scored, group, bucket if bucket is not None else value_bucket(scored))
    return b.groupBy(group).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)),
                     F.first("P") * F.first("N")).alias("auc"),
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))


def pooled_scores(df: DataFrame, class_col: str, score_col: str) -> DataFrame:
    """Distinct scores of one pool of rows, whatever the number of classes:
    ``score, n, classes`` (array of class and count), ``_pid`` (ranges of
    falling score) and ``n_above``, the rows with a larger score.

    Rows are counted per (score, class) before anything else; distinct scores
    are range-partitioned and ranked by a small table of partition sums."""
    from ..session import materialize
    counts = (df.select(F.col(class_col).alias("cls"), F.col(score_col).alias("score"))
              .filter("score IS NOT NULL AND cls IS NOT NULL").groupBy("score", "cls").agg(F.count(F.lit(1)).alias("c")))
    pool = counts.groupBy("score").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("cls", "c"))).alias("classes"))
    pool = materialize(pool.repartitionByRange(F.col("score").desc()).withColumn("_pid", F.spark_partition_id()), "score_pool")
    sums = pool.groupBy("_pid").agg(F.sum("n").alias("_n"))  # one row a partition
    above = sums.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    w = Window.partitionBy("_pid").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (pool.join(F.broadcast(above), "_pid")
            .withColumn("n_above", F.col("_above") + F.coalesce(F.sum("n").over(w), F.lit(0))).drop("_above"))


def auc_by_class(df: DataFrame, class_col: str, score_col: str, out: str = "cls") -> DataFrame:
    """E7 for one score and many classes: AUC of the score for each class
    against the rest, by the rank sum over the pooled scores (ties count one
    half).  Every row is counted once; nothing is multiplied by the classes."""
    pool = pooled_scores(df, class_col, score_col)
    # rows above a row of this score, its ties counted half
    e = pool.select((F.col("n_above") + F.col("n") / 2.0).alias("above"), F.explode("classes").alias("k"))
    r = e.groupBy(F.col("k.cls").alias(out)).agg(F.sum(F.col("k.c") * F.col("above")).alias("_s"),
                                                 F.sum("k.c").alias("n_pos"))
    total = r.agg(F.sum("n_pos").alias("_t"))
    r = r.crossJoin(F.broadcast(total)).withColumn("n_neg", F.col("_t") - F.col("n_pos"))  # one row
    # of the rows above, those of the class itself add up to n_pos^2 / 2
    above_neg = F.col("_s") - F.col("n_pos") * F.col("n_pos") / 2.0
    return r.select(out, (1.0 - F.try_divide(above_neg, F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def roc_by_class(df: DataFrame, class_col: str, score_col: str, out: str = "cls") -> DataFrame:
    """E6 for one score and many classes: the points ``roc_points`` gives, from
    one pool of distinct scores.

    A step that adds the same positives and negatives as the next is dropped, so
    between two of its own scores a class keeps points only where the pool's
    counts change: a score is paired with the classes it or the next score
    holds, and with all classes only at such a change and at both ends."""
    pool = pooled_scores(df, class_col, score_col)
    none = F.array().cast(pool.schema["classes"].dataType)
    w = Window.partitionBy("_pid").orderBy(F.col("score").desc())
    tops = pool.groupBy("_pid").agg(F.max_by(F.struct("n", "classes"), "score").alias("_top"))
    nxt = tops.select("_pid", F.lead("_top").over(Window.orderBy("_pid")).alias("_next"))  # one row a partition
    pool = (pool.withColumn("_lead", F.lead(F.struct("n", "classes")).over(w)).join(F.broadcast(nxt), "_pid")
            .withColumn("_lead", F.coalesce("_lead", "_next")).drop("_next"))
    sizes = pool.select(F.explode("classes").alias("k")).groupBy(F.col("k.cls").alias("cls")).agg(F.sum("k.c").alias("P"))
    every = sizes.agg(F.collect_list("cls").alias("_all"), F.sum("P").alias("_t"))  # the result has a row for each
    names = lambda c: F.transform(c, lambda k: k["cls"])
    ends = (F.col("n_above") == 0) | F.col("_lead").isNull() | (F.col("_lead.n") != F.col("n"))
    near = F.array_union(names(F.col("classes")), names(F.coalesce(F.col("_lead.classes"), none)))
    rows = pool.crossJoin(F.broadcast(every)).withColumn("cls", F.explode(F.when(ends, F.col("_all")).otherwise(near)))
    count = lambda c: F.coalesce(F.get(F.filter(c, lambda k: k["cls"] == F.col("cls")), F.lit(0))["c"], F.lit(0))
    rows = rows.select("cls", "_pid", "score", "n", "n_above", "_t", count(F.col("classes")).alias("pos"),
                       F.col("_lead.n").alias("n_next"), count(F.col("_lead.classes")).alias("pos_next"))
    per = pool.select("_pid", F.explode("classes").alias("k")).groupBy(
        F.col("k.cls").alias("cls"), "_pid").agg(F.sum("k.c").alias("_in"))
    # positives of each class in the partitions above: one row a class and partition
    grid = sizes.select("cls", "P").join(F.broadcast(tops.select("_pid")), how="cross").join(per, ["cls", "_pid"], "left")
    grid = grid.select("cls", "_pid", "P", F.coalesce(F.sum("_in").over(Window.partitionBy("cls").orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = Window.partitionBy("cls", "_pid").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(grid, ["cls", "_pid"]).withColumn("tp", F.col("_before") + F.sum("pos").over(run))
    step = (F.col("pos") != F.col("pos_next")) | ((F.col("n") - F.col("pos")) != (F.col("n_next") - F.col("pos_next")))
    kept = rows.filter((F.col("n_above") == 0) | F.col("n_next").isNull() | step)
    points = kept.select(F.col("cls").alias(out), F.col("score").alias("threshold"),
                         F.try_divide(F.col("tp"), F.col("P")).alias("tpr"),
                         F.try_divide(F.col("n_above") + F.col("n") - F.col("tp"), F.col("_t") - F.col("P")).alias("fpr"))
    total = sizes.agg(F.sum("P").alias("_t"))
    origin = sizes.crossJoin(F.broadcast(total)).select(
        F.col("cls").alias(out), F.lit(float("inf")).alias("threshold"), F.try_divide(F.lit(0.0), F.col("P")).alias("tpr"),
        F.try_divide(F.lit(0.0), F.col("_t") - F.col("P")).alias("fpr"))
    return origin.unionByName(points)


def improvement(hyb: Column, lex: Column) -> Column:
    """Relative gain in percent, 0 when the base is 0."""
    return F.when(lex != 0, (hyb - lex) / lex * 100.0).otherwise(0.0)


def stage_share(df: DataFrame, run: str, stage: str, duration: str) -> DataFrame:
    """Share of each stage in its run's total (total floored at 0.001)."""
    per = df.groupBy(run, stage).agg(F.sum(duration).alias("stage_ms"))
    tot = F.sum("stage_ms").over(Window.partitionBy(run))
    return per.withColumn("share", F.col("stage_ms") / F.greatest(tot, F.lit(0.001)))


def dataset_info(df: DataFrame, n_features: int, domain_col: str = "registered_domain",
                 approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A3 + A12: rows, feature count and distinct domains in one aggregate;
    ``approx`` uses a HyperLogLog++ sketch (no shuffle of distinct keys)."""
    distinct = (F.approx_count_distinct(domain_col, rsd) if approx else F.countDistinct(domain_col))
    return df.agg(F.count(F.lit(1)).alias("dataset_size"),
                  F.lit(n_features).cast("long").alias("num_features"),
                  distinct.alias("num_domains"))
