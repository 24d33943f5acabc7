"""Probability fusion and alpha selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALPHA_GRID
from ..functions.probs import argmax, blend, renormalise, round_vec
from . import metrics


def graph_prob_columns(df: DataFrame, k: int) -> list[str]:
    """``domain_class_{i}_prob`` columns, else ``R_graph_class_{i}``."""
    for pattern in ("domain_class_{}_prob", "R_graph_class_{}"):
        cols = [pattern.format(i) for i in range(k)]
        if all(c in df.columns for c in cols):
            return cols
    raise KeyError(f"Graph probability columns not found in dataset. Expected {cols}")


def align_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with the score columns of another table, by ``key``
    (unique in ``scores``), and ``has_scores``; a key of many rows stays spread."""
    from .skew import skew_safe_left_join
    s = scores.withColumn("has_scores", F.lit(True))
    j = skew_safe_left_join(df, s, key, None, F.xxhash64(*[F.col(c) for c in df.columns]))
    return j.withColumn("has_scores", F.coalesce("has_scores", F.lit(False)))


def fused_prediction(df: DataFrame, p_lex: str, p_graph: str, alpha, out: str = "p_final") -> DataFrame:
    """F1 + G8: blend the lexical vector with the renormalised graph vector;
    ``pred`` is the argmax of the blend rounded to 9 digits (ties to first)."""
    p = blend(p_lex, renormalise(p_graph), alpha)
    return df.withColumn(out, p).withColumn("pred", argmax(round_vec(out)))


def alpha_search(val: DataFrame, p_lex: str, p_graph: str, y: str, alphas=ALPHA_GRID) -> DataFrame:
    """F2: validation macro F1 per alpha in one job.

    The validation rows are crossed with the (fixed, tiny) alpha grid, one
    grouped metrics aggregate scores all alphas; ``is_best`` marks the first
    alpha reaching the highest F1 (strict improvement wins, as in a loop).
    """
    grid = val.sparkSession.createDataFrame([(float(a), i) for i, a in enumerate(alphas)],
                                            "alpha double, alpha_pos int")
    x = val.crossJoin(F.broadcast(grid))
    x = x.withColumn("pred", argmax(round_vec(blend(p_lex, renormalise(p_graph), F.col("alpha")))))
    s = metrics.summary(x, y, "pred", ["alpha", "alpha_pos"])
    # ranking over at most len(alphas) rows
    w = Window.orderBy(F.col("macro_f1").desc(), F.col("alpha_pos"))
    return s.select("alpha", "alpha_pos", F.col("macro_f1").alias("validation_macro_f1"),
                    (F.row_number().over(w) == 1).alias("is_best"))


def best_alpha(search: DataFrame) -> DataFrame:
    return search.filter("is_best").select(
        F.col("alpha").alias("best_alpha"), F.col("validation_macro_f1").alias("validation_best_f1"))


def fusion_report(scored: DataFrame, p_lex: str, p_graph: str, y: str, split_col: str = "split",
                  alpha: float | None = None, alphas=ALPHA_GRID) -> tuple[DataFrame, DataFrame]:
    """F2 + F3: (alpha search table, one-row test summary with the best alpha).
    A given ``alpha`` skips the search (grid of one)."""
    grid = [alpha] if alpha is not None else list(alphas)
    search = alpha_search(scored.filter(F.col(split_col) == "val"), p_lex, p_graph, y, grid)
    best = best_alpha(search)
    test = scored.filter(F.col(split_col) == "test").crossJoin(F.broadcast(best))  # one row
    test = test.withColumn("pred", argmax(round_vec(blend(p_lex, renormalise(p_graph),
                                                          F.col("best_alpha")))))
    summ = metrics.summary(test, y, "pred", ["best_alpha", "validation_best_f1"]).select(
        "best_alpha", "validation_best_f1", F.col("macro_f1").alias("test_f1"),
        F.col("accuracy").alias("test_accuracy"), "n_rows")
    return search, summ
