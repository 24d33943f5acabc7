"""Leak-free class reputation of keys with hierarchical fallback.

Statistics are learnt on ``split == 'train'`` rows only and mapped back to
every row: per key class counts and probabilities (one hash aggregate with
``sum(when)`` per class: partial aggregation before the shuffle, no pivot
pass), per parent key class probabilities, global class priors; unseen keys
fall back key -> parent -> global.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys_of, skew_safe_left_join


def class_index(class_col: str, classes) -> Column:
    """Map class values to their 0-based position in ``classes``."""
    expr = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(classes))):
        expr = F.when(F.col(class_col) == F.lit(c), F.lit(i)).otherwise(expr)
    return expr


def class_distribution(df: DataFrame, class_col: str) -> DataFrame:
    """A1: rows per class."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_rows"))


def class_priors(train: DataFrame, class_col: str, classes) -> DataFrame:
    """A2: one row ``prior_0..prior_k`` (normalised class counts)."""
    n = F.count(F.lit(1))
    return train.agg(*[F.try_divide(F.sum((F.col(class_col) == F.lit(c)).cast("long")), n).alias(f"prior_{i}")
                       for i, c in enumerate(classes)])


def key_class_stats(train: DataFrame, key: str, class_col: str, classes, prefix: str) -> DataFrame:
    """Per key ``{prefix}_n``, ``{prefix}_cnt_i``, ``{prefix}_prob_i``,
    ``{prefix}_entropy`` (absent classes count 0)."""
    cnts = [F.sum((F.col(class_col) == F.lit(c)).cast("long")).alias(f"{prefix}_cnt_{i}")
            for i, c in enumerate(classes)]
    s = train.groupBy(key).agg(F.count(F.lit(1)).alias(f"{prefix}_n"), *cnts)
    probs = [(F.col(f"{prefix}_cnt_{i}") / F.col(f"{prefix}_n")).alias(f"{prefix}_prob_{i}")
             for i in range(len(classes))]
    s = s.select("*", *probs)
    terms = [F.when(F.col(f"{prefix}_prob_{i}") > 0,
                    F.col(f"{prefix}_prob_{i}") * F.log2(F.col(f"{prefix}_prob_{i}"))).otherwise(0.0)
             for i in range(len(classes))]
    return s.withColumn(f"{prefix}_entropy", -reduce(lambda a, b: a + b, terms) + F.lit(0.0))


def fit_reputation(train: DataFrame, key: str, parent: str, class_col: str, classes) -> dict:
    """Learn the statistics tables from train rows with ONE pass over them.

    The rows are aggregated once by ``(key, parent)`` (partial aggregation
    before the shuffle; the result has about one row per key) and written
    under the checkpoint directory; key, parent and global statistics are
    small roll-ups of that table.  Returns DataFrames ``dom``, ``par``,
    ``pri`` (priors + ``_total``).
    """
    from ..session import materialize
    k = len(classes)
    cnts = [F.sum((F.col(class_col) == F.lit(c)).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)]
    pairs = materialize(train.groupBy(key, parent).agg(F.count(F.lit(1)).alias("n"), *cnts), "rep_pairs")

    def roll(by, prefix):
        s = pairs.groupBy(by).agg(F.sum("n").alias(f"{prefix}_n"),
                                  *[F.sum(f"c{i}").alias(f"{prefix}_cnt_{i}") for i in range(k)])
        s = s.select("*", *[(F.col(f"{prefix}_cnt_{i}") / F.col(f"{prefix}_n")).alias(f"{prefix}_prob_{i}")
                            for i in range(k)])
        terms = [F.when(F.col(f"{prefix}_prob_{i}") > 0,
                        F.col(f"{prefix}_prob_{i}") * F.log2(F.col(f"{prefix}_prob_{i}"))).otherwise(0.0)
                 for i in range(k)]
        return s.withColumn(f"{prefix}_entropy", -reduce(lambda a, b: a + b, terms) + F.lit(0.0))

    dom = roll(key, "dom")
    par = roll(parent, "par").select(parent, *[f"par_prob_{i}" for i in range(k)])
    tot = pairs.agg(F.sum("n").alias("_total"), *[F.sum(f"c{i}").alias(f"_c{i}") for i in range(k)])
    pri = tot.select("_total", *[F.try_divide(F.col(f"_c{i}"), F.col("_total")).alias(f"prior_{i}")
                                 for i in range(k)])
    return {"dom": dom, "par": par, "pri": pri}


def apply_reputation(df: DataFrame, stats: dict, key: str, parent: str, k: int,
                     spread: Column | None = None, hot_fraction: float = 1e-4) -> DataFrame:
    """Map learnt statistics onto every row with the fallback chain
    key -> parent -> global (J1-J3)."""
    if spread is None:
        spread = F.xxhash64(*[F.col(c) for c in df.columns])
    pri = stats["pri"]
    hot = hot_keys_of(df, [key, parent], hot_fraction)
    out = skew_safe_left_join(df, stats["dom"], key, "dom_n", spread, hot_fraction, hot[key])
    # the parent key is the hottest there is (a suffix, a nation): same join
    out = skew_safe_left_join(out, stats["par"], parent, None, F.xxhash64(spread), hot_fraction, hot[parent])
    out = out.crossJoin(F.broadcast(pri.drop("_total")))  # one row
    cols = [F.coalesce(F.col("dom_n"), F.lit(0)).cast("long").alias("domain_frequency"),
            F.coalesce(F.col("dom_entropy"), F.lit(0.0)).alias("domain_class_entropy")]
    for i in range(k):
        tld_p = F.coalesce(F.col(f"par_prob_{i}"), F.col(f"prior_{i}"))
        dom_p = F.coalesce(F.col(f"dom_prob_{i}"), tld_p)
        cols += [F.coalesce(F.col(f"dom_cnt_{i}"), F.lit(0)).cast("long").alias(f"domain_class_{i}_count"),
                 tld_p.alias(f"tld_class_{i}_prob"),
                 dom_p.alias(f"domain_class_{i}_prob"),
                 dom_p.alias(f"R_graph_class_{i}")]
    return out.select(*[F.col(c) for c in df.columns], *cols)


def reputation(df: DataFrame, key: str, parent: str, class_col: str, classes,
               split_col: str = "split", train_value: str = "train",
               spread: Column | None = None, hot_fraction: float = 1e-4) -> DataFrame:
    """Append the reputation table columns to every row of ``df``.

    Statistics come from ``split == train`` rows only (leak-free).  Column
    names follow the reputation table: ``domain_frequency``,
    ``domain_class_entropy``, and per class i ``domain_class_{i}_count``,
    ``tld_class_{i}_prob``, ``domain_class_{i}_prob``, ``R_graph_class_{i}``.
    """
    train = df.filter(F.col(split_col) == F.lit(train_value)).select(key, parent, class_col)
    stats = fit_reputation(train, key, parent, class_col, classes)
    return apply_reputation(df, stats, key, parent, len(classes), spread, hot_fraction)


def reputation_columns(k: int) -> list[str]:
    cols = ["domain_frequency", "domain_class_entropy"]
    for i in range(k):
        cols += [f"domain_class_{i}_count", f"tld_class_{i}_prob", f"domain_class_{i}_prob",
                 f"R_graph_class_{i}"]
    return cols
