"""Cleaning, labelling and projection operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_IDS, FEATURE_COLS, SPLIT_SEED

# fixed value: scheme prefix removed by the serving normaliser
SCHEME_PREFIX = r"(?i)^https?://(www\.)?"


def resolve_target(df: DataFrame) -> str:
    """Name of the class column: ``target``, else ``label``."""
    for c in ("target", "label"):
        if c in df.columns:
            return c
    raise ValueError("Target column not found in dataset.")


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Columns {missing} must be present.")


def coin(key: Column, seed: str = SPLIT_SEED) -> Column:
    """Deterministic fair coin from md5(seed || key): partition independent."""
    return F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 1) >= F.lit("8")


def bias_fix(df: DataFrame, url_col: str = "url", type_col: str = "type",
             seed: str = SPLIT_SEED) -> DataFrame:
    """Give benign URLs without a scheme ``https://www.`` or ``http://``."""
    u = F.col(url_col)
    need = (F.col(type_col) == "benign") & ~u.startswith("http")
    fixed = F.when(coin(u, seed), F.concat(F.lit("https://www."), u)).otherwise(
        F.concat(F.lit("http://"), u))
    return df.withColumn(url_col, F.when(need, fixed).otherwise(u))


def scheme_share(df: DataFrame, url_col: str = "url", type_col: str = "type") -> DataFrame:
    """Share of URLs starting with ``http`` among benign / other rows."""
    return (df.groupBy((F.col(type_col) == "benign").alias("is_benign"))
            .agg(F.avg(F.col(url_col).startswith("http").cast("double")).alias("share_with_scheme"),
                 F.count(F.lit(1)).alias("n_rows")))


def validate_and_clean(df: DataFrame, url_col: str = "url", type_col: str = "type") -> DataFrame:
    """Required columns, no null url/type, url as string, no blank url."""
    require_columns(df, [url_col, type_col])
    return (df.dropna(subset=[url_col, type_col])
            .withColumn(url_col, F.col(url_col).cast("string"))
            .filter(F.col(url_col).rlike(r"(?U)\S")))


def encode_target(df: DataFrame, type_col: str = "type", out_col: str = "target") -> DataFrame:
    """C4: lower/strip the label, map to the class id, drop unknown labels."""
    t = F.regexp_replace(F.lower(F.col(type_col)), r"(?U)^\s+|\s+$", "")
    mapping = F.create_map(*[x for k, v in CLASS_IDS.items() for x in (F.lit(k), F.lit(v))])
    return (df.withColumn(type_col, t)
            .withColumn(out_col, mapping[F.col(type_col)].cast("int"))
            .filter(F.col(out_col).isNotNull()))


def normalise_url(c) -> Column:
    """Drop a leading http(s):// (and www. after it), then trailing '/'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, SCHEME_PREFIX, ""), "/+$", "")


def project_features(df: DataFrame, feature_cols=FEATURE_COLS, fill: float | None = None) -> DataFrame:
    """Select a model's feature list; absent columns are an error
    unless ``fill`` is given, then they are added as constants."""
    missing = [c for c in feature_cols if c not in df.columns]
    if missing and fill is None:
        raise KeyError(f"Missing feature columns: {missing}")
    return df.select(*[F.col(c) if c in df.columns else F.lit(float(fill)).alias(c)
                       for c in feature_cols])


def drop_non_features(df: DataFrame) -> DataFrame:
    """Drop label and raw columns."""
    return df.drop("target", "label", "url", "type")


def class_filter(df: DataFrame, class_name: str, target_col: str = "target") -> DataFrame:
    """Rows of one class, by name."""
    return df.filter(F.col(target_col) == F.lit(CLASS_IDS[class_name]))
