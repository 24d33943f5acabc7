"""Probability-vector column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASSES, EPS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prob_array(cols) -> Column:
    return F.array(*[_c(c).cast("double") for c in cols])


def prob_columns(p, prefix: str, k: int = len(CLASSES)) -> list[Column]:
    p = _c(p)
    return [F.element_at(p, i + 1).alias(f"{prefix}_{i}") for i in range(k)]


def vsum(p) -> Column:
    return F.aggregate(_c(p), F.lit(0.0), lambda a, x: a + x)


def renormalise(p, eps: float = EPS) -> Column:
    """``p / (sum(p) + eps)``."""
    p = _c(p)
    s = vsum(p)
    return F.transform(p, lambda x: x / (s + F.lit(eps)))


def normalise_exact(p) -> Column:
    """F5 serving step: ``p / sum(p)``."""
    p = _c(p)
    s = vsum(p)
    return F.transform(p, lambda x: x / s)


def blend(p_lex, p_graph, alpha) -> Column:
    """``alpha * p_lex + (1 - alpha) * p_graph`` element-wise."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(_c(p_lex), _c(p_graph), lambda x, y: a * x + (F.lit(1.0) - a) * y)


def round_vec(p, digits: int = 9) -> Column:
    return F.transform(_c(p), lambda x: F.round(x, digits))


def argmax(p) -> Column:
    """U8: index of the largest probability, ties to the first."""
    p = _c(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(p) -> Column:
    """Max probability in percent."""
    return F.array_max(_c(p)) * 100.0


def class_name(idx) -> Column:
    """Class name of a class index (NULL for a NULL index)."""
    idx = _c(idx)
    return F.when(idx.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), idx + 1))


def prob_map(p) -> Column:
    """Class name -> probability."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in CLASSES]), _c(p))
