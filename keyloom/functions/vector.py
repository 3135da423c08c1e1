"""Exact vector distances as built-in column expressions, and top-k search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.errors import bad_value


def _wide(v: Column | Sequence[float]) -> Column:
    if isinstance(v, Column):
        return F.transform(v, lambda x: x.cast("double"))
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def inner_product(a: Column, b: Column | Sequence[float]) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column | Sequence[float]) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Null for a zero vector."""
    norm2 = inner_product(a, a) * inner_product(_wide(b), _wide(b))
    return F.when(norm2 > 0, inner_product(a, b) / F.sqrt(norm2))


# name -> (expression, whether a larger value is nearer)
METRICS = {"inner_product": (inner_product, True), "l2": (l2_squared, False), "cosine": (cosine, True)}


def knn(df: DataFrame, vec: str, query: Sequence[float], k: int, *, key: Sequence[str], metric: str = "cosine", score: str = "score", digits: int | None = 6) -> DataFrame:
    """The k nearest rows with their score; ties by key. Planned as one top-k per partition
    and a merge of k rows each; vectors of another length and nulls are left out."""
    if metric not in METRICS:
        raise bad_value(f"unknown metric {metric}")
    f, descending = METRICS[metric]
    s = f(F.col(vec), list(query))
    if digits is not None:
        s = F.round(s, digits)
    scored = df.where(F.size(vec) == len(query)).withColumn(score, s).where(F.col(score).isNotNull())
    return scored.orderBy(F.col(score).desc() if descending else F.col(score).asc(), *key).limit(k)
