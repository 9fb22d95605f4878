"""Vector search over a table of vectors: exact top-k, exclusions, post-filters, hybrid scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dot


def query_vector(df: DataFrame, vec: str, where: Column) -> list[float]:
    """One stored vector, brought to the driver as the parameter of a search."""
    row = df.where(where).select(vec).first()
    if row is None:
        raise ValueError("no such vector")
    return [float(x) for x in row[0]]


def scored(df: DataFrame, vec: str, query: list[float], out: str = "score") -> DataFrame:
    """Add the inner product with a query in double precision."""
    q = F.array(*[F.lit(x) for x in query])
    return df.withColumn(out, dot(F.col(vec), q))


def top_k(df: DataFrame, vec: str, query: list[float], k: int, tie: str, allowed: Column | None = None) -> DataFrame:
    """The k highest scores among allowed rows; each task keeps k rows before any of them move."""
    rows = df if allowed is None else df.where(allowed)
    return scored(rows, vec, query).orderBy(F.desc("score"), tie).limit(k)


def nearest_l2(df: DataFrame, vec: str, query: list[float], k: int, tie: str, post_filter: Column | None = None) -> DataFrame:
    """The k nearest rows by distance; a post_filter acts on those k, so that fewer may be left."""
    q = F.array(*[F.lit(x) for x in query])
    diff = F.zip_with(F.col(vec), q, lambda x, y: x.cast("double") - y)
    out = df.withColumn("distance", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))).orderBy("distance", tie).limit(k)
    return out if post_filter is None else out.where(post_filter)


def softmax(df: DataFrame, keys: list[str], score: str, out: str = "p") -> DataFrame:
    """Shares of exp(score) within each key, taken from the key's maximum."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn(out, e / F.sum(e).over(w))
