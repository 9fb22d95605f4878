"""Windows over the ordered rows of a series: peaks, neighbours, contrasts, changes, fusion, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import framed


def _order(keys: list[str], by: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def sliding_peaks(df: DataFrame, keys: list[str], by: list[str], value: str, reach: int, above: float = 0.0) -> DataFrame:
    """Rows whose value is over `above` and the highest of `reach` rows to either side; equal ones all stay."""
    tops = framed(df, keys, by, reach, lambda w: {"_top": F.max(value).over(w.rowsBetween(-reach, reach))})
    return tops.where((F.col(value) == F.col("_top")) & (F.col(value) > above)).drop("_top")


def segments(df: DataFrame, keys: list[str], by: list[str], at: str, start: str, end: str, origin: Column) -> DataFrame:
    """Each boundary as the end of the segment that began at the boundary before, the first at the origin."""
    return framed(df, keys, by, 1, lambda w: {start: F.coalesce(F.lag(at).over(w), origin), end: F.col(at)})


def beyond_retention(df: DataFrame, keys: list[str], by: list[str], at: str, oldest: Column, newest: int) -> DataFrame:
    """Rows to drop: older than `oldest`, or past the `newest` latest of their key. Rows without an instant stay."""
    back = _order(keys, [F.desc(c) for c in by])
    known = df.where(F.col(at).isNotNull())
    return known.withColumn("_rn", F.row_number().over(back)).where((F.col(at) < oldest) | (F.col("_rn") > newest)).drop("_rn")


def side_contrast(df: DataFrame, keys: list[str], by: list[str], value: str, reach: int, out: str) -> DataFrame:
    """Mean of the `reach` rows from here on less the mean of the `reach` rows before; null for the first row."""
    return framed(df, keys, by, reach, lambda w: {out: F.avg(value).over(w.rowsBetween(0, reach - 1)) - F.avg(value).over(w.rowsBetween(-reach, -1))})


def change(df: DataFrame, keys: list[str], by: list[str], value: str, out: str) -> DataFrame:
    """Distance to the value before; null for the first row of a series."""
    return framed(df, keys, by, 1, lambda w: {out: F.abs(F.col(value) - F.lag(value).over(w))})


def summed_change(df: DataFrame, keys: list[str], part: str, by: list[str], value: str, out: str) -> DataFrame:
    """keys and the sum of all changes within each part (a stem); the first rows of parts add nothing."""
    return change(df, [*keys, part], by, value, "_c").groupBy(*keys).agg(F.sum("_c").alias(out))


def fused(df: DataFrame, keys: list[str], weights: dict[str, float], out: str) -> DataFrame:
    """Weighted sum of curves, each divided by its series' maximum; a curve whose maximum isn't positive adds nothing."""
    w = Window.partitionBy(*keys)
    top = lambda c: F.max(c).over(w)
    return df.withColumn(out, sum((F.when(top(c) > 0, share * F.col(c) / top(c)).otherwise(0.0) for c, share in weights.items()), F.lit(0.0)))


def against_past(df: DataFrame, keys: list[str], by: list[str], value: str, reach: int, rise: float, fall: float, out: str) -> DataFrame:
    """'drop' where a value exceeds `rise` times the mean of the `reach` rows before, 'break' under `fall` times it, else 'none'."""
    rows = framed(df, keys, by, reach, lambda w: {"_past": F.avg(value).over(w.rowsBetween(-reach, -1))})
    return rows.withColumn(out, F.when(F.col(value) > rise * F.col("_past"), "drop").when(F.col(value) < fall * F.col("_past"), "break").otherwise("none")).drop("_past")


def cyclic(df: DataFrame, keys: list[str], by: list[str], count: int, out: str) -> DataFrame:
    """Running number modulo count."""
    return df.withColumn(out, (F.row_number().over(_order(keys, by)) - 1) % count)


def without_oldest(df: DataFrame, keys: list[str], by: list[str], share: float) -> DataFrame:
    """Rows of each key without its oldest floor(n * share)."""
    rows = df.withColumn("_rn", F.row_number().over(_order(keys, by))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.col("_rn") > F.floor(F.col("_n") * share)).drop("_rn", "_n")


def split_means(df: DataFrame, keys: list[str], by: list[str], value: str, count: int) -> DataFrame:
    """keys, bucket (from 1) and mean of `count` buckets of neighbours, of which the first ones hold one row more."""
    b = F.ntile(count).over(_order(keys, by)).cast("long")
    return df.withColumn("bucket", b).groupBy(*keys, "bucket").agg(F.avg(value).alias("mean"))


def scaled_by_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Values divided by their series' maximum; unchanged where that isn't positive."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(top > 0, F.col(value) / top).otherwise(F.col(value)))


def latest(df: DataFrame, keys: list[str], by: list[str], count: int = 1) -> DataFrame:
    """The last `count` rows of each key."""
    return df.withColumn("_rn", F.row_number().over(_order(keys, [F.desc(c) for c in by]))).where(F.col("_rn") <= count).drop("_rn")


def turns(df: DataFrame, keys: list[str], by: list[str], out: str) -> DataFrame:
    """Place of each row in its key's order, from 1."""
    return df.withColumn(out, F.row_number().over(_order(keys, by)))
