"""Aggregates over blocks of an ordered series: fixed sizes, equal counts, representative points, stride pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key profiles of twelve pitch classes. Fixed values.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Head start of minor keys.
MINOR_PRIOR = 0.075


def by_size(df: DataFrame, idx: str, size: int, keys: list[str], keep_tail: bool = True) -> DataFrame:
    """Add block, idx // size; without keep_tail an incomplete last block goes."""
    out = df.withColumn("block", F.floor(F.col(idx) / size))
    if keep_tail:
        return out
    n = F.count("*").over(Window.partitionBy(*keys, "block"))
    return out.withColumn("_n", n).where(F.col("_n") == size).drop("_n")


def by_count(df: DataFrame, idx: str, count: int, keys: list[str]) -> DataFrame:
    """Add block for `count` blocks of equal whole size; rows past the last one go, and series of fewer rows than blocks."""
    size = F.floor(F.count("*").over(Window.partitionBy(*keys)) / count)
    out = df.withColumn("_size", size).where(F.col("_size") > 0).withColumn("block", F.floor(F.col(idx) / F.col("_size")))
    return out.where(F.col("block") < count).drop("_size")


def by_edges(df: DataFrame, idx: str, most: int, keys: list[str]) -> DataFrame:
    """Add block for at most `most` blocks whose edges are floor(i * n / most); shorter series keep each row."""
    n = F.count("*").over(Window.partitionBy(*keys))
    m = F.least(n, F.lit(most))
    return df.withColumn("_n", n).withColumn("_m", m).withColumn("block", F.ceil((F.col(idx) + 1) * F.col("_m") / F.col("_n")) - 1).drop("_n", "_m")


def stride_pairs(df: DataFrame, keys: list[str], idx: str, value: str, stride: int) -> DataFrame:
    """Each stride-th row with the change up to the next one."""
    w = Window.partitionBy(*keys).orderBy(idx)
    picked = df.where(F.col(idx) % stride == 0)
    return picked.withColumn("change", F.abs(F.lead(value).over(w) - F.col(value))).where(F.col("change").isNotNull())


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """keys and median: the first value at which the summed weight reaches half of the total."""
    w = Window.partitionBy(*keys)
    run = F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).withColumn("_all", F.sum(weight).over(w)).where(F.col("_run") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("median"))


def octave_folded(value: Column, reference: Column, factors: tuple[float, ...] = (0.5, 1.0, 2.0)) -> Column:
    """value divided by the factor that brings it nearest to the reference, the first of equals."""
    options = F.array(*[F.struct(F.abs(value / f - reference).alias("d"), F.lit(i).alias("i"), (value / f).alias("v")) for i, f in enumerate(factors)])
    return F.array_min(options)["v"]


def pearson(a, b) -> Column:
    """Correlation of two arrays of one size; null without variance."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = F.zip_with(a, b, lambda x, y: x * y)
    sa, sb = total(a), total(b)
    va, vb = n * total(F.transform(a, lambda x: x * x)) - sa * sa, n * total(F.transform(b, lambda x: x * x)) - sb * sb
    return F.when((va > 0) & (vb > 0), (n * total(product) - sa * sb) / F.sqrt(va * vb))


def best_key(chroma: Column) -> Column:
    """Struct (key, correlation) of the best of the 24 rotated profiles; minor ones get a head start, the first of equals wins."""
    tries = []
    for i, note in enumerate(NOTES):
        for mode, profile, prior in (("major", MAJOR, 0.0), ("minor", MINOR, MINOR_PRIOR)):
            turned = F.array(*[F.lit(profile[(j - i) % 12]) for j in range(12)])
            tries.append(F.struct((pearson(chroma, turned) + prior).alias("r"), F.lit(-len(tries)).alias("first"), F.lit(f"{note} {mode}").alias("key")))
    best = F.array_max(F.array(*tries))
    return F.struct(F.when(best["r"].isNull(), "C major").otherwise(best["key"]).alias("key"), best["r"].alias("correlation"))


def hex_channel(color: Column, at: int) -> Column:
    """Two hex digits at a position (from 1) as a number."""
    return F.conv(F.substring(color, at, 2), 16, 10).cast("double")


def hsv(color: Column) -> Column:
    """Struct (saturation, brightness, warmth) of a colour of six hex digits; what isn't one gives null."""
    r, g, b = (hex_channel(color, at) for at in (1, 3, 5))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    out = F.struct(F.when(high > 0, (high - low) / high).otherwise(0.0).alias("saturation"), (high / 255).alias("brightness"), ((r - b) / 255).alias("warmth"))
    return F.when(color.rlike("^[0-9a-fA-F]{6}$"), out)


def within_minus_between(df: DataFrame, keys: list[str], side: str, vec: str) -> DataFrame:
    """Mean similarity inside the two sides of a cut less that across it, from sums: no pair of rows is made.

    The mean inner product of two groups is the inner product of their mean vectors.
    """
    x = df.select(*keys, side, F.posexplode(vec).alias("_i", "_x"))
    mean = x.groupBy(*keys, "_i").agg(F.avg(F.when(F.col(side) == 0, F.col("_x").cast("double"))).alias("a"), F.avg(F.when(F.col(side) == 1, F.col("_x").cast("double"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return mean.groupBy(*keys).agg((0.5 * (F.sum(a * a) + F.sum(b * b)) - F.sum(a * b)).alias("contrast"))
