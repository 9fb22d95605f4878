"""Aggregates of series and groups: totals, ratios, medians, shares, histograms, winners and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(df: DataFrame, value: str, out: str, digits: int) -> DataFrame:
    """One row: the sum, 0 for no rows."""
    return df.agg(F.coalesce(F.round(F.sum(value), digits), F.lit(0.0)).alias(out))


def rounded_count(df: DataFrame, wanted: Column, per: float, out: str) -> DataFrame:
    """One row: how many rows are wanted, divided by `per` and rounded to a whole number."""
    return df.agg(F.round(F.count_if(wanted) / F.lit(per)).cast("long").alias(out))


def duplicate_groups(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """keys and n of groups of more rows than that."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def summary(df: DataFrame, keys: list[str], value: str, wanted: Column, named: str) -> DataFrame:
    """keys, n, how many rows are wanted (under that name), and mean, least and most of the values."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(wanted).alias(named), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def plausible_median(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    """keys and the median of the values between two bounds (neither included); 0 without any."""
    inside = F.when((F.col(value) > low) & (F.col(value) < high), F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.median(inside), F.lit(0.0)).alias(out))


def mean_and_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean and population variance."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def tumbling_means(df: DataFrame, keys: list[str], us: str, width: int, value: str, window: str) -> DataFrame:
    """keys, number of the window of `width` microseconds, and mean."""
    return df.groupBy(*keys, F.floor(F.col(us) / F.lit(float(width))).alias(window)).agg(F.avg(value).alias("mean"))


def tumbling_totals(df: DataFrame, us: str, width: int, value: str, window: str) -> DataFrame:
    """Number of each window of `width` microseconds, its rows n and their total."""
    return df.groupBy(F.floor(F.col(us) / F.lit(float(width))).alias(window)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """keys and the mean of value by weight; null where the weights sum to 0."""
    w = F.sum(weight)
    return df.groupBy(*keys).agg(F.when(w != 0, F.sum(F.col(value) * F.col(weight)) / w).alias(out))


def motion_statistics(df: DataFrame, keys: list[str], value: str, above: float) -> DataFrame:
    """keys, mean, peak, population deviation, 95th percentile, and the percentage of values above a level."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("peak"), F.stddev_pop(value).alias("deviation"), F.percentile(value, F.lit(0.95)).alias("p95"),
        (100.0 * F.count_if(F.col(value) > above) / F.count("*")).alias("coverage"),
    )


def energy_shares(df: DataFrame, band: str, value: str) -> DataFrame:
    """band and its share of the mean squares of all bands; shares are 0 where all is silent. Bands are a handful."""
    power = df.groupBy(band).agg(F.avg(F.col(value) * F.col(value)).alias("_s"))
    all_ = F.sum("_s").over(Window.partitionBy())
    return power.select(band, F.when(all_ > 0, F.col("_s") / all_).otherwise(0.0).alias("share"))


def percentile_scale(df: DataFrame, keys: list[str], value: str, share: float = 0.95, least: float = 1e-6) -> DataFrame:
    """keys and scale, the percentile of the positive values; 1 where that is `least` or under."""
    p = F.percentile(value, F.lit(share))
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.when(p <= least, F.lit(1.0)).otherwise(p).alias("scale"))


def tertiles(df: DataFrame, keys: list[str], value: str, names: tuple[str, str, str], out: str) -> DataFrame:
    """Rows with the name of the third of their series that the value lies in; an edge belongs to the upper one."""
    edges = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.33)).alias("_a"), F.percentile(value, F.lit(0.66)).alias("_b"))
    rows = df.join(edges, keys)
    return rows.withColumn(out, F.when(F.col(value) < F.col("_a"), names[0]).when(F.col(value) < F.col("_b"), names[1]).otherwise(names[2])).drop("_a", "_b")


def winner(df: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """keys, the item of the highest score (of equals the smaller item) as best, and that score."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    at = F.min(F.when(F.col(score) == F.col("_top"), F.col(item)))
    return df.join(top, keys).groupBy(*keys).agg(at.alias("best"), F.max(score).alias(score))


def most_common(df: DataFrame, keys: list[str], item: str, out: str) -> DataFrame:
    """keys and the item that stands most often; of equals the last in the order of names."""
    n = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max(F.struct("_n", item))[item].alias(out))


def ratio(df: DataFrame, keys: list[str], wanted: Column, out: str) -> DataFrame:
    """keys and the share of wanted rows."""
    return df.groupBy(*keys).agg(F.avg(F.when(wanted, 1.0).otherwise(0.0)).alias(out))


def fixed_histogram(df: DataFrame, keys: list[str], value: str, edges: list[int], beyond: int) -> DataFrame:
    """keys, bucket (its upper edge, which belongs to it) and n; higher values count under `beyond`."""
    b = F.lit(beyond)
    for e in reversed(edges):
        b = F.when(F.col(value) <= e, F.lit(e)).otherwise(b)
    return df.groupBy(*keys, b.alias("bucket")).agg(F.count("*").alias("n"))


def precedence(df: DataFrame, keys: list[str], state: str, order: list[tuple[str, str]], otherwise: str, out: str) -> DataFrame:
    """keys and the name of the first state in the order that a row of the key has."""
    got = F.lit(otherwise)
    for code, name in reversed(order):
        got = F.when(F.max((F.col(state) == code).cast("int")) == 1, F.lit(name)).otherwise(got)
    return df.groupBy(*keys).agg(got.alias(out))


def phase_contrast(df: DataFrame, keys: list[str], us: str, width: int, phases: int, value: str) -> DataFrame:
    """keys, ratio of the best phase's mean to the mean of all phases that show rows, and that phase; of equals the later."""
    phase = F.floor(F.col(us) / F.lit(float(width))) % phases
    m = df.groupBy(*keys, phase.alias("phase")).agg(F.avg(value).alias("_m"))
    out = m.groupBy(*keys).agg(F.max(F.struct("_m", "phase")).alias("_b"), F.avg("_m").alias("_mean"))
    return out.select(*keys, F.when(F.col("_mean") > 0, F.col("_b._m") / F.col("_mean")).alias("ratio"), F.col("_b.phase").alias("phase"))


def top_bins(df: DataFrame, keys: list[str], value: str, width: float, take: int) -> DataFrame:
    """keys, bin, n of the `take` fullest bins of a width; of equals the lower."""
    n = df.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "bin"))
    return n.withColumn("_rk", rank).where(F.col("_rk") <= take).drop("_rk")


def top_by_variance(df: DataFrame, key: str, value: str, take: int) -> DataFrame:
    """The `take` keys of the highest population variance, with it; of equals the smaller key."""
    return df.groupBy(key).agg(F.var_pop(value).alias("variance")).orderBy(F.desc("variance"), key).limit(take)


def typed_gap(df: DataFrame, kind: str, seq: str, evicted: int, seen: int) -> DataFrame:
    """kind and gap: whether an event of that kind after `seen` is among those evicted, which are numbered up to `evicted`."""
    return df.where(F.col(seq) <= evicted).groupBy(kind).agg((F.max(seq) > seen).alias("gap"))
