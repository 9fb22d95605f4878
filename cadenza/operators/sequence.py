"""Ordered-event operators: spacing, grouping, smoothing, peaks, islands, retention.

Folds run piece by piece (see folds.py); what a window can say is said by a window over the series.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded, pieces, stretches_of
from .spans import framed, running_sum


def _order(keys: list[str], *by) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def stretches(df: DataFrame, keys: list[str], at: str, tie: str, pause, inclusive: bool, out: str = "_stretch") -> DataFrame:
    """Number the stretches of each series; a gap of more than pause (inclusive: or equal) opens one."""
    def opens(w):
        gap = F.col(at) - F.lag(at).over(w)
        return {"_new": F.coalesce(((gap >= pause) if inclusive else (gap > pause)).cast("int"), F.lit(0))}

    return running_sum(framed(df, keys, [at, tie], 1, opens), keys, [at, tie], "_new", out).drop("_new")


def _types(df: DataFrame, columns: list[str]) -> str:
    return df.select(*columns).schema.simpleString()[len("struct<") : -1]


def min_interval(df: DataFrame, keys: list[str], at: str, tie: str, strength: str, least) -> DataFrame:
    """Keep events at least `least` apart; a stronger one inside the gap replaces the kept one and moves the anchor.

    Events of one instant come in the order of tie. Rows without an instant go; a null strength is never stronger.
    """
    rest = [at, tie, strength, *[c for c in df.columns if c not in (*keys, at, tie, strength)]]

    def step(rows):
        kept = None
        for r in rows:
            if kept is None:
                kept = r
            elif r[0] - kept[0] >= least:
                yield kept
                kept = r
            elif r[2] is not None and (kept[2] is None or r[2] > kept[2]):
                kept = r
        if kept is not None:
            yield kept

    cut = pieces(df.select(*keys, *rest).where(F.col(at).isNotNull()), keys, at, least, inclusive=True)
    return folded(cut, keys, [at, tie], step, _types(df, rest), "_piece").select(*df.columns)


def anchored_groups(df: DataFrame, keys: list[str], at: str, tie: str, reach) -> DataFrame:
    """Groups whose members lie within `reach` of the group's first: keys, first_at, mean_at (double), n."""

    def step(rows):
        first, total, n = None, 0.0, 0
        for t, _ in rows:
            if first is not None and t - first <= reach:
                total, n = total + t, n + 1
                continue
            if first is not None:
                yield first, total / n, n
            first, total, n = t, float(t), 1
        if first is not None:
            yield first, total / n, n

    cut = pieces(df.select(*keys, at, tie).where(F.col(at).isNotNull()), keys, at, reach, inclusive=False)
    return folded(cut, keys, [at, tie], step, f"first_at {dict(df.dtypes)[at]}, mean_at double, n long", "_piece")


def running_mean_groups(df: DataFrame, keys: list[str], at: str, tie: str, reach: float) -> DataFrame:
    """Groups whose next member lies within `reach` of the running mean: keys, mean_at, n."""

    def step(rows):
        mean, n = 0.0, 0
        for t, _ in rows:
            if n and t - mean <= reach:
                n += 1
                mean += (t - mean) / n
                continue
            if n:
                yield mean, n
            mean, n = float(t), 1
        if n:
            yield mean, n

    cut = pieces(df.select(*keys, at, tie).where(F.col(at).isNotNull()), keys, at, reach, inclusive=False)
    return folded(cut, keys, [at, tie], step, "mean_at double, n long", "_piece")


def to_intervals(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Each event up to the next one as end_at; the last of a series, which has no end, goes."""
    return df.withColumn("end_at", F.lead(at).over(_order(keys, at, tie))).where(F.col("end_at") > F.col(at))


def auto_split(df: DataFrame, start: str, end: str, most) -> DataFrame:
    """Cut intervals longer than `most` into ceil(length / most) equal parts: part, part_start and part_end (doubles)."""
    n = F.ceil((F.col(end) - F.col(start)) / F.lit(most)).cast("int")
    n = F.greatest(n, F.lit(1))
    width = (F.col(end) - F.col(start)) / n
    out = df.withColumn("_n", n).withColumn("_w", width).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("part_start", F.col(start) + F.col("part") * F.col("_w")).withColumn("part_end", F.col(start) + (F.col("part") + 1) * F.col("_w")).drop("_n", "_w")


def indexed(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Add idx, the position in the series from 0."""
    return df.withColumn("idx", (F.row_number().over(_order(keys, *by)) - 1).cast("long"))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """Centred mean of an odd width whose edges are padded with zeros: the divisor stays the width."""
    half = width // 2
    return framed(df, keys, [order], half, lambda w: {out: F.sum(value).over(w.rowsBetween(-half, half)) / width})


def min_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Scale to 0..1 within the series; a constant series gives 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, least: float) -> DataFrame:
    """Rows above both neighbours and at `least`; ends are never maxima."""
    marked = framed(df, keys, [order], 1, lambda w: {"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)})
    return marked.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= least)).drop("_a", "_b")


def runs(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Merge neighbours of one label: keys, label, first, last, n."""
    changes = framed(df, keys, [order], 1, lambda w: {"_c": F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))})
    out = running_sum(changes, keys, [order], "_c", "_run")
    return out.groupBy(*keys, "_run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def islands(df: DataFrame, keys: list[str], idx: str, value: str, above: float, gap: int) -> DataFrame:
    """Peaks of the stretches above a level: index gaps of more than `gap` part them, the first highest row of each stays."""
    high = df.where(F.col(value) > above)
    cut = stretches(high, keys, idx, idx, gap, inclusive=False)
    best = cut.groupBy(*keys, "_stretch").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(idx)).alias("i"))).alias("b"), F.count("*").alias("n"))
    return best.select(*keys, (-F.col("b.i")).alias("idx"), F.col("b.v").alias("peak"), "n")


def evict_oldest(df: DataFrame, keys: list[str], size: str, by: list[str], limit: float) -> DataFrame:
    """Rows to remove, oldest first, until what is left fits the limit."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(size).over(_order(keys, *by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.where(F.lit(True)).withColumn("_left", F.sum(size).over(w) - before).where(F.col("_left") > limit).drop("_left")


def round_robin(df: DataFrame, bucket: str, score: str, tie: str, limit: int) -> DataFrame:
    """Take rows from all buckets in turn, the bucket of the highest score first: pick numbers the rows from 1.

    The best `limit` rows of each bucket are taken before the buckets meet, so the meeting is bounded
    by buckets times limit.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc(score), tie))).where(F.col("_rn") <= limit)
    top = Window.partitionBy(bucket)
    ranked = ranked.withColumn("_max", F.max(score).over(top))
    order = ["_rn", F.desc("_max"), bucket]
    first = ranked.orderBy(*order).limit(limit)
    return first.withColumn("pick", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("_rn", "_max")


def suppress(df: DataFrame, keys: list[str], at: str, tie: str, strength: str, apart) -> DataFrame:
    """Greedy suppression by strength: the strongest stays, all within `apart` of it go, and so on; ties to the earlier.

    Stretches with pauses of `apart` or more can't touch each other and are solved apart, many in a pass.
    """

    def step(rows):
        for stretch in stretches_of(rows, apart, inclusive=True):
            kept: list = []
            stays = []
            for t, i, s in sorted(stretch, key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1])):
                j = bisect_left(kept, t)
                if (j == 0 or t - kept[j - 1] >= apart) and (j == len(kept) or kept[j] - t >= apart):
                    insort(kept, t)
                    stays.append((t, i, s))
            yield from sorted(stays, key=lambda r: r[:2])

    columns = [at, tie, strength]
    cut = pieces(df.select(*keys, *columns).where(F.col(at).isNotNull()), keys, at, apart, inclusive=True)
    return folded(cut, keys, [at, tie], step, _types(df, columns), "_piece")
