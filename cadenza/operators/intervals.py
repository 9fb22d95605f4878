"""Joins of points and intervals: containment, as-of, nearest, bands, overlaps.

Containment is an equi-join on time buckets with the exact test behind it. As-of and nearest joins
merge both sides into one ordered stream and carry the last seen row along, which makes no pairs; long
series are dealt to spans of time, and what a span ends with is carried to the next ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int, how: str = "left") -> DataFrame:
    """points with the interval [start, end) that holds them, the first by start where several do.

    Intervals are listed in the buckets they touch; `bucket` should be near their usual length.
    Columns of intervals besides keys come along, null where nothing holds the point.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    i = intervals.where(F.col(end) > F.col(start))
    i = i.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    extra = [c for c in intervals.columns if c not in keys]
    first = i.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct(start, end, *[c for c in extra if c not in (start, end)]))).alias("_list"))
    joined = p.join(first, [*keys, "_b"], "left")
    hit = F.try_element_at(F.filter("_list", lambda x: (x[start] <= F.col(at)) & (F.col(at) < x[end])), F.lit(1))
    out = joined.withColumn("_hit", hit).drop("_b", "_list")
    if how == "inner":
        out = out.where(F.col("_hit").isNotNull())
    return out.select(*[c for c in out.columns if c != "_hit"], *[F.col("_hit")[c].alias(c) for c in extra])


def _merged(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, values: list[str]) -> DataFrame:
    """Both sides in one: _t, _side (right rows first), _l and _r."""
    l, r = F.struct(*[F.col(c) for c in left.columns]), F.struct(r_at, *values)
    none = lambda df, x: F.lit(None).cast(df.select(x.alias("x")).schema["x"].dataType)
    lt = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), l.alias("_l"), none(right, r).alias("_r"))
    rt = right.select(*keys, F.col(r_at).alias("_t"), F.lit(0).alias("_side"), none(left, l).alias("_l"), r.alias("_r"))
    return lt.unionByName(rt.where(F.col(r_at).isNotNull()))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, values: list[str], direction: str = "backward", rows: int | None = None) -> DataFrame:
    """left with r_at and values of the last right row at or before `at` (forward: the first at or after).

    Equal right times should be made unique by the caller. Rows without a match get nulls, as do left
    rows without an instant; right rows without one go. Beyond `rows` (spans.ROWS) rows the series are dealt to spans,
    so a key may hold all of them.
    """
    merged = _merged(left, right, keys, at, r_at, values)
    out = spans.carried(merged, keys, "_t", "_side", "_r", spans.edges(merged, "_t", rows), **{direction: "_m"})
    match = F.when(F.col("_t").isNotNull(), F.col("_m"))
    return out.where(F.col("_l").isNotNull()).select("_l.*", match[r_at].alias(r_at), *[match[v].alias(v) for v in values])


def _beside(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, values: list[str], rows: int | None) -> DataFrame:
    """left with _back and _next, the structs of the right rows on both sides; one at the same instant is both."""
    merged = _merged(left, right, keys, at, r_at, values)
    out = spans.carried(merged, keys, "_t", "_side", "_r", spans.edges(merged, "_t", rows), "_back", "_next")
    known = lambda c: F.when(F.col("_t").isNotNull(), F.col(c)).alias(c)
    return out.where(F.col("_l").isNotNull()).select("_l.*", known("_back"), known("_next"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, later_wins: bool = False, rows: int | None = None) -> DataFrame:
    """left with r_at of the nearest right row and its distance; of two equally near ones the earlier (or later) wins. Spans as in as_of()."""
    both = _beside(left, right, keys, at, r_at, [], rows)
    back, after = F.col("_back")[r_at], F.col("_next")[r_at]
    db, dn = F.col(at) - back, after - F.col(at)
    use_next = back.isNull() | (after.isNotNull() & ((dn <= db) if later_wins else (dn < db)))
    out = both.withColumn(r_at, F.when(use_next, after).otherwise(back))
    return out.withColumn("distance", F.abs(F.col(at) - F.col(r_at))).drop("_back", "_next")


def band(left: DataFrame, right: DataFrame, keys: list[str], at: str, r_at: str, reach: int, agg) -> DataFrame:
    """left joined with aggregates of the right rows within `reach`: right rows are listed in the two or three buckets they touch."""
    r = right.withColumn("_b", F.explode(F.sequence(F.floor((F.col(r_at) - reach) / reach), F.floor((F.col(r_at) + reach) / reach))))
    l = left.withColumn("_b", F.floor(F.col(at) / reach))
    pairs = l.join(r, [*keys, "_b"]).where(F.abs(F.col(at) - F.col(r_at)) <= reach)
    return pairs.groupBy(*left.columns).agg(agg)


def interpolated(points: DataFrame, anchors: DataFrame, keys: list[str], at: str, a_at: str, value: str, out: str = "interpolated", rows: int | None = None) -> DataFrame:
    """points with the value on the line between the anchors before and after; outside of the anchors the nearest one's value. Spans as in as_of()."""
    both = _beside(points, anchors, keys, at, a_at, [value], rows)
    t0, v0, t1, v1 = F.col("_back")[a_at], F.col("_back")[value], F.col("_next")[a_at], F.col("_next")[value]
    line = v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0)
    inside = t0.isNotNull() & t1.isNotNull() & (t1 > t0)
    return both.withColumn(out, F.when(inside, line).otherwise(F.coalesce(v0, v1))).drop("_back", "_next")


def accepted(anchors: DataFrame, keys: list[str], start: str, tie: str, end: str) -> DataFrame:
    """Intervals taken in order of start, but for those that overlap the last one taken. Rows pass one by one."""
    from .folds import folded
    from .sequence import _types

    columns = [start, end, tie, *[c for c in anchors.columns if c not in (*keys, start, end, tie)]]

    def step(rows):
        last = None
        for r in rows:
            if last is None or r[0] >= last[1]:
                yield r
                last = r

    return folded(anchors.select(*keys, *columns), keys, [start, tie], step, _types(anchors, columns)).select(*anchors.columns)
