"""Sections of a long curve: where the means before and after a sample differ most, which of these changes stay, and what lies between.

All of it works on blocks with halos and on sums of two levels, so one curve may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.windows import shared_folder
from .sequence import suppress
from .spans import blockwise, haloed

BLOCK = 65_536


def widths(step: float, context_s: float = 60.0) -> tuple[int, int, int]:
    """Samples of the smoothing mean, of a context, and between two boundaries, for samples `step` seconds apart."""
    samples = lambda s: max(1, round(s / step))
    return samples(2.0), samples(min(8.0, context_s / 4)), samples(15.0)


def contrasts(df: DataFrame, keys: list[str], idx: str, value: str, smooth: int, context: int, block: int = BLOCK) -> DataFrame:
    """keys, idx, smoothed, left, right, contrast and peak of every sample of curves whose idx counts from 0.

    smoothed is the mean of `smooth` samples around, with the end samples repeated beyond the ends. left
    and right are the means of the `context` smoothed samples before and from here on, contrast their
    distance; samples nearer than that to an end have none. peak marks contrasts that no neighbour's exceeds.
    """
    back = smooth // 2
    ahead = smooth - 1 - back
    rows = haloed(df.select(*keys, idx, F.col(value).cast("double").alias("_v")), idx, block, smooth + context + 1)
    whole = Window.partitionBy(*keys, "_block")
    w = whole.orderBy(idx)
    total = lambda c, first, last: F.sum(c).over(w.rowsBetween(first, last))

    # every frame is added up by itself: equal means then stay equal, which differences of running sums don't
    p = rows.withColumn("_low", F.min(F.struct(idx, "_v")).over(whole)).withColumn("_high", F.max(F.struct(idx, "_v")).over(whole))
    before = F.greatest(F.col("_low")[idx] - (F.col(idx) - back), F.lit(0)) * F.col("_low")["_v"]
    after = F.greatest(F.col(idx) + ahead - F.col("_high")[idx], F.lit(0)) * F.col("_high")["_v"]
    s = p.withColumn("smoothed", (total("_v", -back, ahead) + before + after) / smooth)
    inside = (F.col(idx) >= context) & F.lead(idx, context).over(w).isNotNull()
    left = F.when(inside, total("smoothed", -context, -1) / context)
    right = F.when(inside, total("smoothed", 0, context - 1) / context)
    s = s.withColumn("left", left).withColumn("right", right).withColumn("contrast", F.abs(F.col("right") - F.col("left")))
    c = F.col("contrast")
    peak = c.isNotNull() & F.coalesce(c >= F.lag("contrast").over(w), F.lit(True)) & F.coalesce(c >= F.lead("contrast").over(w), F.lit(True))
    return s.withColumn("peak", peak).where("_own").select(*keys, idx, "smoothed", "left", "right", "contrast", "peak")


def sections(df: DataFrame, keys: list[str], idx: str, value: str, step: float, context_s: float = 60.0, block: int = BLOCK) -> DataFrame:
    """keys, section (from 0), first, last (sample numbers, last exclusive), label, energy and confidence of the sections of each curve.

    Boundaries are peaks of contrast at 15 % of the smoothed curve's range or 35 % of its deviation and
    above; the strongest stays, of equals the later, and those within 15 seconds of it go. A quiet first
    section before a rise is an intro, a quiet last one after a fall an outro, all others are sections.
    energy is the section's mean, confidence the greater relative contrast of its boundaries, 1 at most.
    Rows without a value are read as 0, rows without a key go. Empty tables give an empty result.
    """
    smooth, context, apart = widths(step, context_s)
    rows = df.select(*keys, idx, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"))
    path = f"{shared_folder(df.sparkSession)}/contrasts"
    contrasts(rows, keys, idx, "_value", smooth, context, block).write.parquet(path)  # read four times below
    c = df.sparkSession.read.parquet(path)
    stats = c.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max("smoothed").alias("_max"), F.avg("smoothed").alias("_mean"),
        (F.max("smoothed") - F.min("smoothed")).alias("_range"), F.stddev_pop("smoothed").alias("_dev"),
    )
    least = F.greatest(F.col("_range") * 0.15, F.col("_dev") * 0.35, F.lit(1e-8))
    stats = stats.select(
        *keys, "_n", least.alias("_least"), F.greatest("_range", F.lit(1e-8)).alias("_scale"),
        F.greatest(0.08 * F.greatest("_max", F.lit(1e-8)), 0.25 * F.col("_mean")).alias("_quiet"),
    )
    peaks = c.where("peak").join(stats, keys).where(F.col("contrast") >= F.col("_least"))
    peaks = peaks.select(*keys, (-F.col(idx)).alias("_at"), (-F.col(idx)).alias("_tie"), (F.col("contrast") / F.col("_scale")).alias("_strength"))
    kept = suppress(peaks, keys, "_at", "_tie", "_strength", apart).select(*keys, (-F.col("_at")).alias(idx), "_strength")
    kept = kept.join(c.select(*keys, idx, "left", "right"), [*keys, idx])

    w = Window.partitionBy(*keys).orderBy("first")
    zero = F.lit(0).cast("long")
    starts = stats.select(*keys, zero.alias("first")).unionByName(kept.select(*keys, F.col(idx).cast("long").alias("first"), "_strength", "left", "right"), allowMissingColumns=True)
    parts = starts.join(stats, keys).withColumn("last", F.coalesce(F.lead("first").over(w), F.col("_n")))
    parts = parts.withColumn("_own", F.when(F.col("_strength").isNotNull(), F.least("_strength", F.lit(1.0))))  # least() passes over nulls
    for name, column in (("_next", "_own"), ("_left", "left"), ("_right", "right")):
        parts = parts.withColumn(name, F.lead(column).over(w))
    parts = parts.withColumn("section", F.row_number().over(w) - 1)
    # each section's samples are added up by themselves, from the last on, block by block: a section is told from its block's later ones by the boundaries down to there
    marks = kept.select(*keys, idx, F.lit(None).cast("double").alias("smoothed"), F.lit(1).alias("_mark"))
    placed = c.select(*keys, idx, "smoothed", F.lit(0).alias("_mark")).unionByName(marks).withColumn("_block", F.floor(F.col(idx) / block))
    down = Window.partitionBy(*keys, "_block").orderBy(F.desc(idx), "_mark").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.withColumn("_nth", F.sum("_mark").over(down)).groupBy(*keys, "_block", "_nth").agg(F.sum("smoothed").alias("_sum"))
    order = Window.partitionBy(*keys).orderBy("_block", F.desc("_nth"))
    sums = sums.withColumn("_new", F.when(F.lag("_block").over(order) == F.col("_block"), 1).otherwise(0))
    number = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("section", number.cast("int")).groupBy(*keys, "section").agg(F.sum("_sum").alias("_sum"))
    parts = parts.join(sums, [*keys, "section"])
    parts = parts.withColumn("energy", F.col("_sum") / (F.col("last") - F.col("first"))).withColumn("_before", F.lag("energy").over(w))
    intro = (F.col("first") == 0) & (F.col("_left") <= F.col("_quiet")) & (F.col("_right") >= F.col("_left") + F.col("_least"))
    outro = (F.col("last") == F.col("_n")) & (F.col("energy") <= F.col("_quiet")) & (F.col("_before") >= F.col("energy") + F.col("_least"))
    label = F.when(outro, "outro").when(intro, "intro").otherwise("section")
    confidence = F.coalesce(F.greatest("_own", "_next"), F.lit(0.0))
    return parts.select(*keys, "section", "first", "last", label.alias("label"), "energy", confidence.alias("confidence"))


def tapered(size: int) -> list[float]:
    """Weights of an even number of positions around a change: minus before, plus after, under a Gaussian of a deviation of a quarter of the size."""
    from math import exp

    return [(-1 if k < size // 2 else 1) * exp(-((k - (size - 1) / 2) ** 2) / (2 * (size / 4) ** 2)) for k in range(size)]


def kernel_novelty(df: DataFrame, keys: list[str], idx: str, vec: str, weights: list[float], padded: bool = True, block: int = 8192) -> DataFrame:
    """keys, idx and novelty: the sum of a checkerboard kernel laid on the matrix of cosines around each position of series whose idx counts from 0.

    The kernel is the product of `weights` with themselves, so the sum over the matrix is the squared
    length of one weighted sum of unit vectors, and no matrix is built. That sum runs over the size/2
    positions before and as many from here on, block by block. Beyond the ends stand the end vectors
    (padded), or positions that near to them have 0. Null vectors and those of length 0 have no direction.
    """
    import numpy as np

    size = len(weights)
    half = size // 2
    kernel = np.array(weights)

    def work(table):
        import pyarrow as pa

        rows = table.column("_vec").to_pylist()
        at = table.column(idx).to_numpy()
        dims = max((len(r) for r in rows if r), default=0)
        x = np.array([[v or 0.0 for v in r] if r else [0.0] * dims for r in rows], "float64").reshape(len(rows), dims)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        n = len(at)
        long = np.concatenate([np.repeat(x[:1], half, 0), x, np.repeat(x[-1:], half, 0)])
        total = np.zeros_like(x)
        for k in range(size):
            total += kernel[k] * long[k : k + n]
        found = (total**2).sum(1)
        if not padded:
            # only a series' own ends lack neighbours: a block's ends are other blocks' rows
            found[(at - at[0] < half) | (at[-1] - at < half)] = 0.0
        return [pa.array(found)]

    rows = df.select(*keys, idx, F.col(vec).cast("array<double>").alias("_vec"))
    return blockwise(rows, keys, idx, ["_vec"], block, half, work, "novelty double")
