"""Curves and feature series: novelty, peaks, segmentation, phases, clusters.

What a window or a sum can say is said in DataFrame functions. Dynamic programmes and fixpoints run
with NumPy on one recording at a time, after blocks.by_edges() has bounded its points.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import suppress


def novelty(df: DataFrame, keys: list[str], idx: str, vec: str, reach: int) -> DataFrame:
    """keys, idx and novelty: how far the mean of the `reach` rows from here on lies from that of the `reach` rows before.

    The sum of a checkerboard kernel over the similarity matrix is the squared distance of these two
    means, so neither a matrix nor a pair of rows is made. Vectors count with length one; ends give 0.
    """
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    x = df.select(*keys, idx, norm.alias("_n"), F.posexplode(vec).alias("_i", "_x"))
    x = x.withColumn("_x", F.when(F.col("_n") > 0, F.col("_x").cast("double") / F.col("_n")).otherwise(0.0))
    w = Window.partitionBy(*keys, "_i").orderBy(idx)
    before, after = w.rowsBetween(-reach, -1), w.rowsBetween(0, reach - 1)
    x = x.withColumn("_d", F.avg("_x").over(after) - F.avg("_x").over(before))
    return x.groupBy(*keys, idx).agg(F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("novelty"))


def picked_peaks(df: DataFrame, keys: list[str], idx: str, value: str, apart: int) -> DataFrame:
    """Local maxima at the series' median plus standard deviation or above, at least `apart` rows from a higher one."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(idx)
    level = df.groupBy(*keys).agg((F.median(value) + F.stddev_pop(value)).alias("_level"))
    m = df.withColumn("_a", F.lag(value).over(o)).withColumn("_b", F.lead(value).over(o)).join(level, keys)
    peaks = m.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= F.col("_level")))
    return suppress(peaks.select(*keys, idx, F.col(idx).alias("_tie"), value), keys, idx, "_tie", value, apart).drop("_tie")


def prominent(curve: list[float], apart: int, least: float) -> list[int]:
    """Peaks of a curve, none within `apart` of a higher one, that rise by `least` over the higher of the valleys beside them.

    A plateau peaks in its middle; a valley reaches to the next higher value or the end. Peaks nearer
    than `apart` to either end go.
    """
    n, peaks, i = len(curve), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and curve[j + 1] == curve[i]:
            j += 1
        if j < n - 1 and curve[i - 1] < curve[i] > curve[j + 1]:
            peaks.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(peaks, key=lambda p: (-curve[p], -p)):
        at = bisect_left(kept, p)
        if (at == 0 or p - kept[at - 1] >= apart) and (at == len(kept) or kept[at] - p >= apart):
            kept.insert(at, p)
    valley = [_valleys(curve), _valleys(curve[::-1])[::-1]]
    return [p for p in kept if curve[p] - max(v[p] for v in valley) >= least and apart <= p < n - apart]


def _valleys(curve: list[float]) -> list[float]:
    """The least value from each place back to the last higher one, in one pass."""
    out, higher = [], []  # (value, least since the one below it)
    for x in curve:
        low = x
        while higher and higher[-1][0] <= x:
            low = min(low, higher.pop()[1])
        higher.append((x, low))
        out.append(low)
    return out


def prominence_peaks(df: DataFrame, keys: list[str], idx: str, value: str, apart: int, least: float) -> DataFrame:
    """keys and idx of the prominent() peaks of each curve; a curve is one recording and bounded by its length."""
    from .folds import folded

    def step(rows):
        held = list(rows)
        yield from ((held[p][0],) for p in prominent([r[1] for r in held], apart, least))

    return folded(df.select(*keys, idx, F.col(value).cast("double").alias("_v")), keys, [idx], step, f"{idx} {dict(df.dtypes)[idx]}")


def band_pass(x: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """A sound run forward and backward through a Butterworth band-pass: no phase shift, and the squared magnitude of one pass.

    Taken over the spectrum: the digital filter's response is that of the analogue one at the tangent of
    half the frequency. The sound is mirrored at both ends, so that they don't ring into each other.
    """
    if len(x) < 2:
        return np.zeros(len(x))
    ends = np.clip([low / (rate / 2), high / (rate / 2)], 0.001, 0.999)
    a, b = np.tan(np.pi / 2 * ends)
    long = np.concatenate([2 * x[0] - x[:0:-1], x, 2 * x[-1] - x[-2::-1]])
    w = np.tan(np.pi * np.minimum(np.fft.rfftfreq(len(long)), 0.4999999))
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + ((w * w - a * b) / ((b - a) * w)) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(long) * gain, len(long))[len(x) - 1 : 2 * len(x) - 1]


def band_passed(df: DataFrame, samples: str, rate: str, low: float, high: float, out: str, order: int = 4) -> DataFrame:
    """Add band_pass() of each row's samples at its rate; a row is a window of the sound source. Null samples give null."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else band_pass(np.asarray(v, "float64"), float(f), low, high, order).astype("float32") for v, f in zip(x, r, strict=True)], dtype=object)

    return df.withColumn(out, run(samples, rate))


def partition_cuts(unit: np.ndarray, low: int, high: int, penalty: float, scale: float = 1.0) -> list[int]:
    """Cuts of the best split into pieces of low..high rows: a piece is worth its summed similarities over its length, a cut costs the penalty.

    Each start whose best value is known offers a piece to all ends it can reach, at once.
    """
    n = len(unit)
    sums = np.concatenate([np.zeros((1, unit.shape[1])), unit.cumsum(0)]) if n else np.zeros((1, 1))
    worth = np.full(n + 1, -np.inf)
    worth[0] = 0.0
    starts: dict[int, int] = {}
    for i in range(n - low + 1 if n >= 2 * low else 0):
        reach = slice(i + low, min(i + high, n) + 1)
        if worth[i] == -np.inf:
            continue
        lengths = np.arange(low, low + len(worth[reach]))
        # summed similarities of a piece are the squared length of its summed vector
        offered = worth[i] + scale * np.square(sums[reach] - sums[i]).sum(1) / lengths - penalty
        taken = np.flatnonzero(offered > worth[reach])
        worth[reach][taken] = offered[taken]
        starts.update(dict.fromkeys((taken + i + low).tolist(), i))
    cuts = []
    while n in starts and starts[n]:
        n = starts[n]
        cuts.append(n)
    return sorted(cuts)


def segmented(df: DataFrame, keys: list[str], idx: str, vec: str, low: int, high: int, penalty: float) -> DataFrame:
    """keys and idx of the rows that open a new segment."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        m = np.array(pdf[vec].tolist(), dtype="float64")
        length = np.linalg.norm(m, axis=1, keepdims=True)
        unit = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        at = partition_cuts(unit, low, high, penalty)
        return pdf.iloc[at][[*keys, idx]]

    return df.select(*keys, idx, vec).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*keys, idx]))


def absorb_short(segments: list[tuple[float, float, float]], least: float) -> list[tuple[float, float, float]]:
    """(start, end, level) segments after each one shorter than `least`, the shortest first, has joined the neighbour of the nearer level."""
    out: list[tuple | None] = list(segments)
    before, after = list(range(-1, len(out) - 1)), list(range(1, len(out) + 1))
    queue = [(s[1] - s[0], i) for i, s in enumerate(segments)]
    heapify(queue)
    while queue:
        length, i = heappop(queue)
        if length >= least:
            break
        if out[i] is None or out[i][1] - out[i][0] != length:
            continue  # joined since
        sides = [j for j in (before[i], after[i]) if 0 <= j < len(out)]
        if not sides:
            break
        j = min(sides, key=lambda k: (abs(out[k][2] - out[i][2]), k))
        a, b = sorted((i, j))
        out[a], out[b] = (out[a][0], out[b][1], out[j][2]), None
        after[a] = after[b]
        if after[b] < len(out):
            before[after[b]] = a
        heappush(queue, (out[a][1] - out[a][0], a))
    return [s for s in out if s is not None]


def without_short(df: DataFrame, keys: list[str], start: str, end: str, level: str, least: float) -> DataFrame:
    """absorb_short() for the segments of each series."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = absorb_short(list(pdf.sort_values([start, end])[[start, end, level]].itertuples(index=False, name=None)), least)
        out = pd.DataFrame(rows, columns=[start, end, level])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, start, end, level]]

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{start} double", f"{end} double", f"{level} double"])
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in (start, end, level)])
    return cast.groupBy(*keys).applyInPandas(run, schema)


def best_phase(df: DataFrame, keys: list[str], at: str, strength: str, period: float, phases: int = 64) -> DataFrame:
    """keys, phase and contrast: which of `phases` offsets of a pulse train gathers the most strength, and by what factor over the mean."""
    p = F.floor(F.pmod(F.col(at), F.lit(period)) / period * phases).cast("int")
    sums = df.withColumn("_p", F.least(p, F.lit(phases - 1))).groupBy(*keys, "_p").agg(F.sum(strength).alias("_s"))
    best = sums.groupBy(*keys).agg(F.max(F.struct(F.round("_s", 9).alias("s"), (-F.col("_p")).alias("p"))).alias("b"), F.sum("_s").alias("all"))
    return best.select(*keys, (-F.col("b.p")).alias("phase"), F.when(F.col("all") > 0, F.col("b.s") * phases / F.col("all")).otherwise(0.0).alias("contrast"))


def standardised(df: DataFrame, keys: list[str], vec: str, out: str) -> DataFrame:
    """Vectors with each dimension moved to mean 0 and scaled to deviation 1 within its key; a constant one becomes 0."""
    x = df.select(*keys, F.posexplode(vec).alias("_i", "_x"))
    stats = x.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("m"), F.stddev_pop(F.col("_x").cast("double")).alias("s"))
    wide = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "m", "s"))).alias("_stats"))
    z = F.zip_with(vec, "_stats", lambda v, t: F.when(t["s"] > 0, (v.cast("double") - t["m"]) / t["s"]).otherwise(0.0))
    return df.join(wide, keys).withColumn(out, z).drop("_stats")


def ward(points: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers of a bounded number of points by Ward's criterion, numbered by first member; of equal costs the first pair joins."""
    n = len(points)
    weight = np.ones(n) if weights is None else np.asarray(weights, "float64").copy()
    centre = np.asarray(points, "float64").copy()
    label = np.arange(n)
    alive = np.ones(n, bool)

    def costs(i: int) -> np.ndarray:
        d = ((centre - centre[i]) ** 2).sum(1) * weight * weight[i] / (weight + weight[i])
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    cost = np.array([costs(i) for i in range(n)]) if n else np.zeros((0, 0))
    for _ in range(max(0, n - count)):
        a, b = sorted(np.unravel_index(cost.argmin(), cost.shape))
        centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        alive[b] = False
        label[label == b] = a
        cost[b, :] = cost[:, b] = np.inf
        cost[a, :] = cost[:, a] = costs(a)
    return np.unique(label, return_inverse=True)[1].astype("int64")


def ward_clusters(df: DataFrame, keys: list[str], idx: str, vec: str, most: int = 1024) -> DataFrame:
    """Every row with cluster: each series' rows by Ward's criterion, in min(max(3, n // 2), 8) clusters.

    A series of over `most` rows is clustered by the means of `most` blocks of neighbours, weighted by
    their rows, and each row has its block's cluster; so no task holds more than `most` vectors.
    """
    from .blocks import by_edges

    rank = (F.row_number().over(Window.partitionBy(*keys).orderBy(idx)) - 1).cast("long")
    rows = by_edges(df.withColumn("_idx", rank), "_idx", most, keys)
    x = rows.select(*keys, "block", F.posexplode(vec).alias("_i", "_x")).groupBy(*keys, "block", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    means = x.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"), F.max("_n").alias("_n")).select(*keys, "block", "_n", F.col("_v._m").alias("_v"))
    types = dict(means.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        n = int(pdf["_n"].sum())
        k = min(max(3, n // 2), 8, len(pdf))
        return pdf[[*keys, "block"]].assign(cluster=ward(np.array(pdf["_v"].tolist()), k, pdf["_n"].to_numpy()))

    found = means.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in [*keys, "block"]), "cluster long"]))
    return rows.join(found, [*keys, "block"]).drop("block", "_idx")


def segment_starts(df: DataFrame, keys: list[str], idx: str, vec: str, low: int, high: int, penalty: float, most: int = 7200) -> DataFrame:
    """segmented() over at most `most` representative points of each series: keys and idx of the first row of each new segment."""
    from .blocks import by_edges

    rows = by_edges(df, idx, most, keys)
    x = rows.select(*keys, "block", F.posexplode(vec).alias("_i", "_x")).groupBy(*keys, "block", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    means = x.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v")).select(*keys, "block", F.col("_v._m").alias("_v"))
    cuts = segmented(means, keys, "block", "_v", low, high, penalty)
    return rows.join(cuts, [*keys, "block"]).groupBy(*keys, "block").agg(F.min(idx).alias(idx)).drop("block")


def pair_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, target: float, rate: float, most: float = 1.0) -> np.ndarray:
    """w after one clipped gradient step that draws the cosine of w x with y to the target; without a direction as it is."""
    z = w @ x
    nz, ny = np.linalg.norm(z), np.linalg.norm(y)
    if nz < 1e-9 or ny < 1e-9:
        return w
    cos = z @ y / (nz * ny)
    g = 2 * (cos - target) * np.outer(y / (nz * ny) - cos * z / nz**2, x)
    size = np.linalg.norm(g)
    return w - rate * (g if size <= most else g * (most / size))


def fitted(df: DataFrame, keys: list[str], by: str, a: str, b: str, target: str, rate: float) -> DataFrame:
    """keys, weights (a matrix, row by row) and steps: pair_step() over the pairs of each key, one by one in the order of `by`.

    The order matters, so a key is one pass; it holds the matrix alone. Pairs with a null go.
    """
    from .folds import folded

    def step(rows):
        w, n = None, 0
        for _, x, y, t in rows:
            x, y = np.asarray(x, "float64"), np.asarray(y, "float64")
            w = pair_step(np.eye(len(y), len(x)) if w is None else w, x, y, t, rate)
            n += 1
        if w is not None:
            yield [[float(v) for v in r] for r in w], n

    rows = df.select(*keys, by, a, b, F.col(target).cast("double").alias("_t")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("_t").isNotNull())
    return folded(rows, keys, [by], step, "weights array<array<double>>, steps long")
