"""Cut planners: from beats, peaks, phrases or a clock to consecutive cuts, and repairs of timelines.

A series is one timeline. Where a pause makes what follows independent of what came before, the
series is cut there and its parts are planned in parallel; a planner without such points passes one
timeline's sorted rows one by one, holding no more than its own state.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cut_confidence
from .folds import folded, pieces, stretches_of
from .sequence import _types


def beat_plan(beats: DataFrame, keys: list[str], at: str, low: float, high: float) -> DataFrame:
    """Cuts from beat to beat: the first one low..high away, else the very next. Columns keys, start and end.

    A beat after a pause of more than `high` is always reached, so series part there.
    """

    def step(rows):
        for stretch in stretches_of(rows, high, inclusive=False):
            t = [r[0] for r in stretch]
            i = 0
            while i < len(t):
                yield (t[i],)
                j = bisect_left(t, t[i] + low, i + 1)
                i = j if j < len(t) and t[j] <= t[i] + high else i + 1

    beats = beats.select(*keys, at).where(F.col(at).isNotNull()).distinct()
    walked = folded(pieces(beats, keys, at, high, inclusive=False), keys, [at], step, f"start {dict(beats.dtypes)[at]}", "_piece")
    end = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return walked.withColumn("end", end).where(F.col("end").isNotNull())


def peak_plan(peaks: DataFrame, keys: list[str], at: str, low: float, high: float) -> DataFrame:
    """Cuts that end at peaks: nearer than `low` a peak is passed over, and no cut is longer than `high`. Columns keys, start, length."""

    def step(rows):
        now = 0.0
        for (p,) in rows:
            if p - now > 0 and p - now >= low:
                length = min(p - now, float(high))
                yield now, length
                now += length

    times = peaks.select(*keys, F.col(at).cast("double").alias("_at")).where("_at is not null").distinct()
    return folded(times, keys, ["_at"], step, "start double, length double")


def grid(totals: DataFrame, total: str, step: Column, least_tail: float = 0.0) -> DataFrame:
    """Cuts of one length up to each row's total: n, start, length. The last is cut short; a tail under least_tail is added to the one before."""
    whole = F.floor(F.col(total) / step)
    tail = F.col(total) - whole * step
    count = (whole + F.when((tail > 0) & ((tail >= least_tail) | (whole == 0)), 1).otherwise(0)).cast("int")
    out = totals.withColumn("_step", step).withColumn("_count", count).where("_count > 0")
    out = out.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("_count") - 1))).withColumn("start", F.col("n") * F.col("_step"))
    last = F.col("n") == F.col("_count") - 1
    return out.withColumn("length", F.when(last, F.col(total) - F.col("start")).otherwise(F.col("_step"))).drop("_step", "_count")


def phrase_length(bpm: Column, pacing: Column, low: float, high: float) -> Column:
    """Seconds of 4, 8 or 16 bars of four beats, the fewer the higher the pacing, kept within bounds."""
    bars = F.when(pacing >= 4, 4).when(pacing >= 3, 8).otherwise(16)
    return F.greatest(F.lit(low), F.least(F.lit(high), bars * 4 * 60.0 / bpm))


def evenly_spaced(total: Column, wanted: int) -> Column:
    """Distinct rounded indices (halves to even) of `wanted` points from 0 to total - 1."""
    step = (total - 1) / F.lit(wanted - 1)
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * step).cast("long")))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total == 1, F.array(F.lit(0).cast("long"))).otherwise(many)


def gaps(clips: DataFrame, keys: list[str], start: str, end: str, total: Column, least: float) -> DataFrame:
    """Open stretches of a timeline longer than `least`, before, between and after its clips: keys, gap_start, gap_end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = clips.select(*keys, F.coalesce(reach, F.lit(0).cast("double")).alias("gap_start"), F.col(start).cast("double").alias("gap_end"))
    after = clips.groupBy(*keys).agg(F.max(end).cast("double").alias("gap_start"), F.max(total).cast("double").alias("gap_end"))
    return before.unionByName(after).where(F.col("gap_end") - F.col("gap_start") > least)


def repeated_sources(cuts: DataFrame, length: str, source: str) -> DataFrame:
    """Cuts longer than their source become repeats: part, part_length; an unknown source is never short."""
    n = F.when(F.col(source) > 0, F.ceil(F.col(length) / F.col(source))).otherwise(1).cast("int")
    out = cuts.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rest = F.col(length) - F.col("part") * F.col(source)
    return out.withColumn("part_length", F.when(F.col("_n") == 1, F.col(length)).otherwise(F.least(F.col(source), rest))).drop("_n")


def chained(windows: DataFrame, keys: list[str], at: str, tie: str, same) -> DataFrame:
    """Neighbouring windows that fit the first of their segment: keys, at (of the first), the further columns of the first, and n.

    same(first, row), two dictionaries of column values, says whether a row still fits; the comparison
    is with the segment's start, so drift ends it.
    """
    columns = [at, tie, *[c for c in windows.columns if c not in (*keys, at, tie)]]

    def step(rows):
        first, start, n = None, None, 0
        for r in rows:
            row = dict(zip(columns, r, strict=True))
            if first is not None and same(start, row):
                n += 1
                continue
            if first is not None:
                yield *first, n
            first, start, n = r, row, 1
        if first is not None:
            yield *first, n

    return folded(windows.select(*keys, *columns), keys, [at, tie], step, f"{_types(windows, columns)},n bigint".replace(":", " "))


def collapsed(events: DataFrame, keys: list[str], at: str, tie: str, kind: str, reach) -> DataFrame:
    """Events without those within `reach` of the last kept one if that is of the same kind."""
    columns = [at, kind, tie, *[c for c in events.columns if c not in (*keys, at, kind, tie)]]

    def step(rows):
        last = None
        for r in rows:
            if last is None or r[0] - last[0] > reach or r[1] != last[1]:
                yield r
                last = r

    cut = pieces(events.select(*keys, *columns).where(F.col(at).isNotNull()), keys, at, reach, inclusive=False)
    return folded(cut, keys, [at, tie], step, _types(events, columns), "_piece").select(*events.columns)


def level_events(curve: DataFrame, keys: list[str], idx: str, value: str, window: int) -> DataFrame:
    """Rows that rise over 1.5 times a quiet past (drop) or fall under 0.4 of a loud one (breakdown), with their intensity.

    Values are shares of the series' maximum; the first and last `window` rows have no past or future and never count.
    """
    w = Window.partitionBy(*keys)
    v = F.col(value) / F.max(value).over(w)
    past = F.avg("_v").over(w.orderBy(idx).rowsBetween(-window, -1))
    out = curve.withColumn("_v", v).withColumn("_past", past).withColumn("_n", F.count("*").over(w)).where((F.col(idx) >= window) & (F.col(idx) < F.col("_n") - window))
    kind = F.when((F.col("_v") > F.col("_past") * 1.5) & (F.col("_past") < 0.4), "drop").when((F.col("_v") < F.col("_past") * 0.4) & (F.col("_past") > 0.5), "breakdown")
    out = out.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return out.withColumn("intensity", F.abs(F.col("_v") - F.col("_past"))).drop("_v", "_past", "_n")


def boosted(base: DataFrame, stems: DataFrame, keys: list[str], at: str, tie: str, strength: str, least, share: float = 0.25, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(base with boost, stems that fill gaps): a stem within least / 2 of its nearest base event lends it a share of
    its strength, up to `cap` times what it had; one at least `least` away from all stays by itself; the rest goes."""
    from .intervals import nearest

    times = base.select(*keys, F.col(at).alias("_base")).distinct()
    near = nearest(stems, times, keys, at, "_base")
    lent = near.where(F.col("distance") <= least / 2).groupBy(*keys, F.col("_base").alias(at)).agg(F.sum(strength).alias("_lent"))
    first = F.row_number().over(Window.partitionBy(*keys, at).orderBy(tie))  # of events at one instant the first is boosted
    out = base.withColumn("_first", first).join(lent, [*keys, at], "left")
    more = F.when(F.col("_first") == 1, F.coalesce(F.col("_lent") * share, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("boosted", F.least(F.col(strength) * cap, F.col(strength) + more)).drop("_first", "_lent")
    return out, near.where(F.col("distance").isNull() | (F.col("distance") >= least)).drop("_base", "distance")


def spaced_grid(total: Column, interval: Column) -> Column:
    """Instants 0, interval, 2 * interval, ... below the total."""
    n = F.ceil(total / interval).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i * interval)


def hybrid_cuts(beats: list[float], downbeats: set[float], energy: list[float], total: float, low: float, high: float, pacing: float, precision: float, react: float) -> list[tuple]:
    """(start, length, energy, aligned, strength) of one timeline's cuts, each from the end of the one before.

    Loud places want short cuts: the wanted length lies between low and high by pacing (1 slow, 5 fast)
    less the energy's share `react`. Its end snaps to the nearest beat within 2 * precision seconds: to
    a downbeat always, to another beat from a precision over a half. Cuts move on by 0.1 s at least and
    last half a second at least.
    """
    bias = 1.0 - (pacing - 1) / 4.0
    valid = [b for b in beats if b <= total] or beats
    now, out = 0.0, []
    while now < total:
        level = energy[min(int(now / total * len(energy)), len(energy) - 1)] if energy else 0.5
        speed = bias - level * react * 0.4 + (0.1 * (1.0 - level) if bias < 0.2 else 0.0)
        end = now + max(low, min(high, low + (high - low) * max(0.0, min(1.0, speed))))
        strength = 0.0
        if valid and precision > 0:
            i = bisect_left(valid, end)
            near = min(valid[max(0, i - 1) : i + 1], key=lambda b: (abs(b - end), b))
            if abs(near - end) < 2.0 * precision and near > now + 0.1:
                strength = 1.0 if near in downbeats else 0.7 if precision > 0.5 else 0.0
                end = near if strength else end
        if end <= now + 0.1:
            end = now + low
        end = max(end, now + 0.5)
        out.append((now, end - now, level, strength > 0, strength))
        now = end
    return out


def hybrid_plan(timelines: DataFrame, keys: list[str], beats: str, downbeats: str, energy: str, total: str, low: float, high: float, pacing: float, precision: float, react: float) -> DataFrame:
    """hybrid_cuts() of each row: keys, start, length, energy, aligned, strength, transition, confidence.

    Quiet cuts fade, middling ones cross-fade, loud ones are hard; confidence is greater for cuts on a beat
    and for lengths near the middle of low and high. A row is one timeline with its sorted beats, its downbeats and its energy curve as arrays, which a
    recording's length bounds. Each cut starts where the last one ended, so a timeline is one small task.
    """
    made = ", ".join(["start double", "length double", "energy double", "aligned boolean", "strength double"])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                cuts = hybrid_cuts(r[beats] or [], set(r[downbeats] or []), r[energy] or [], r[total] or 0.0, low, high, pacing, precision, react)
                rows += [(*[r[k] for k in keys], *c) for c in cuts]
            names = [*keys, "start", "length", "energy", "aligned", "strength"]
            types = [*[b.schema.field(k).type for k in keys], pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    kinds = dict(timelines.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), made])
    cuts = timelines.select(*keys, beats, downbeats, energy, total).mapInArrow(run, schema)
    kind = F.when(F.col("energy") < 0.3, "fade").when(F.col("energy") <= 0.7, "crossfade").otherwise("hard_cut")
    return cuts.select("*", kind.alias("transition"), cut_confidence(F.col("aligned"), F.col("length"), (low + high) / 2).alias("confidence"))


def replacements(targets: DataFrame, readable: DataFrame, keys: list[str], n: str, at: str, frame: str, reach: int) -> DataFrame:
    """keys, n and frame: each target frame, or else the nearest readable one within `reach` that no target before has taken.

    Of two equally near the earlier is tried first; a target without any gets no row. Candidates are an
    equi-join over 2 * reach + 1 offsets; the choice passes them in order of n and holds the frames taken.
    """
    offsets = [0, *(x for i in range(1, reach + 1) for x in (-i, i))]
    listed = targets.select(*keys, n, at, F.posexplode(F.array(*map(F.lit, offsets))).alias("_rank", "_off")).withColumn(frame, F.col(at) + F.col("_off"))
    found = listed.join(readable.select(*keys, frame).distinct(), [*keys, frame]).select(*keys, n, "_rank", frame)

    def step(rows):
        used, done = set(), None
        for number, _, f in rows:
            if number != done and f not in used:
                used.add(f)
                done = number
                yield number, f

    kinds = dict(found.dtypes)
    return folded(found, keys, [n, "_rank"], step, f"{n} {kinds[n]}, {frame} {kinds[frame]}")
