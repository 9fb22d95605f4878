"""Tempo and phase of event series: pulse contrast, tempo search, octave choice, half-beat and hop corrections.

A tempo is judged by the strength that one phase of its pulse gathers against the mean over all phases.
Candidates are a bounded list: the events of a series pass a task as one stream, which adds them up for all
candidates and phases, so neither what is moved nor what a task holds grows with the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .intervals import nearest

PHASES = 48
#: Multiples of a tempo that a pulse train mistakes for it, and the head start of the tempo itself.
OCTAVES = (1 / 3, 0.5, 1.0, 2.0, 3.0)
OCTAVE_MARGIN = 0.05


#: Rows of a series beyond which it is dealt to more than one stream, and rows that a task holds before it hands them on.
ROWS = spans.ROWS
HELD = 512


def _pulses(onsets: DataFrame, tempi: DataFrame | None, keys: list[str], factors: list[float], phases: int, names: list[str]) -> DataFrame:
    """keys, names, _i, _bpm and _sums (one a phase) of each candidate; onsets have keys, _t (seconds) and _s.

    Candidates are the factors times each bpm of a key's tempi, whose other columns are `names` (doubles); without
    tempi the factors are the tempi. Tempi and onsets of a key meet in one stream, tempi first, so an onset
    moves once whatever the number of candidates, and a task holds the sums of one key. Of a key of more than ROWS
    onsets each stream has a part, and their sums are added.
    """
    share = F.lit(1)
    more = None
    if onsets.count() > ROWS:
        counts = onsets.groupBy(*keys).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_share")).where("_share > 1").select(*[F.col(c).alias(f"_r{c}") for c in keys], "_share")
        more = counts if counts.count() else None  # a row for ROWS onsets at most
    split = lambda df: df.join(F.broadcast(more), [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys], "left").withColumn("_share", F.coalesce("_share", share)) if more is not None else df.withColumn("_share", share)
    part = F.pmod(F.xxhash64("_t", "_s"), F.col("_share")).cast("int") if more is not None else F.lit(0)
    rows = split(onsets).select(*keys, part.alias("_part"), F.lit(1).alias("_kind"), F.col("_t").cast("double").alias("_t"), F.col("_s").cast("double").alias("_s"), *[F.lit(None).cast("double").alias(c) for c in names])
    if tempi is not None:
        copies = F.explode(F.sequence(F.lit(0), F.col("_share") - 1)) if more is not None else F.lit(0)
        listed = split(tempi).select(*keys, copies.alias("_part"), F.lit(0).alias("_kind"), F.col("bpm").cast("double").alias("_t"), F.lit(None).cast("double").alias("_s"), *[F.col(c).cast("double").alias(c) for c in names])
        rows = rows.unionByName(listed)
    groups = [*keys, "_part"]
    rows = rows.repartition(*groups).sortWithinPartitions(*groups, "_kind")
    made = T.StructType([*(rows.schema[k] for k in keys), *(rows.schema[c] for c in names), *T._parse_datatype_string("_i int, _bpm double, _sums array<double>").fields])
    fixed = tempi is None

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        target, times = to_arrow_schema(made), np.array(factors)
        now, tempo, sums, held = None, None, None, []

        def close():
            if sums is not None:
                for k, (name, bpm) in enumerate(tempo):
                    held.extend((*now[:-1], *name, i, b, v) for i, (b, v) in enumerate(zip(bpm.tolist(), sums[k].tolist(), strict=True)))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
            held.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in groups:
                x, y = b.column(c)[1:], b.column(c)[:-1]
                same = pc.fill_null(pc.equal(x, y), False)
                change[1:] |= ~pc.or_(same, pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
            kind, t, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_kind", "_t", "_s"))
            # an instant that is null has the last phase, as the least of nothing and that has
            unknown, s = pc.is_null(b.column("_t")).to_numpy(zero_copy_only=False), np.nan_to_num(s.astype("float64"))
            t = np.where(unknown, 0.0, t).astype("float64")
            edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                key = tuple(b.column(c)[low].as_py() for c in groups)
                if key != now:
                    close()
                    now, tempo, sums = key, [((), times)] if fixed else [], None
                    if len(held) >= HELD:
                        yield batch()
                mid = low + int((kind[low:high] == 0).sum())
                for r in range(low, mid):
                    tempo.append((tuple(b.column(c)[r].as_py() for c in names), t[r] * times))
                if mid == high or not tempo:
                    continue
                if sums is None:
                    sums = np.zeros((len(tempo), len(times), phases))
                bpm = np.concatenate([x for _, x in tempo])
                turns = t[mid:high, None] / (60.0 / bpm)
                at = np.minimum(np.floor((turns - np.floor(turns)) * phases), phases - 1).astype("int64")
                at[unknown[mid:high]] = phases - 1
                at += np.arange(len(bpm)) * phases
                sums += np.bincount(at.ravel(), np.repeat(s[mid:high], len(bpm)), sums.size).reshape(sums.shape)
        close()
        if held:
            yield batch()

    out = rows.mapInArrow(run, made)
    if more is None:
        return out
    each = [F.sum(F.col("_sums")[k]).alias(f"_{k}") for k in range(phases)]
    return out.groupBy(*keys, *names, "_i", "_bpm").agg(*each).select(*keys, *names, "_i", "_bpm", F.array(*[f"_{k}" for k in range(phases)]).alias("_sums"))


def _best(pulses: DataFrame, keys: list[str], phases: int) -> DataFrame:
    """keys, bpm, anchor and contrast of the best candidate."""
    each = pulses.withColumn("_sums", F.transform("_sums", lambda x: F.round(x, 9)))
    each = each.withColumn("_top", F.array_max("_sums")).withColumn("_all", F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x)).where("_all > 0")
    contrast = F.round(F.col("_top") * phases / F.col("_all"), 9)
    anchor = (F.array_position("_sums", F.col("_top")) - 1) / F.lit(float(phases)) * (60.0 / F.col("_bpm"))
    best = F.max(F.struct(contrast.alias("contrast"), (-F.col("_i")).alias("i"), F.col("_bpm").alias("bpm"), anchor.alias("anchor")))
    return each.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.bpm", "_b.anchor", "_b.contrast")


def tempo_search(onsets: DataFrame, keys: list[str], at: str, strength: str, tempi: list[float], phases: int = PHASES) -> DataFrame:
    """keys, bpm, anchor (seconds) and contrast of the best of a list of tempi; of equals the first. Series without strength go."""
    rows = onsets.select(*keys, F.col(at).alias("_t"), F.col(strength).alias("_s"))
    return _best(_pulses(rows, None, keys, [float(b) for b in tempi], phases, []), keys, phases)


def refined(onsets: DataFrame, tempi: DataFrame, keys: list[str], at: str, strength: str, reach: float, steps: int, phases: int = PHASES, names: list[str] | None = None) -> DataFrame:
    """The best of `steps` evenly spaced tempi within the share `reach` of each series' bpm: keys, bpm, anchor, contrast. A series may have several tempi, told apart by the doubles `names`."""
    known = " and ".join(f"`{k}` is not null" for k in keys)
    rows = onsets.select(*keys, F.col(at).alias("_t"), F.col(strength).alias("_s")).where(known)
    near = [1 - reach + i * (2 * reach / max(steps - 1, 1)) for i in range(steps)]
    names = names or []
    return _best(_pulses(rows, tempi.select(*keys, *names, "bpm").where(known), keys, near, phases, names), [*keys, *names], phases)


def beats(grids: DataFrame, keys: list[str], span: str) -> DataFrame:
    """keys and beat: anchor, anchor + interval, ... up to the span."""
    step = 60.0 / F.col("bpm")
    n = F.floor((F.col(span) - F.col("anchor")) / step).cast("int")
    return grids.where(F.col(span) >= F.col("anchor")).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("anchor") + i * step)).alias("beat"))


def agreement(grid: DataFrame, kicks: DataFrame, keys: list[str], beat: str, kick: str, tolerance: float) -> DataFrame:
    """keys, recall (kicks on a beat) and precision (beats with a kick); nothing to compare gives 0."""
    near = lambda a, b, x, y: nearest(a, b, keys, x, y).groupBy(*keys).agg(F.avg((F.coalesce("distance", F.lit(float("inf"))) <= tolerance).cast("double")).alias("v"))
    g, k = grid.select(*keys, beat), kicks.select(*keys, kick)
    r = near(k, g.distinct(), kick, beat).withColumnRenamed("v", "recall")
    p = near(g, k.distinct(), beat, kick).withColumnRenamed("v", "precision")
    return p.join(r, keys, "full").select(*keys, F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def grid_agreement(grids: DataFrame, kicks: DataFrame, keys: list[str], span: str, kick: str, tolerance: float) -> DataFrame:
    """grids with recall and precision, as agreement() gives them of their beats up to the span, without listing these.

    Beats lie a step apart, so which ones are near a kick follows from its instant. grids have bpm and anchor, a
    few for each key; kicks, of each key, meet all of them. A grid without beats goes if its key has no kicks.
    """
    step = 60.0 / F.col("bpm")
    last = F.floor((F.col(span) - F.col("anchor")) / step)
    g = grids.withColumn("_step", step).withColumn("_last", F.when(F.col(span) >= F.col("anchor"), last).otherwise(-1))
    both = g.join(kicks.select(*keys, F.col(kick).cast("double").alias("_k"), F.lit(1).alias("_is")), keys, "left")
    low = F.greatest(F.ceil((F.col("_k") - tolerance - F.col("anchor")) / F.col("_step")) - 1, F.lit(0))
    high = F.least(F.floor((F.col("_k") + tolerance - F.col("anchor")) / F.col("_step")) + 1, F.col("_last"))
    listed = F.when(F.col("_k").isNotNull() & (high >= low), F.sequence(low, high))
    near = F.filter(listed, lambda i: F.abs(F.col("_k") - (F.col("anchor") + i * F.col("_step"))) <= tolerance)
    both = both.withColumn("_near", F.coalesce(near, F.array().cast("array<bigint>"))).withColumn("_hit", (F.size("_near") > 0).cast("double"))
    of = [c for c in g.columns]
    # a beat counts once, and a kick once: with the first of the beats near it
    beat = both.select(*of, "_is", "_hit", F.posexplode_outer("_near").alias("_pos", "_beat")).withColumn("_first", F.coalesce(F.col("_pos") == 0, F.lit(True)))
    per = beat.groupBy(*of, "_beat").agg(F.sum(F.when(F.col("_first"), F.col("_is"))).alias("_n"), F.sum(F.when(F.col("_first"), F.col("_is") * F.col("_hit"))).alias("_on"))
    out = per.groupBy(*of).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("_on"), F.lit(0.0)).alias("_on"), F.count("_beat").alias("_met"))
    out = out.where("_n > 0 or _last >= 0")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(*grids.columns, share(F.col("_on"), F.col("_n")).alias("recall"), share(F.col("_met"), F.col("_last") + 1).alias("precision"))


def estimated(onsets: DataFrame, kicks: DataFrame, keys: list[str], at: str, strength: str, kick: str, tempi: list[float], low: float, high: float, tolerance: float, reach: float = 0.02, steps: int = 21) -> DataFrame:
    """keys, bpm, anchor, contrast, recall, precision and factor of each series.

    The tempo of the highest contrast, drawn close, stands against its octaves and thirds within
    low..high; the harmonic mean of recall and precision against the kicks decides, with a head start
    for the tempo itself. Of equals the slower wins.
    """
    span = onsets.groupBy(*keys).agg(F.max(at).alias("_span"))
    found = tempo_search(onsets, keys, at, strength, tempi)
    factor = F.explode(F.array(*[F.lit(f) for f in OCTAVES])).alias("factor")
    trials = found.select(*keys, "bpm", factor).withColumn("bpm", F.col("bpm") * F.col("factor")).where(F.col("bpm").between(low, high))
    grids = refined(onsets, trials, keys, at, strength, reach, steps, names=["factor"])
    agreed = grid_agreement(grids.join(span, keys), kicks, keys, "_span", kick, tolerance)
    both = F.col("recall") + F.col("precision")
    score = F.when(both > 0, 2 * F.col("recall") * F.col("precision") / both).otherwise(0.0) + F.when(F.col("factor") == 1.0, OCTAVE_MARGIN).otherwise(0.0)
    judged = agreed.withColumn("_score", F.round(score, 9))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_score"), "factor"))
    return judged.withColumn("_rn", first).where("_rn = 1").select(*keys, "bpm", "anchor", "contrast", "recall", "precision", "factor")


def resolved_phase(energy: DataFrame, grids: DataFrame, keys: list[str], idx: str, value: str, hop: float, margin: float) -> DataFrame:
    """grids (keys, bpm, anchor) with anchor moved and shifted set.

    Where the mean energy half a beat later exceeds that on the beat by the factor `margin`, the grid
    moves by half a beat; then it moves one hop ahead, since an onset shows a frame late. energy has
    one row per frame, `hop` seconds apart from idx 0; between frames it is interpolated. A grid over two
    beats or less, without energy, or without a tempo over 0 stays as it is.
    """
    step = 60.0 / F.col("bpm")
    last = energy.groupBy(*keys).agg(F.max(idx).alias("_last"))
    starts = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.pmod(F.col("anchor"), step).alias("a")), F.struct(F.lit(1).alias("half"), F.pmod(F.col("anchor") + step / 2, step).alias("a"))))
    g = grids.where(F.col("bpm") > 0).join(last, keys).select(*keys, "bpm", "anchor", "_last", starts.alias("_s"))
    n = F.floor((F.col("_last") * hop - F.col("_s.a")) / step).cast("int")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.col("_s.a") + i * step))
    points = g.select(*keys, F.col("_s.half").alias("half"), "_last", at.alias("_at"))
    left = F.least(F.floor(F.col("_at") / hop), F.col("_last"))
    points = points.withColumn("_l", left).withColumn("_f", F.col("_at") / hop - F.col("_l"))
    sides = points.select(*keys, "half", F.explode(F.array(F.struct(F.col("_l").alias("i"), (1 - F.col("_f")).alias("w")), F.struct(F.least(F.col("_l") + 1, F.col("_last")).alias("i"), F.col("_f").alias("w")))).alias("_e"))
    frames = energy.select(*keys, F.col(idx).alias("_i"), F.col(value).cast("double").alias("_v"))
    sums = sides.select(*keys, "half", F.col("_e.i").alias("_i"), F.col("_e.w").alias("_w")).join(frames, [*keys, "_i"]).groupBy(*keys, "half").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("m"))
    both = sums.groupBy(*keys).agg(F.max(F.when(F.col("half") == 0, F.col("m"))).alias("_on"), F.max(F.when(F.col("half") == 1, F.col("m"))).alias("_off"))
    moved: Column = F.coalesce((F.col("_on") > 0) & (F.col("_off") > F.col("_on") * margin), F.lit(False))
    long = F.coalesce((F.col("bpm") > 0) & (F.col("_last") * hop > 2 * step), F.lit(False))
    out = grids.join(both, keys, "left").join(last, keys, "left").withColumn("shifted", moved & long)
    found = F.pmod(F.col("anchor") + F.when(F.col("shifted"), step / 2).otherwise(0.0) - hop, step)
    return out.withColumn("anchor", F.when(long, found).otherwise(F.col("anchor"))).drop("_on", "_off", "_last")
