"""From beats, curves and scored clips to a timeline without gaps, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.windows import shared_folder
from . import spans
from .folds import folded
from .intervals import as_of, nearest
from .planners import gaps

#: Seconds from a downbeat within which a cut is on it, shortest gap that is filled, shortest filler.
ON_BEAT = 0.05
LEAST_GAP = 0.1
LEAST_FILL = 0.001


def segments(beats: DataFrame, timelines: DataFrame, keys: list[str], at: str, total: str, every: str, ends: bool = True) -> DataFrame:
    """keys, n (from 0), start and end of the stretches between cuts: every so many beats there is one, and with `ends` at 0 and at the total.

    every is a column of timelines. Beats outside of 0..total and equal instants count once or not at all.
    """
    inside = beats.select(*keys, F.col(at).cast("double").alias("start")).join(timelines.select(*keys, F.col(total).cast("double").alias("_total"), F.col(every).alias("_every")), keys)
    numbered = spans.numbered(inside.where((F.col("start") >= 0) & (F.col("start") <= F.col("_total"))).withColumn("_tie", F.lit(0)), keys, ["start", "_tie"], "_beat")
    points = numbered.where(F.col("_beat") % F.col("_every") == 0).select(*keys, "start")
    if ends:
        points = points.unionByName(timelines.select(*keys, F.explode(F.array(F.lit(0.0), F.col(total).cast("double"))).alias("start")))
    w = Window.partitionBy(*keys).orderBy("start")
    parts = points.distinct().withColumn("end", F.lead("start").over(w)).withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    return parts.where(F.col("end").isNotNull()).select(*keys, "n", "start", "end")


def mood_scores(moods: DataFrame, match: DataFrame, keys: list[str], on: list[str], weight: str, clip: str, score: str) -> DataFrame:
    """keys, clip and score: the mean of each clip's match over a key's moods, weighted; weights that sum to 0 count alike. match has the clips' scores for what `on` names."""
    w = Window.partitionBy(*keys)
    total = F.sum(weight).over(w)
    shares = moods.withColumn("_share", F.when(total > 0, F.col(weight) / total).otherwise(1 / F.count("*").over(w)))
    return shares.join(match, on).groupBy(*keys, clip).agg(F.sum(F.col("_share") * F.col(score)).alias("score"))


def alike(match: DataFrame, on: list[str], clip: str, score: str) -> DataFrame:
    """clip and kind, the smallest of the clips that match everything as it does: they have one score for every key."""
    each = match.groupBy(clip).agg(F.sort_array(F.collect_list(F.struct(*on, score))).alias("_profile"))  # a row for a mood
    return each.join(each.groupBy("_profile").agg(F.min(clip).alias("kind")), "_profile").select(clip, "kind")


def _best_of(scores: DataFrame, kinds: DataFrame, n: DataFrame, keys: list[str], clip: str) -> DataFrame:
    """keys, clip, _score and _n: of scores whose clip is a kind, the clips that may be among a key's _n best ones.

    A kind counts if better kinds have fewer than _n clips, with its _n smallest clips: a key makes rows for its
    parts and its kinds, not for all clips.
    """
    w = Window.partitionBy("kind")
    placed = kinds.withColumn("_place", F.row_number().over(w.orderBy(clip)) - 1)
    sizes = kinds.groupBy("kind").agg(F.count("*").alias("_size"))
    rows = scores.withColumnRenamed(clip, "kind").join(n, keys).join(sizes, "kind")
    level = Window.partitionBy(*keys)
    better = F.sum("_size").over(level.orderBy(F.desc("_score"))) - F.sum("_size").over(Window.partitionBy(*keys, "_score"))
    rows = rows.withColumn("_better", better).where(F.col("_better") < F.col("_n"))
    wanted = rows.select(*keys, "kind", "_score", "_n", F.explode(F.sequence(F.lit(0), F.least("_size", "_n").cast("int") - 1)).alias("_place"))
    return wanted.join(placed, ["kind", "_place"]).select(*keys, clip, "_score", "_n")


def assigned(parts: DataFrame, scores: DataFrame, keys: list[str], clip: str, weight: float = 0.5, kinds: DataFrame | None = None) -> DataFrame:
    """parts with the clip of each, and its score: in turn the one whose score / (1 + weight * uses so far) is highest, ties to the smaller clip.

    A clip's value only falls with its own uses, so what is taken in turn is all clips' values in falling
    order, and the n-th part has the n-th of them: no part waits for the one before. The r-th best clip
    is never used more often than a better one, so of n parts it has n / r at most, and n log n values
    are put in order. A key without clips keeps no part. Scores under 0 count as 0. With kinds, as alike()
    gives them, scores are those of kinds and stand for all their clips.
    """
    n = parts.groupBy(*keys).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_score"), clip))
    scores = scores.select(*keys, clip, F.greatest(F.col("score").cast("double"), F.lit(0.0)).alias("_score"))
    found = scores.join(n, keys) if kinds is None else _best_of(scores, kinds, n, keys, clip)
    best = found.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_n"))
    uses = best.withColumn("_use", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / F.col("_rank")).cast("int") - 1)))
    values = uses.withColumn("_fall", -F.col("_score") * (1 / (1 + F.col("_use") * weight)))
    turns = spans.numbered(values, keys, ["_fall", clip, "_use"], "n").where(F.col("n") < F.col("_n"))
    return parts.join(turns.select(*keys, "n", clip, F.col("_score").alias("score")), [*keys, "n"])


def energy_at(rows: DataFrame, energy: DataFrame, keys: list[str], start: str, at: str, value: str, out: str) -> DataFrame:
    """Add the curve's value at the first instant at or after each row's start; beyond the end the last one, without a curve null."""
    last = energy.groupBy(*keys).agg(F.max_by(value, at).alias("_last"))
    found = as_of(rows, energy.select(*keys, F.col(at).alias("_e"), F.col(value).alias(out)), keys, start, "_e", [out], "forward")
    return found.join(last, keys, "left").withColumn(out, F.coalesce(out, "_last")).drop("_e", "_last")


def _kind(energy: Column) -> Column:
    return F.when(energy > 0.7, "cut").when(energy < 0.3, "fade").otherwise("dissolve")


def with_transitions(timeline: DataFrame, downbeats: DataFrame, keys: list[str], start: str, at: str, energy: str) -> DataFrame:
    """Add transition_in and transition_out: cuts where it is loud, fades where it is quiet; a start on a downbeat is a cut as well. The last one goes out with a cut."""
    near = nearest(timeline, downbeats.select(*keys, F.col(at).cast("double").alias("_beat")).distinct(), keys, start, "_beat")
    on = F.coalesce(F.col("distance") < ON_BEAT, F.lit(False))
    after = F.lead(energy).over(Window.partitionBy(*keys).orderBy(start))
    last = F.lead(start).over(Window.partitionBy(*keys).orderBy(start)).isNull()
    out = near.withColumn("transition_in", F.when(on, "cut").otherwise(_kind(F.col(energy)))).withColumn("transition_out", F.when(last, "cut").otherwise(_kind(after)))
    return out.drop("_beat", "distance")


def filled(timeline: DataFrame, timelines: DataFrame, keys: list[str], start: str, end: str, clip: str, source_start: str, source_end: str, total: str, least: float = LEAST_GAP) -> DataFrame:
    """keys, start, end, clip, source_start, source_end of fillers for gaps of more than `least` seconds, before, between and after a timeline's clips.

    Clips are taken from the timeline in turn, each as long as it is; one that would follow itself is passed
    over once, and what is shorter than LEAST_FILL always. The turn goes on from gap to gap, so a timeline
    is one ordered pass that holds its clips.
    """
    rows = timeline.select(*keys, *[F.col(c).cast("double").alias(f"_{n}") for n, c in (("a", start), ("b", end), ("c", source_start), ("d", source_end))], F.col(clip).alias("_clip"))
    open_ = gaps(rows.join(timelines.select(*keys, F.col(total).cast("double").alias("_total")), keys), keys, "_a", "_b", F.col("_total"), least)
    none = F.lit(None)
    kind = dict(timeline.dtypes)[clip]
    both = rows.select(*keys, F.lit(0).alias("_kind"), "_a", "_b", "_clip", "_c", "_d").unionByName(
        open_.select(*keys, F.lit(1).alias("_kind"), F.col("gap_start").alias("_a"), F.col("gap_end").alias("_b"), none.cast(kind).alias("_clip"), none.cast("double").alias("_c"), none.cast("double").alias("_d"))
    )

    def step(members):
        held, turn, before = [], 0, None
        for gap, a, b, c, low, high in members:
            if not gap:
                if high - low > LEAST_FILL:
                    held.append((c, low, high))
                continue
            while held and a < b - least:
                own = held[turn % len(held)]
                turn += 1
                if len(held) > 1 and own[0] == before:
                    own = held[turn % len(held)]
                    turn += 1
                length = min(own[2] - own[1], b - a)
                yield a, a + length, own[0], own[1], own[1] + length
                before, a = own[0], a + length

    return folded(both, keys, ["_kind", "_a", "_b"], step, f"{start} double, {end} double, {clip} {kind}, {source_start} double, {source_end} double")


def composed(beats: DataFrame, downbeats: DataFrame, energy: DataFrame, timelines: DataFrame, scores: DataFrame, clips: DataFrame, keys: list[str], clip: str, ends: bool = True, seed: int = 0, kinds: DataFrame | None = None) -> DataFrame:
    """A timeline for each row of timelines: keys, start, end, clip, source_start, source_end, score, energy_match, match, transition_in, transition_out and filler.

    beats and downbeats have an instant `at`, energy `at` and `value`, timelines `total` and `every` (beats
    a cut), scores (key, clip, score; with kinds of alike() those of kinds), clips (clip, length, motion). A clip longer than its part begins
    somewhere in it by the hash of key and number, so the same input gives the same timeline. Timelines
    without a clip have no rows.
    """
    spark = beats.sparkSession
    folder = f"{shared_folder(spark)}/composed"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")  # read several times below
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    parts = stored(segments(beats, timelines, keys, "at", "total", "every", ends), "parts")
    chosen = stored(assigned(parts, scores, keys, clip, kinds=kinds), "assigned").join(clips.select(clip, F.col("length").cast("double").alias("_length"), F.col("motion").cast("double").alias("_motion")), clip)
    chosen = energy_at(chosen, energy, keys, "start", "at", "value", "energy")
    long = F.col("end") - F.col("start")
    spot = F.pmod(F.xxhash64(*keys, "n", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    source = F.when(F.col("_length") > long, spot * (F.col("_length") - long)).otherwise(0.0)
    chosen = chosen.withColumn("source_start", source).withColumn("source_end", F.when(F.col("_length") > long, F.col("source_start") + long).otherwise(F.col("_length")))
    chosen = chosen.withColumn("energy_match", 1 - F.abs(F.col("_motion") - F.col("energy"))).withColumn("match", (F.col("score") + F.col("energy_match")) / 2)
    chosen = with_transitions(chosen, downbeats, keys, "start", "at", "energy").withColumn("filler", F.lit(False))
    columns = [*keys, "start", "end", clip, "source_start", "source_end", "score", "energy_match", "match", "transition_in", "transition_out", "filler"]
    chosen = stored(chosen.select(*columns), "chosen")
    more = filled(chosen, timelines, keys, "start", "end", clip, "source_start", "source_end", "total")
    more = more.withColumns({"transition_in": F.lit("cut"), "transition_out": F.lit("cut"), "filler": F.lit(True)})
    return chosen.unionByName(more, allowMissingColumns=True)
