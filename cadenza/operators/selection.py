"""Choosing candidates: re-ranking, near ties, recency, usage penalties, contributions, eviction by priority."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded


def reranked(candidates: DataFrame, keys: list[str], score: str, tie: str, least: float = 0.0, take: int | None = None) -> DataFrame:
    """Candidates of each key, best first, as rank; scores under `least` go if it is over 0; equal scores stay in the order of tie."""
    kept = candidates.where(F.col(score) >= least) if least > 0 else candidates
    out = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    return out if take is None else out.where(F.col("rank") <= take)


def best_or(candidates: DataFrame, requests: DataFrame, keys: list[str], pick: str, score: str, tie: str, fallback, least: float) -> DataFrame:
    """Each request with its best candidate at `least` or above, else the fallback column; source says which."""
    best = reranked(candidates, keys, score, tie, least, 1).select(*keys, F.col(pick).alias("_pick"))
    out = requests.join(best, keys, "left")
    return out.select(*requests.columns, F.coalesce("_pick", fallback).alias(pick), F.when(F.col("_pick").isNotNull(), "ranked").otherwise("fallback").alias("source"))


def near_tie(candidates: DataFrame, keys: list[str], score: str, second: str, tie: str, slack: float, then: str | None = None) -> DataFrame:
    """Of the candidates within `slack` of their key's best score, the one with the highest second value, and of those by `then` or the score."""
    best = F.max(score).over(Window.partitionBy(*keys))
    close = candidates.withColumn("_best", best).where(F.col(score) >= F.col("_best") - slack).drop("_best")
    return close.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(second), F.desc(then or score), tie))).where("_rn = 1").drop("_rn")


def _moments(candidates: DataFrame, keys: list[str], at: str, clip: str, score: str, choose, extra: str = "") -> DataFrame:
    """keys, at, clip and what choose(clips, best first, with their scores) says of each moment, in order; choose is made anew for each series."""
    types = dict(candidates.dtypes)

    def step(rows):
        one = choose()
        for t, moment in groupby(rows, key=lambda r: r[0]):
            best = sorted(((c, s) for _, c, s in moment), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
            yield (t, *one(best))

    return folded(candidates.select(*keys, at, clip, score), keys, [at], step, f"{at} {types[at]}, {clip} {types[clip]}{extra}")


def without_recent(candidates: DataFrame, keys: list[str], at: str, clip: str, score: str, recent: int) -> DataFrame:
    """For each moment of a series the best clip that none of the last `recent` choices was; if all were, the best of all; fresh says which.

    Choices depend on those before, so a series is one ordered pass, which holds the last choices and
    one moment's candidates; series are independent.
    """

    def choose():
        last: list = []

        def one(best):
            nonlocal last
            fresh = [c for c, _ in best if c not in last]
            c = fresh[0] if fresh else best[0][0]
            last = [*[x for x in last if x != c], c][-recent:] if recent else []
            return c, bool(fresh)

        return one

    return _moments(candidates, keys, at, clip, score, choose, ", fresh boolean")


def with_usage_penalty(candidates: DataFrame, keys: list[str], at: str, clip: str, score: str, weight: float = 0.5) -> DataFrame:
    """For each moment of a series the clip with the highest score / (1 + weight * uses so far); ties to the smaller clip.

    One ordered pass per series, which holds a count per clip and one moment's candidates.
    """

    def choose():
        used: dict = {}

        def one(best):
            c = min(best, key=lambda x: (x[1] is None, -(x[1] or 0) / (1 + weight * used.get(x[0], 0)), x[0]))[0]
            used[c] = used.get(c, 0) + 1
            return (c,)

        return one

    return _moments(candidates, keys, at, clip, score, choose)


def contributions(values: DataFrame, keys: list[str], axis: str, value: str, weight: str, top: int) -> DataFrame:
    """The `top` axes that add most to each score and the `top` that add least: side ('top' or 'bottom'), rank, contribution."""
    if not 1 <= top <= 17:
        raise ValueError("top must lie between 1 and 17")
    c = values.withColumn("contribution", F.col(value) * F.col(weight))
    w = Window.partitionBy(*keys)
    c = c.withColumn("_top", F.row_number().over(w.orderBy(F.desc("contribution"), axis))).withColumn("_bottom", F.row_number().over(w.orderBy("contribution", axis)))
    side = F.array_compact(F.array(F.when(F.col("_top") <= top, F.struct(F.lit("top").alias("side"), F.col("_top").alias("rank"))), F.when(F.col("_bottom") <= top, F.struct(F.lit("bottom").alias("side"), F.col("_bottom").alias("rank")))))
    return c.withColumn("_s", F.explode(side)).select(*keys, axis, "_s.side", "_s.rank", "contribution")


def evict_by_priority(models: DataFrame, keys: list[str], size: str, priority: str, used: str, tie: str, needed: float) -> DataFrame:
    """Rows to free, of the highest priority number and the longest unused first, until `needed` is reached. Leave out protected rows before."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(F.desc(priority), used, tie).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return models.withColumn("_before", before).where(F.col("_before") < needed).drop("_before")
