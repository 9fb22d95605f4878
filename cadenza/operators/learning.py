"""Feedback learning: context keys, credit, additive weights, backed-off posteriors, scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import folded

#: Samples that a level needs before its mean is trusted.
CONFIDENT = 10
#: Share of the credit that each context level gets, from the global level to the most specific.
LEVEL_WEIGHTS = (1.0, 0.8, 0.6, 0.4)


def context_keys(parts: dict[str, Column]) -> Column:
    """Backoff keys from the empty one to the most specific: '', 'a=x', 'a=x|b=y', ..."""
    keys, names = [F.lit("")], []
    for name, value in parts.items():
        names.append(F.concat(F.lit(f"{name}="), value.cast("string")))
        keys.append(F.concat_ws("|", *names))
    return F.array(*keys)


def credit(events: DataFrame, axis: str, keys: str, positive: str, negative: str) -> DataFrame:
    """axis, level, key, positive and negative of each event and level, scaled by the level's weight."""
    weights = F.array(*[F.lit(x) for x in LEVEL_WEIGHTS])
    out = events.select(axis, positive, negative, F.posexplode(keys).alias("level", "key"))
    w = F.element_at(weights, F.col("level") + 1)
    return out.select(axis, "level", "key", F.round(F.col(positive) * w, 6).alias("positive"), F.round(F.col(negative) * w, 6).alias("negative"))


def weights(credits: DataFrame, axis: str) -> DataFrame:
    """Sums by axis, level and key; partial sums are shuffled, not events."""
    return credits.groupBy(axis, "level", "key").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def posterior(contexts: DataFrame, table: DataFrame, axis: str, keys: str, default: float = 0.5) -> DataFrame:
    """contexts with mean, level and variance from the weights.

    The mean is that of the most specific level with CONFIDENT samples, else the default at level -1;
    the variance is that of the most specific level present at all, else 1/12.
    """
    ids = [c for c in contexts.columns if c != keys]
    wide = contexts.select(*ids, F.posexplode(keys).alias("level", "key"))
    n = F.col("positive") + F.col("negative")
    a, b = F.col("positive") + 1, F.col("negative") + 1
    found = wide.join(table, [axis, "level", "key"], "left")
    mean = F.max_by((F.col("positive") + 1) / (n + 2), F.when(n >= CONFIDENT, F.col("level")))
    variance = F.max_by(a * b / ((a + b) * (a + b) * (a + b + 1)), F.when(n.isNotNull(), F.col("level")))
    return found.groupBy(*ids).agg(
        F.coalesce(mean, F.lit(default)).alias("mean"),
        F.coalesce(F.max(F.when(n >= CONFIDENT, F.col("level"))), F.lit(-1)).alias("mean_level"),
        F.coalesce(variance, F.lit(1 / 12)).alias("variance"),
    )


def joint_step(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, target: float, rate: float, most: float = 1.0) -> float:
    """One clipped gradient step on both matrices, in place, for half the squared error of the cosine of x a and y b; the cosine before it."""
    p, q = x @ a, y @ b
    size_p, size_q = np.linalg.norm(p) + 1e-9, np.linalg.norm(q) + 1e-9
    p, q = p / size_p, q / size_q
    cos = float(p @ q)
    for matrix, vector, own, other, size in ((a, x, p, q, size_p), (b, y, q, p, size_q)):
        slope = np.outer(vector, (cos - target) * (other - cos * own) / size)
        length = np.linalg.norm(slope)
        matrix -= rate * slope * (most / (length + 1e-9) if length > most else 1.0)
    return cos


def pair_passes(df: DataFrame, keys: list[str], by: list[str], x: str, y: str, target: str, sizes: tuple[int, int, int], rate: float = 0.01, passes: int = 1, most: float = 1.0, start: tuple[list, list] | None = None) -> DataFrame:
    """keys, x_matrix, y_matrix, loss_before, loss_after, n_pairs and passes: joint_step() over each key's pairs in the order of `by`, several times.

    sizes are the lengths of x, of y, and of the common space; start gives both matrices, row by row, or
    else they begin as the identity's part of that size. Vectors count with length one, targets are cut to
    -1..1. Pairs with a null, a number that isn't finite, another length, or a vector of length 0 go.
    loss is the mean of half the squared error over all pairs, before the first pass and after the last.

    Each step needs the matrices of the one before, so a key is one task's work. It streams: the pairs
    come once a pass, sorted by pass, and only the two matrices are held.
    """
    n_x, n_y, common = sizes

    def unit(v: str, n: int):
        doubles = F.col(v).cast("array<double>")
        fine = (F.size(doubles) == n) & F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, c: s + c * c))
        return F.when(fine & (length > 1e-12), F.transform(doubles, lambda c: c / length))

    label = F.col(target).cast("double")
    rows = df.select(*keys, *by, unit(x, n_x).alias("_x"), unit(y, n_y).alias("_y"), F.least(F.greatest(label, F.lit(-1.0)), F.lit(1.0)).alias("_t"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & label.isNotNull() & ~F.isnan(label))
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes + 1))))

    def step(members):
        a, b = (np.array(m, "float64") for m in start) if start else (np.eye(n_x, common), np.eye(n_y, common))
        loss, n = [0.0, 0.0], 0
        for *_, u, v, t, number in members:
            u, v = np.asarray(u, "float64"), np.asarray(v, "float64")
            if 0 < number <= passes:
                joint_step(a, b, u, v, t, rate, most)
                continue
            p, q = u @ a, v @ b
            cos = p @ q / ((np.linalg.norm(p) + 1e-9) * (np.linalg.norm(q) + 1e-9))
            loss[number > 0] += 0.5 * (cos - t) ** 2
            n += number == 0
        yield a.tolist(), b.tolist(), loss[0] / n, loss[1] / n, n, passes

    schema = "x_matrix array<array<double>>, y_matrix array<array<double>>, loss_before double, loss_after double, n_pairs long, passes int"
    return folded(rows, keys, ["_pass", *by], step, schema)
