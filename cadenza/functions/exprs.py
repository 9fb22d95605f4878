"""Scalar and array expressions with the edge cases fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(x: Column) -> Column:
    """0..1; NaN gives 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def held(x: Column, use) -> Column:
    """use(x) with x worked out once a row, however often use names it. A column that stands in a function of an array's members would be worked out for each of them."""
    return F.element_at(F.transform(F.array(x), use), 1)


def dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Plain cosine in -1..1; a zero vector gives 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def cosine01(a, b) -> Column:
    """Cosine mapped to 0..1; different sizes or a zero vector give null, NaN gives 0."""
    n = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (n > 0)
    return F.when(ok, clip01((dot(a, b) / n + 1) / 2))


def l2_normalised(a, least: float = 1e-8) -> Column:
    """The unit vector; one shorter than `least` stays as it is."""
    return held(norm(a), lambda n: F.when(n > least, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def fitted(a, size: int) -> Column:
    """Cut or padded with zeros to a size."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)


def interpolated(a, position: Column) -> Column:
    """Linear interpolation at a 0-based position of an array, clamped at its ends."""
    last = F.size(a) - 1
    p = F.greatest(F.lit(0.0), F.least(position, last.cast("double")))
    low = F.floor(p).cast("int")
    high = F.least(low + 1, last)
    x, y = F.element_at(a, low + 1), F.element_at(a, high + 1)
    return x + (y - x) * (p - low)


def mmss(seconds: Column) -> Column:
    """MM:SS with minutes that don't wrap."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def jaccard(a, b) -> Column:
    """Share of common members; an empty side gives 0.5."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(F.size(F.array_intersect(a, b)) / either)


def checked_unit(a, size: int, least: float = 1e-8) -> Column:
    """The unit vector with NaN taken as 0; null for another size or a length under `least`."""
    clean = F.transform(a, lambda x: F.when(F.isnan(x), 0.0).otherwise(x.cast("double")))
    unit = lambda c: held(norm(c), lambda n: F.when((F.size(a) == size) & (n > least), F.transform(c, lambda x: x / n)))
    return held(clean, unit)


def projected(a: Column, matrix: list[list[float]], least: float = 1e-6) -> Column:
    """The unit vector of a's unit vector times a matrix (one list per component of a); null for another size or no length."""
    u = checked_unit(a, len(matrix), least)
    columns = [F.array(*[F.lit(float(r[j])) for r in matrix]) for j in range(len(matrix[0]))]
    unit = lambda o: held(norm(o), lambda n: F.when(n > least, F.transform(o, lambda x: x / n)))
    return held(u, lambda v: F.when(v.isNotNull(), held(F.array(*[dot(v, c) for c in columns]), unit)))


def peak_buckets(samples: Column, n: int) -> Column:
    """The largest magnitude of each of n equal buckets of whole size; samples past the last go, missing ones give 0."""
    size = F.greatest(F.lit(1), F.floor(F.size(samples) / n).cast("int"))
    bucket = lambda i: F.coalesce(F.array_max(F.transform(F.slice(samples, i * size + 1, size), F.abs)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.size(samples) > 0, bucket(i)).otherwise(F.lit(0.0)))
