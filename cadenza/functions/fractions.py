"""Exact rates: the nearest fraction with a bounded denominator, by continued fractions over Arrow batches of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The usual bound.
MOST = 1_000_000


def _nearest(num, den, most):
    """(num, den) of the fractions nearest to whole numbers of up to 18 digits, den over 0; all numbers that count stay below 2**63."""
    import numpy as np

    n, d = np.abs(num), den.copy()
    p0, q0, p1, q1 = np.zeros_like(n), np.ones_like(n), np.ones_like(n), np.zeros_like(n)
    at = np.arange(len(n))
    while len(at):
        at = at[d[at] > 0]
        a = n[at] // d[at]
        # the next denominator q0 + a * q1 may not fit the bound, nor a long number
        fits = (q0[at] <= most[at]) & ((q1[at] == 0) | (a <= (most[at] - q0[at]) // np.maximum(q1[at], 1)))
        at, a = at[fits], a[fits]
        p0[at], q0[at], p1[at], q1[at] = p1[at], q1[at], p0[at] + a * p1[at], q0[at] + a * q1[at]
        n[at], d[at] = d[at], n[at] - a * d[at]
    k = np.where(q1 > 0, (most - q0) // np.maximum(q1, 1), 0)
    # where a rest is left, both fit: the convergent lies d / (q1 den) away, the other one 1 / (q1 q) less that
    with np.errstate(over="ignore"):
        p, q = p0 + k * p1, q0 + k * q1
    last = (d == 0) | (d <= den // np.maximum(2 * q, 1))
    return np.where(num < 0, -1, 1) * np.where(last, p1, p), np.where(last, q1, q)


@F.arrow_udf(T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]))
def _nearest_batch(num, den, most):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ok = pc.fill_null(pc.and_(pc.and_(pc.is_valid(num), pc.is_valid(most)), pc.greater(den, 0)), False).to_numpy(zero_copy_only=False)
    full = lambda a: pc.fill_null(a, 1).to_numpy(zero_copy_only=False).astype("int64")[ok]
    found = np.zeros((2, len(ok)), "int64")
    if ok.any():
        found[:, ok] = _nearest(full(num), full(den), full(most))
    return pa.StructArray.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["num", "den"], mask=pa.array(~ok))


def nearest_fraction(num: Column, den: Column, most: Column | int = MOST) -> Column:
    """struct<num, den>: the fraction nearest to num/den whose denominator is `most` at most, reduced; of two equally near the one of the smaller denominator.

    num and den are whole numbers of up to 18 digits, den over 0. The convergents of the continued
    fraction are followed while their denominators fit; then either the last one or the last that lies
    between it and the next is nearest. Nulls, and den of 0 or less, give null.
    """
    most = most if isinstance(most, Column) else F.lit(most)
    return _nearest_batch(num.cast("long"), den.cast("long"), most.cast("long"))


def rate_fraction(text: Column, most: int = MOST) -> Column:
    """struct<num, den> of a rate written as a decimal (23.976) or a fraction (24000/1001), which stays exact; what isn't such a number of up to 17 digits, or isn't over 0, gives null."""
    plain = F.trim(text)
    ratio = F.rlike(plain, F.lit("^[0-9]{1,17}/[0-9]{1,17}$"))
    decimal = F.rlike(plain, F.lit(r"^(?=.*[0-9])[0-9]*[.]?[0-9]*$")) & (F.length(plain) <= 18)
    places = F.when(F.contains(plain, F.lit(".")), F.length(plain) - F.instr(plain, ".")).otherwise(0)
    num = F.when(ratio, F.substring_index(plain, "/", 1)).when(decimal, F.replace(plain, F.lit("."), F.lit(""))).try_cast("long")
    den = F.when(ratio, F.substring_index(plain, "/", -1).try_cast("long")).when(decimal, F.rpad(F.lit("1"), places + 1, F.lit("0")).cast("long"))
    return nearest_fraction(F.when(num > 0, num), den, F.when(ratio, F.lit(10**18)).otherwise(F.lit(most)))
