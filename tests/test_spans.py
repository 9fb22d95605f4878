"""Series over many tasks: spans with carried rows, numbers, sums and halos give what one pass over each series gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import curves, intervals, sequence, spans


def tables(spark, n=600, seed=1):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(5000), n))  # no two rows of one side at one instant
    left = [("a" if rng.random() < 0.8 else rng.choice(["b", None]), t, i) for i, t in enumerate(times)]
    left += [("a", None, 9000), ("none", 5, 9001), ("a", times[3], 9002)]
    right = [(rng.choice(["a", "b", None]), t, t * 2.0) for t in rng.sample(range(5000), n // 6)] + [("a", times[10], -1.0), ("a", None, -2.0)]
    seen, unique = set(), []
    for k, t, v in right:
        if (k, t) not in seen:
            seen.add((k, t))
            unique.append((k, t, v))
    return left, unique, spark.createDataFrame(left, "k string, t long, i int"), spark.createDataFrame(unique, "k string, u long, v double")


@pytest.mark.parametrize("rows", [1_000_000, 50, 7])
def test_as_of_and_nearest_over_spans(spark, rows):
    left, right, l, r = tables(spark)
    back = {x.i: (x.u, x.v) for x in intervals.as_of(l, r, ["k"], "t", "u", ["v"], rows=rows).collect()}
    ahead = {x.i: (x.u, x.v) for x in intervals.as_of(l, r, ["k"], "t", "u", ["v"], "forward", rows=rows).collect()}
    near = {x.i: (x.u, x.distance) for x in intervals.nearest(l, r, ["k"], "t", "u", rows=rows).collect()}
    late = {x.i: x.u for x in intervals.nearest(l, r, ["k"], "t", "u", True, rows=rows).collect()}
    assert len(back) == len(ahead) == len(near) == len(left)
    for k, t, i in left:
        known = [(u, v) for key, u, v in right if key == k and u is not None] if t is not None else []
        before, after = [x for x in known if x[0] <= t], [x for x in known if x[0] >= t]
        assert back[i] == (max(before) if before else (None, None))
        assert ahead[i] == (min(after) if after else (None, None))
        assert near[i] == (min((abs(u - t), u) for u, _ in known)[::-1] if known else (None, None))
        assert late[i] == (min((abs(u - t), -u) for u, _ in known)[1] * -1 if known else None)


@pytest.mark.parametrize("rows", [1_000_000, 20])
def test_interpolation_over_spans(spark, rows):
    left, right, l, r = tables(spark, seed=2)
    got = {x.i: x.interpolated for x in intervals.interpolated(l, r, ["k"], "t", "u", "v", rows=rows).collect()}
    for k, t, i in left:
        known = sorted((u, v) for key, u, v in right if key == k and u is not None)
        if t is None or not known:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.interp(t, [u for u, _ in known], [v for _, v in known]))


def test_no_window_holds_a_whole_key(spark):
    """One user has all events: what a window sorts is a span, and only the spans' summaries are put in order by key."""
    n = 40_000
    l = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"))
    r = spark.range(n // 100).select(F.lit(1).alias("k"), (F.col("id") * 1000 + 5).alias("u"))
    out = intervals.as_of(l, r, ["k"], "t", "u", [], rows=2000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if " Window [" in line and "_span" not in line.split("[")[2]]
    assert all("_last" in line or "_first" in line for line in whole)
    assert len(spans.edges(l, "t", 2000)) == 19
    sizes = [x["count"] for x in spans.spanned(l, "t", spans.edges(l, "t", 2000)).groupBy("_span").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3000
    assert out.where(F.coalesce("u", F.lit(-1)) != F.coalesce(F.when(F.col("t") >= 5, F.floor((F.col("t") - 5) / 1000) * 1000 + 5), F.lit(-1))).count() == 0


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_numbers_and_sums(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", None]), rng.randrange(50), i, rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, i int, x double")
    numbered = spans.numbered(df, ["k"], ["t", "i"], rows=rows)
    got = {r.i: r.idx for r in numbered.collect()}
    summed = {r.i: r.s for r in spans.prefix_sums(numbered, ["k"], "idx", "x", "s", 16).collect()}
    for key in ("a", None):
        total = 0.0
        for n, (_, _, i, x) in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: d[1:3])):
            total += x
            assert got[i] == n
            assert summed[i] == pytest.approx(total)
    assert spans.numbered(df.where("false"), ["k"], ["t", "i"]).count() == 0


def test_halos_hold_all_neighbours(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("idx"))
    rows = spans.haloed(df, "idx", 10, 3).collect()
    held = {}
    for r in rows:
        held.setdefault(r._block, set()).add(r.idx)
    for r in rows:
        if r._own:
            assert {i for i in range(r.idx - 3, r.idx + 4) if 0 <= i < 100} <= held[r._block]
    assert sum(r._own for r in rows) == 100


def test_series_operators_over_many_blocks(spark, monkeypatch):
    """What a window over the key gives for short series is what blocks give for long ones."""
    rng = random.Random(5)
    times = rng.sample(range(4000), 500)
    rows = [("a" if i % 5 else rng.choice(["b", None]), t, i, rng.randrange(8) / 2) for i, t in enumerate(times)] + [("a", None, 900, 1.0), ("b", None, 901, 2.0)]
    df = spark.createDataFrame(rows, "k string, t long, i int, v double")
    label = df.withColumn("l", F.floor("v"))
    work = {
        "stretches": lambda: sequence.stretches(df, ["k"], "t", "i", 9, True),
        "mean": lambda: sequence.moving_average(df.where("t is not null"), ["k"], "t", "v", 5, "m"),
        "maxima": lambda: sequence.local_maxima(df.where("t is not null"), ["k"], "t", "v", 1.0),
        "runs": lambda: sequence.runs(label.where("t is not null"), ["k"], "t", "l"),
        "islands": lambda: sequence.islands(df.where("t is not null"), ["k"], "t", "v", 1.0, 6),
        "peaks": lambda: curves.sliding_peaks(df, ["k"], ["t", "i"], "v", 4, 0.5),
        "segments": lambda: curves.segments(df, ["k"], ["t", "i"], "v", "from", "to", F.lit(-1.0)),
        "contrast": lambda: curves.side_contrast(df, ["k"], ["t", "i"], "v", 3, "c"),
        "change": lambda: curves.change(df, ["k"], ["t", "i"], "v", "c"),
        "past": lambda: curves.against_past(df, ["k"], ["t", "i"], "v", 4, 1.5, 0.4, "kind"),
    }
    plain = {name: f() for name, f in work.items()}
    want = {name: sorted(map(repr, out.collect())) for name, out in plain.items()}
    monkeypatch.setattr(spans, "ROWS", 40)
    monkeypatch.setattr(spans, "BLOCK", 16)
    for name, f in work.items():
        out = f()
        assert out.columns == plain[name].columns, name
        assert sorted(map(repr, out.collect())) == want[name], name
        assert work[name]().where("false").count() == 0
    assert curves.change(df.where("false"), ["k"], ["t", "i"], "v", "c").count() == 0
