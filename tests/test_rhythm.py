"""Tempi of series that are streams: the same whether a series is dealt to several streams or not, and beats that are never listed."""

import random

from pyspark.sql import functions as F

from cadenza.operators import rhythm


def onsets(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(0, 300), rng.choice([rng.random(), 0.0, None])) for k in ("a", "b", None) for _ in range(300 if k == "a" else 40)]
    return spark.createDataFrame([*rows, ("b", None, 0.5), ("c", 1.0, 0.0)], "k string, t double, s double")


def test_candidates_do_not_multiply_what_is_moved(spark):
    tempi = spark.createDataFrame([("a", 100.0), ("b", 120.0)], "k string, bpm double")
    few, many = (rhythm.refined(onsets(spark), tempi, ["k"], "t", "s", 0.05, n)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 99))
    assert "Generate" not in few and few.count("RepartitionByExpression") == many.count("RepartitionByExpression") == 1


def test_series_over_several_streams(spark, monkeypatch):
    o = onsets(spark)
    tempi = spark.createDataFrame([("a", 100.0, 1.0), ("a", 50.0, 0.5), ("b", 120.0, 1.0)], "k string, bpm double, factor double")
    work = lambda: [sorted(map(str, f.collect())) for f in (rhythm.tempo_search(o, ["k"], "t", "s", [90.0, 100.0]), rhythm.refined(o, tempi, ["k"], "t", "s", 0.05, 9, names=["factor"]))]
    whole = work()
    monkeypatch.setattr(rhythm, "ROWS", 64)
    assert work() == whole and len(whole[0]) == 3 and len(whole[1]) == 3


def test_beats_that_are_not_listed(spark):
    rng = random.Random(6)
    grids = spark.createDataFrame([(k, f, 60.0 * f, 0.25, span) for k, span in (("a", 40.0), ("b", 0.1), ("c", 9.0), ("d", 0.1)) for f in (0.5, 1.0, 3.0)], "k string, factor double, bpm double, anchor double, span double")
    kicks = spark.createDataFrame([("a", round(rng.uniform(-2, 45), 2)) for _ in range(60)] + [("a", None), ("b", 1.0), ("a", 1.25), ("a", 1.25)], "k string, kick double")
    for tolerance in (0.05, 0.3, 2.5):
        got = rhythm.grid_agreement(grids, kicks, ["k"], "span", "kick", tolerance)
        by = ["k", "factor"]
        want = rhythm.agreement(rhythm.beats(grids, by, "span"), kicks.join(grids.select(*by), "k"), by, "beat", "kick", tolerance)
        r = lambda df: sorted(map(tuple, df.select("k", "factor", F.round("recall", 9), F.round("precision", 9)).collect()))
        assert r(got) == r(want)
