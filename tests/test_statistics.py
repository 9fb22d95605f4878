"""Group, curve and score operators on rows made by hand: ties, nulls, constants, empty tables."""

from pyspark.sql import functions as F

from cadenza.functions import scoring
from cadenza.operators import curves, statistics


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def curve(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, i long, v double")


def test_peaks_and_plateaus(spark):
    c = curve(spark, [1, 3, 3, 1, 0, 0, 0, 0, 0, 2])
    assert [r.i for r in curves.sliding_peaks(c, ["k"], ["i"], "v", 2).orderBy("i").collect()] == [1, 2, 9]
    assert curves.sliding_peaks(curve(spark, [0, 0, 0]), ["k"], ["i"], "v", 1).collect() == []


def test_silent_and_constant_series(spark):
    c = curve(spark, [0, 0, 0, 0])
    assert {r.o for r in curves.scaled_by_max(c, ["k"], "v", "o").collect()} == {0.0}
    assert {r.o for r in curves.fused(c, ["k"], {"v": 1.0}, "o").collect()} == {0.0}
    assert statistics.energy_shares(c, "k", "v").first().share == 0.0
    assert statistics.percentile_scale(c.unionByName(curve(spark, [1e-9], "b")), ["k"], "v").collect()[0].scale == 1.0
    assert statistics.phase_contrast(c, ["k"], "i", 1, 4, "v").first().ratio is None
    assert [r.o for r in curves.against_past(c, ["k"], ["i"], "v", 2, 1.5, 0.5, "o").orderBy("i").collect()] == ["none"] * 4


def test_ties(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 5.0), ("a", 3, 4.0)], "k string, x long, s double")
    assert rows(statistics.winner(df, ["k"], "x", "s")) == [("a", 1, 5.0)]
    names = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("a", "y")], "k string, n string")
    assert rows(statistics.most_common(names, ["k"], "n", "mood")) == [("a", "y")]
    assert rows(statistics.top_bins(df, ["k"], "s", 1.0, 1)) == [("a", 5, 2)]
    assert rows(statistics.top_by_variance(df.unionByName(df.withColumn("k", F.lit("b"))), "k", "s", 1))[0][0] == "a"


def test_nulls_and_empty_tables(spark):
    c = curve(spark, [1, None, 3])
    none = c.where("false")
    assert statistics.total(none, "v", "t", 2).first().t == 0.0
    assert statistics.rounded_count(none, F.col("v") > 0, 5.0, "n").first().n == 0
    assert statistics.plausible_median(c, ["k"], "v", 10, 20, "m").first().m == 0.0
    assert statistics.plausible_median(curve(spark, [30, 300, 31, None]), ["k"], "v", 30, 300, "m").first().m == 31.0
    assert [r.c for r in curves.change(c, ["k"], ["i"], "v", "c").orderBy("i").collect()] == [None, None, None]
    assert statistics.weighted_mean(c.withColumn("w", F.lit(0.0)), ["k"], "v", "w", "m").first().m is None
    for f in (lambda d: curves.split_means(d, ["k"], ["i"], "v", 3), lambda d: curves.latest(d, ["k"], ["i"]), lambda d: statistics.tertiles(d, ["k"], "v", ("a", "b", "c"), "o"), lambda d: statistics.energy_shares(d, "k", "v")):
        assert f(none).collect() == []


def test_blocks_retention_and_order(spark):
    c = curve(spark, range(10))
    assert [r["mean"] for r in curves.split_means(c, ["k"], ["i"], "v", 4).orderBy("bucket").collect()] == [1.0, 4.0, 6.5, 8.5]
    assert [r.i for r in curves.without_oldest(c, ["k"], ["i"], 0.25).orderBy("i").collect()] == list(range(2, 10))
    assert [r.i for r in curves.latest(c, ["k"], ["i"], 2).orderBy("i").collect()] == [8, 9]
    gone = curves.beyond_retention(c.unionByName(spark.createDataFrame([("a", None, 0.0)], c.schema)), ["k"], ["i"], "i", F.lit(2), 5)
    assert sorted(r.i for r in gone.collect()) == [0, 1, 2, 3, 4]
    assert [(r.a, r.b) for r in curves.segments(c.where("i < 3"), ["k"], ["i"], "i", "a", "b", F.lit(0).cast("long")).orderBy("b").collect()] == [(0, 0), (0, 1), (1, 2)]
    side = {r.i: r.o for r in curves.side_contrast(c, ["k"], ["i"], "v", 2, "o").collect()}
    assert side[0] is None and side[5] == 2.0


def test_histogram_states_and_scores(spark):
    df = spark.createDataFrame([("a", 10.0, "O"), ("a", 10.5, "F"), ("b", 9999.0, "F"), ("b", 50.0, None)], "k string, v double, s string")
    assert rows(statistics.fixed_histogram(df, ["k"], "v", [10, 50], 1000)) == [("a", 10, 1), ("a", 50, 1), ("b", 1000, 1), ("b", 50, 1)]
    assert rows(statistics.precedence(df, ["k"], "s", [("P", "partial"), ("O", "open")], "completed", "x")) == [("a", "open"), ("b", "completed")]
    value = lambda c: spark.range(1).select(c).first()[0]
    n = lambda x: F.lit(x).cast("double")
    assert value(scoring.share_of_full(n(None), 30)) == 0.5 and value(scoring.share_of_full(n("NaN"), 30)) == 0.5 and value(scoring.share_of_full(n(60.0), 30)) == 1.0
    assert value(scoring.confidence_of(F.lit(None).cast("string"), {"F": 1.0})) == 0.0
    assert value(scoring.signed_factor(n(-2.0), n(1.0))) == -1.0 and value(scoring.signed_factor(n(2.0), n(1.0))) == 4.0
    assert value(scoring.transition_kind(n(0.9), F.lit(False))) == "crossfade"
