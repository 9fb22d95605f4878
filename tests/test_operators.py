"""Edge cases by hand: empty tables, ties, nulls, thresholds, and brute-force twins of what SQL can't say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs, ids, scoring, text
from cadenza.operators import blocks, catalog, intervals, planners, selection, sequence, signals, stores


def one(df):
    return df.first()[0]


def value(spark, column):
    return one(spark.range(1).select(column))


def series(spark, times, key="a", strength=None):
    rows = [(key, float(t), i, float(strength[i] if strength else 1.0)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "k string, t double, i long, s double")


def test_min_interval_moves_the_anchor(spark):
    out = sequence.min_interval(series(spark, [0, 2, 5.5], strength=[1, 2, 1]), ["k"], "t", "i", "s", 4.0)
    assert [r.t for r in out.orderBy("t").collect()] == [2.0]  # 5.5 is 3.5 after the moved anchor


def test_min_interval_keeps_an_exact_gap_and_nothing_of_nothing(spark):
    e = series(spark, [0, 4])
    assert sequence.min_interval(e, ["k"], "t", "i", "s", 4.0).count() == 2
    assert sequence.min_interval(e.where("false"), ["k"], "t", "i", "s", 4.0).count() == 0


def test_groups_are_anchored_at_their_first(spark):
    out = sequence.anchored_groups(series(spark, [0, 4, 8, 12]), ["k"], "t", "i", 5.0).orderBy("first_at").collect()
    assert [(r.first_at, r.n) for r in out] == [(0.0, 2), (8.0, 2)]  # a chain by neighbours would make one group


def test_a_time_at_the_end_belongs_to_the_next_interval(spark):
    p = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t long")
    i = spark.createDataFrame([("a", 0, 10, "x"), ("a", 10, 20, "y")], "k string, s long, e long, label string")
    out = {(r.k, r.t): r.label for r in intervals.containing(p, i, ["k"], "t", "s", "e", 5).collect()}
    assert out == {("a", 10): "y", ("a", 20): None, ("b", 5): None}


def test_as_of_and_nearest_ties(spark):
    p = spark.createDataFrame([("a", 5)], "k string, t long")
    q = spark.createDataFrame([("a", 3), ("a", 7)], "k string, u long")
    assert intervals.nearest(p, q, ["k"], "t", "u").first().u == 3
    assert intervals.nearest(p, q, ["k"], "t", "u", later_wins=True).first().u == 7
    assert intervals.nearest(p, q.where("false"), ["k"], "t", "u").first().distance is None
    assert intervals.as_of(p, q, ["k"], "t", "u", []).first().u == 3


def test_interpolation_is_clamped(spark):
    p = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 20.0)], "k string, t double")
    a = spark.createDataFrame([("a", 4.0, 1.0), ("a", 8.0, 3.0)], "k string, u double, v double")
    out = {r.t: r.interpolated for r in intervals.interpolated(p, a, ["k"], "t", "u", "v").collect()}
    assert out == {0.0: 1.0, 5.0: 1.5, 20.0: 3.0}


def test_accepted_intervals_match_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [("k", int(s), i, int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 300, 80), rng.integers(1, 12, 80), strict=True))]
    got = {r.i for r in intervals.accepted(spark.createDataFrame(rows, "k string, s long, i long, e long"), ["k"], "s", "i", "e").collect()}
    want, end = set(), -1
    for _, s, i, e in sorted(rows, key=lambda r: (r[1], r[2])):
        if s >= end:
            want.add(i)
            end = e
    assert got == want


def test_beat_plan_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.choice([0.3, 0.5, 1.1, 7.0, 15.0], 200)).round(3).tolist()
    got = sorted((r.start, r.end) for r in planners.beat_plan(series(spark, t), ["k"], "t", 2.0, 6.0).collect())
    want, i = [], 0
    while i < len(t) - 1:
        inside = [b for b in t[i + 1 :] if t[i] + 2.0 <= b <= t[i] + 6.0]
        end = inside[0] if inside else t[i + 1]
        want.append((t[i], end))
        i = t.index(end)
    assert got == want


def test_grid_cuts_or_joins_its_tail(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 8.5), (3, 0.5), (4, 0.0)], "k int, total double")
    out = planners.grid(t, "total", F.lit(4.0), 1.0).orderBy("k", "n").collect()
    assert [(r.k, r.start, r.length) for r in out] == [(1, 0.0, 4.0), (1, 4.0, 4.0), (1, 8.0, 2.0), (2, 0.0, 4.0), (2, 4.0, 4.5), (3, 0.0, 0.5)]


def test_even_indices_round_halves_to_even(spark):
    assert value(spark, planners.evenly_spaced(F.lit(6), 3)) == [0, 2, 5]
    assert value(spark, planners.evenly_spaced(F.lit(1), 5)) == [0]
    assert value(spark, planners.evenly_spaced(F.lit(0), 5)) == []


def test_gaps_before_between_and_after(spark):
    c = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.5), ("a", 5.0, 6.0)], "k string, s double, e double")
    out = sorted((r.gap_start, r.gap_end) for r in planners.gaps(c, ["k"], "s", "e", F.lit(9.0), 0.1).collect())
    assert out == [(0.0, 1.0), (3.0, 5.0), (6.0, 9.0)]


def test_recency_and_usage_match_loops(spark):
    rng = np.random.default_rng(5)
    rows = [("k", t, c, float(s)) for t in range(30) for c, s in enumerate(rng.random(5).round(3))]
    df = spark.createDataFrame(rows, "k string, t long, c long, s double")
    recent = [r.c for r in selection.without_recent(df, ["k"], "t", "c", "s", 2).orderBy("t").collect()]
    assert all(a != b for a, b in zip(recent, recent[1:], strict=False)) and all(a != b for a, b in zip(recent, recent[2:], strict=False))
    used, want = {}, []
    for t in range(30):
        c = min((r for r in rows if r[1] == t), key=lambda r: (-r[3] / (1 + 0.5 * used.get(r[2], 0)), r[2]))[2]
        used[c] = used.get(c, 0) + 1
        want.append(c)
    assert [r.c for r in selection.with_usage_penalty(df, ["k"], "t", "c", "s").orderBy("t").collect()] == want


def test_partition_is_optimal():
    rng = np.random.default_rng(2)
    unit = np.vstack([np.tile(rng.normal(size=4), (6, 1)), np.tile(rng.normal(size=4), (7, 1))]) + rng.normal(size=(13, 4)) * 0.05
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)

    def worth(cuts):
        edges = [0, *cuts, 13]
        return sum((unit[a:b].sum(0) ** 2).sum() / (b - a) - 0.5 for a, b in zip(edges, edges[1:], strict=False))

    every = [[]] + [[i] for i in range(3, 11)] + [[i, j] for i in range(3, 11) for j in range(i + 3, 11)] + [[3, 6, 9], [3, 6, 10], [3, 7, 10], [4, 7, 10]]
    assert signals.partition_cuts(unit, 3, 13, 0.5) == max(every, key=worth) == [6]
    assert signals.partition_cuts(unit[:4], 3, 13, 0.5) == []


def test_novelty_equals_the_checkerboard(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 3))
    df = spark.createDataFrame([("k", i, [float(x) for x in r]) for i, r in enumerate(m)], "k string, i long, v array<double>")
    got = {r.i: r.novelty for r in signals.novelty(df, ["k"], "i", "v", 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    for i in range(3, 10):
        a, b = slice(i - 3, i), slice(i, i + 3)
        assert got[i] == pytest.approx(s[a, a].mean() + s[b, b].mean() - 2 * s[a, b].mean())


def test_short_segments_join_the_nearer_level():
    assert signals.absorb_short([(0, 10, 1.0), (10, 11, 5.0), (11, 20, 6.0)], 2) == [(0, 10, 1.0), (10, 20, 6.0)]
    assert signals.absorb_short([(0, 1, 1.0)], 2) == [(0, 1, 1.0)]


def test_ward_and_pair_fit():
    p = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert signals.ward(p, 3).tolist() == [0, 0, 1, 1, 2]
    a, b = np.eye(3), np.roll(np.eye(3), 1, axis=1)
    w = np.eye(3)
    for _ in range(200):
        for x, y in zip(a, b, strict=True):
            w = signals.pair_step(w, x, y, 1.0, 0.2)
    assert all((w @ x) @ y / np.linalg.norm(w @ x) > 0.9 for x, y in zip(a, b, strict=True))


def test_dense_ids_without_one_task(spark):
    df = spark.createDataFrame([(i * i,) for i in range(50)], "k long")
    out = stores.dense_ids(df, "k", "n", ranges=7).orderBy("k").collect()
    assert [r.n for r in out] == list(range(50))
    assert stores.dense_ids(df.where("false"), "k", "n").count() == 0


def test_wrong_dimension_raises(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "i int, v array<double>")
    b = spark.createDataFrame([(2, [1.0])], "i int, v array<double>")
    with pytest.raises(Exception, match="another dimension"):
        stores.appended_vectors(a, b, "v").collect()
    assert stores.appended_vectors(a.where("false"), b, "v").count() == 1


def test_replay_tells_what_is_lost(spark):
    j = spark.createDataFrame([(i,) for i in range(1, 11)], "seq long")
    c = spark.createDataFrame([("new", 0), ("near", 8), ("up", 10)], "c string, seen long")
    out = stores.replay(j, c, "c", "seq", "seen", 4).collect()
    assert sorted((r.c, r.seq, r.gap) for r in out) == [("near", 9, False), ("near", 10, False), *[("new", i, True) for i in range(7, 11)]]


def test_upsert_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, r int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 1), (3, "v", 0)], "k int, v string, r int")
    once = catalog.upsert(a, b, ["k"], "r")
    assert sorted(once.collect()) == sorted(catalog.upsert(once, b, ["k"], "r").collect()) == [(1, "x", 1), (2, "z", 2), (3, "w", 1)]


def test_expressions(spark):
    nan = F.lit(float("nan"))
    assert value(spark, exprs.clip01(nan)) == 0.0
    zero, unit = F.array(F.lit(0.0)), F.array(F.lit(1.0))
    assert value(spark, exprs.cosine01(zero, unit)) is None and value(spark, exprs.cosine(zero, unit)) == 0.0
    assert value(spark, scoring.at_share(F.array(*[F.lit(i) for i in range(4)]), F.lit(1.0))) == 3
    assert value(spark, scoring.at_span(F.array(*[F.lit(i) for i in range(4)]), F.lit(0.99))) == 2
    assert value(spark, scoring.progress(nan, F.lit(False))) == 0.0 and value(spark, scoring.progress(F.lit(100.0), F.lit(False))) == 99.9
    assert value(spark, scoring.blacklist_size(F.lit(1), 0.6, 2)) == 0
    assert value(spark, blocks.best_key(F.array(*[F.lit(float(x)) for x in blocks.MAJOR])))["key"] == "C major"
    with pytest.raises(Exception, match="bounds cross"):
        value(spark, scoring.interval_bounds([F.lit(3.0), F.lit(1.0)], [F.lit(2.0), F.lit(9.0)])["high"])


def test_identifiers(spark):
    import uuid

    assert value(spark, ids.uuid5(F.lit("a name"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a name"))
    assert value(spark, ids.uuid5(F.lit(None).cast("string"))) is None
    a = ids.operation_id(F.lit("x"), F.lit(1), F.array(F.lit(2), F.lit(1)))
    assert value(spark, a) == value(spark, ids.operation_id(F.lit("x"), F.lit(1), F.array(F.lit(1), F.lit(2))))


def test_texts(spark):
    raw = F.lit("Sunset, sunset beach; sunset sky, sunset sea, the, a very long tag of words\nCity")
    assert value(spark, text.parsed_tags(raw, ["the"], 12)) == ["sunset", "sunset beach", "sunset sky", "city"]
    assert value(spark, text.narrative(F.lit("Answer: - One.  Two! Three? Four."), ["answer:"])) == "One. Two! Three?"
    assert value(spark, text.paths_below(F.lit('{"a":{"clip_path":"/x","other":1},"path":"/y","Path2":[{"b":"/z/../q"},"rel"],"no":"/n"}'), "path")) == ["/q", "/x", "/y"]
    assert value(spark, text.paths_below(F.lit("{broken"), "path")) == [] and value(spark, text.paths_below(F.lit(None).cast("string"), "path")) == []
    assert value(spark, text.parsed_tags(F.lit(None).cast("string"), [], 3)) == []
