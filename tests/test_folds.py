"""Folds, planners and rhythm against brute force, and their behaviour on long series without a pause."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import intervals, planners, rhythm, sequence, signals
from cadenza.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def series(rng, n, keys="ab", most=400):
    return [(rng.choice(keys), float(rng.randrange(most)), i, round(rng.random(), 3)) for i in range(n)]


def by_key(data):
    out = {}
    for k, t, i, s in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, []).append((t, i, s))
    return out


def test_min_interval_and_groups_match_brute_force(spark):
    data = series(random.Random(1), 300)
    df = spark.createDataFrame(data, "k string, t double, i long, s double")
    spaced, anchored, running = [], [], []
    for k, events in by_key(data).items():
        kept, groups, means = [], [], []
        for t, i, s in events:
            if not kept or t - kept[-1][0] >= 7:
                kept.append((t, i, s))
            elif s > kept[-1][2]:
                kept[-1] = (t, i, s)
            if groups and t - groups[-1][0] <= 7:
                groups[-1].append(t)
            else:
                groups.append([t])
            if means and t - means[-1][0] <= 7:
                means[-1][1] += 1
                means[-1][0] += (t - means[-1][0]) / means[-1][1]
            else:
                means.append([t, 1])
        spaced += [(k, *x) for x in kept]
        anchored += [(k, g[0], sum(g) / len(g), len(g)) for g in groups]
        running += [(k, *m) for m in means]
    assert rows(sequence.min_interval(df, ["k"], "t", "i", "s", 7)) == sorted(spaced)
    assert rows(sequence.anchored_groups(df, ["k"], "t", "i", 7)) == sorted(anchored)
    assert rows(sequence.running_mean_groups(df, ["k"], "t", "i", 7)) == sorted(running)


def test_suppress_matches_brute_force_and_null_keys_stay(spark):
    data = [(None if k == "b" else k, t, i, s) for k, t, i, s in series(random.Random(2), 200)]
    df = spark.createDataFrame(data, "k string, t double, i long, s double")
    want = []
    for k in ("a", None):
        kept = []
        for _, t, i, s in sorted((r for r in data if r[0] == k), key=lambda r: (-r[3], r[1], r[2])):
            if all(abs(t - u) >= 9 for u, _, _ in kept):
                kept.append((t, i, s))
        want += [(k, *x) for x in kept]
    got = [tuple(r) for r in sequence.suppress(df, ["k"], "t", "i", "s", 9).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sequence.suppress(df.where("false"), ["k"], "t", "i", "s", 9).collect() == []


def test_long_series_without_a_pause(spark):
    df = spark.range(200_000).selectExpr("'a' as k", "cast(id as double) as t", "id as i", "cast(pmod(id * 7919, 1000) as double) as s")
    began = time.perf_counter()
    assert sequence.suppress(df, ["k"], "t", "i", "s", 5).count() > 20_000
    assert sequence.min_interval(df.withColumn("s", F.lit(1.0)), ["k"], "t", "i", "s", 5).count() == 40_000
    assert sequence.anchored_groups(df, ["k"], "t", "i", 4).count() == 40_000
    assert planners.chained(df.select("k", "i", "t", "s"), ["k"], "i", "t", lambda a, b: b["t"] - a["t"] < 10).count() == 20_000
    assert time.perf_counter() - began < 120


def test_planners_match_brute_force(spark):
    data = series(random.Random(3), 120, most=300)
    df = spark.createDataFrame(data, "k string, t double, i long, s double")
    beats, peaks, taken = [], [], []
    for k, events in by_key(data).items():
        t = sorted({e[0] for e in events})
        i, walked = 0, []
        while i < len(t):
            walked.append(t[i])
            near = [j for j in range(i + 1, len(t)) if 4 <= t[j] - t[i] <= 9]
            i = near[0] if near else i + 1
        beats += [(k, a, b) for a, b in zip(walked, walked[1:])]
        now = 0.0
        for p in t:
            if p - now > 0 and p - now >= 3:
                peaks.append((k, now, min(p - now, 12.0)))
                now += min(p - now, 12.0)
        end = None
        for a, i, _ in events:
            if end is None or a >= end:
                taken.append((k, i))
                end = a + 5
    assert rows(planners.beat_plan(df, ["k"], "t", 4.0, 9.0)) == sorted(beats)
    assert rows(planners.peak_plan(df, ["k"], "t", 3.0, 12.0)) == sorted(peaks)
    got = intervals.accepted(df.select("k", "t", "i", (F.col("t") + 5).alias("e")), ["k"], "t", "i", "e")
    assert rows(got.select("k", "i")) == sorted(taken)


def naive_absorb(segments, least):
    out = [list(s) for s in segments]
    while len(out) > 1:
        i = min(range(len(out)), key=lambda k: (out[k][1] - out[k][0], k))
        if out[i][1] - out[i][0] >= least:
            break
        j = min((j for j in (i - 1, i + 1) if 0 <= j < len(out)), key=lambda k: (abs(out[k][2] - out[i][2]), k))
        a, b = sorted((i, j))
        out[a : b + 1] = [[out[a][0], out[b][1], out[j][2]]]
    return [tuple(s) for s in out]


def test_absorbing_matches_the_naive_way():
    rng = random.Random(4)
    for _ in range(60):
        edges = sorted(rng.sample(range(1000), rng.randrange(2, 60)))
        segments = [(a, b, rng.randrange(5)) for a, b in zip(edges, edges[1:])]
        assert signals.absorb_short(segments, 25) == naive_absorb(segments, 25)


def naive_ward(points, count):
    groups = [[i] for i in range(len(points))]
    while len(groups) > count:
        def cost(pair):
            a, b = (np.mean(points[groups[i]], axis=0) for i in pair)
            n, m = (len(groups[i]) for i in pair)
            return ((a - b) ** 2).sum() * n * m / (n + m)

        a, b = min(((i, j) for j in range(len(groups)) for i in range(j)), key=cost)
        groups[a] += groups.pop(b)
    out = np.zeros(len(points), int)
    for number, g in enumerate(sorted(groups, key=min)):
        out[g] = number
    return out.tolist()


def test_ward_matches_the_naive_way(spark):
    p = np.random.default_rng(5).normal(size=(30, 3))
    assert signals.ward(p, 6).tolist() == naive_ward(p, 6)
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(p)] + [("b", 0, [1.0, 2.0, 3.0])], "k string, i long, v array<double>")
    got = {(r.k, r.i): r.cluster for r in signals.ward_clusters(df, ["k"], "i", "v").collect()}
    assert [got["a", i] for i in range(30)] == naive_ward(p, 8) and got["b", 0] == 0
    assert signals.ward_clusters(df, ["k"], "i", "v", most=5).count() == 31


def naive_prominent(curve, apart, least):
    n, peaks, i = len(curve), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and curve[j + 1] == curve[i]:
            j += 1
        if j < n - 1 and curve[i - 1] < curve[i] and curve[j + 1] < curve[i]:
            peaks.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(peaks, key=lambda p: (-curve[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        left, right = p, p
        while left > 0 and curve[left - 1] <= curve[p]:
            left -= 1
        while right < n - 1 and curve[right + 1] <= curve[p]:
            right += 1
        if curve[p] - max(min(curve[left : p + 1]), min(curve[p : right + 1])) >= least and apart <= p < n - apart:
            out.append(p)
    return out


def test_prominent_peaks(spark):
    rng = random.Random(6)
    for _ in range(80):
        curve = [float(rng.randrange(12)) for _ in range(rng.randrange(0, 60))]
        assert signals.prominent(curve, 3, 4.0) == naive_prominent(curve, 3, 4.0)
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 0, 0, 0, 5, 0, 0, 0, 9, 0, 0, 0, 0])], "k string, i long, v long")
    assert [r.i for r in signals.prominence_peaks(df, ["k"], "i", "v", 3, 4.0).orderBy("i").collect()] == [4, 8]


def test_hybrid_plan_snaps_and_moves_on(spark):
    # beats each second: a wanted length of 4.0 ends on one; loud places get shorter cuts
    beats = [float(i) for i in range(41)]
    quiet = planners.hybrid_cuts(beats, {8.0}, [0.0], 20.0, 2.0, 6.0, 3, 0.4, 1.0)
    assert quiet[0][:2] == (0.0, 4.0) and not quiet[0][3] and quiet[1][:2] == (4.0, 4.0) and quiet[1][3:] == (True, 1.0)
    loud = planners.hybrid_cuts(beats, set(), [1.0], 20.0, 2.0, 6.0, 3, 0.8, 1.0)
    assert len(loud) > len(quiet) and all(c[4] == 0.7 for c in loud) and all(a[0] + a[1] == b[0] for a, b in zip(loud, loud[1:]))
    assert all(c[1] >= 0.5 for c in planners.hybrid_cuts([0.05], set(), [], 3.0, 0.1, 0.2, 5, 1.0, 1.0))
    df = spark.createDataFrame([("a", beats, [8.0], [0.0], 20.0), ("b", None, None, None, 0.0), ("c", [], [], [], 5.0)], "k string, b array<double>, d array<double>, e array<double>, total double")
    got = rows(planners.hybrid_plan(df, ["k"], "b", "d", "e", "total", 2.0, 6.0, 3, 0.4, 1.0))
    assert [g[1:6] for g in got if g[0] == "a"] == quiet and not [g for g in got if g[0] == "b"] and [g for g in got if g[0] == "c"]
    for _, _, length, level, aligned, _, transition, confidence in got:
        assert transition == ("fade" if level < 0.3 else "crossfade" if level <= 0.7 else "hard_cut")
        assert abs(confidence - min(1, max(0, 0.5 + 0.3 * aligned + 0.2 * (1 - abs(length - 4.0) / 4.0)))) < 1e-12


def test_replacement_frames(spark):
    rng = random.Random(7)
    wanted = [("a", n, rng.randrange(60)) for n in range(30)]
    readable = sorted(rng.sample(range(60), 25))
    used, want = set(), []
    for _, n, at in wanted:
        for f in [at, *(x for i in range(1, 5) for x in (at - i, at + i))]:
            if f in readable and f not in used:
                used.add(f)
                want.append(("a", n, f))
                break
    got = planners.replacements(spark.createDataFrame(wanted, "k string, n long, at long"), spark.createDataFrame([("a", f) for f in readable], "k string, f long"), ["k"], "n", "at", "f", 4)
    assert rows(got) == sorted(want)


def test_tempo_of_a_pulse_and_its_octave(spark):
    pulse = [("a", 0.25 + i * 0.5, 1.0) for i in range(240)] + [("a", 0.1 + i * 1.7, 0.2) for i in range(60)]
    onsets = spark.createDataFrame(pulse, "k string, t double, s double")
    kicks = onsets.where("s = 1.0").select("k", F.col("t").alias("kick"))
    found = rhythm.tempo_search(onsets, ["k"], "t", "s", [97.0, 120.0, 133.0]).first()
    assert found.bpm == 120.0 and abs(found.anchor - 0.25) < 0.02 and found.contrast > 10
    close = rhythm.refined(onsets, spark.createDataFrame([("a", 121.0)], "k string, bpm double"), ["k"], "t", "s", 0.02, 41).first()
    assert abs(close.bpm - 120) < 0.3
    # half the tempo gathers as much in one phase; the kicks tell
    best = rhythm.estimated(onsets, kicks, ["k"], "t", "s", "kick", [60.0], 40.0, 200.0, 0.03).first()
    assert best.factor == 2.0 and abs(best.bpm - 120) < 0.5 and best.recall > 0.9 and best.precision > 0.9


def test_half_beat_and_hop(spark):
    frames = [("a", i, 9.0 if i % 10 == 5 else 1.0) for i in range(200)] + [("b", i, 9.0 if i % 10 == 0 else 1.0) for i in range(200)]
    frames += [("short", i, 9.0 if i % 10 == 5 else 1.0) for i in range(21)] + [("enough", i, 9.0 if i % 10 == 5 else 1.0) for i in range(22)]
    energy = spark.createDataFrame(frames, "k string, i long, v double")
    grids = spark.createDataFrame([("a", 60.0, 0.0), ("b", 60.0, 0.0), ("c", 60.0, 0.4), ("short", 60.0, 0.0), ("enough", 60.0, 0.0), ("a2", 0.0, 0.7)], "k string, bpm double, anchor double")
    got = {r.k: (r.shifted, round(r.anchor, 6)) for r in rhythm.resolved_phase(energy, grids, ["k"], "i", "v", 0.1, 1.2).collect()}
    # no energy, two beats and no tempo leave the anchor where it is
    assert got == {"a": (True, 0.4), "b": (False, 0.9), "c": (False, 0.4), "short": (False, 0.0), "enough": (True, 0.4), "a2": (False, 0.7)}


def test_progress_blocks(spark):
    lines = ["frame=1", "fps = 20", "junk", "progress=continue", "frame=2", "frame=3", "progress=end", "frame=9"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("t", 0, "frame=1")], "k string, n long, line string")
    got = [(r.k, r.block, r.ended, r["values"]) for r in windows.progress_blocks(df, ["k"], "n", "line").orderBy("block").collect()]
    assert got == [("s", 0, False, {"frame": "1", "fps": "20", "progress": "continue"}), ("s", 1, True, {"frame": "3", "progress": "end"})]


def test_fitted_pairs_one_by_one(spark):
    rng = np.random.default_rng(8)
    pairs = [("a", i, rng.normal(size=3).tolist(), rng.normal(size=2).tolist(), 1.0) for i in range(20)]
    got = signals.fitted(spark.createDataFrame(pairs, "k string, i long, a array<double>, b array<double>, t double"), ["k"], "i", "a", "b", "t", 0.1).first()
    w = np.eye(2, 3)
    for _, _, a, b, t in pairs:
        w = signals.pair_step(w, np.array(a), np.array(b), t, 0.1)
    assert got.steps == 20 and np.allclose(np.array(got.weights), w)
    x, y = np.array(pairs[0][2]), np.array(pairs[0][3])
    cos = lambda m: (m @ x) @ y / np.linalg.norm(m @ x) / np.linalg.norm(y)
    assert cos(signals.pair_step(np.eye(2, 3), x, y, 1.0, 0.01)) > cos(np.eye(2, 3))


def test_band_pass_keeps_phase(spark):
    t = np.arange(4000) / 1000
    low, mid, high = (np.sin(2 * np.pi * f * t) for f in (5, 60, 300))
    out = signals.band_pass(low + mid + high, 1000, 30, 120)
    assert np.abs(out - mid)[300:-300].max() < 0.05
    # at both edges of the band two passes halve the amplitude
    edge = signals.band_pass(np.sin(2 * np.pi * 120 * t), 1000, 30, 120)
    assert abs(np.abs(edge[500:-500]).max() - 0.5) < 0.02
    df = spark.createDataFrame([(1, mid.tolist(), 1000), (2, None, 1000), (3, [1.0], 1000), (4, [], 1000)], "i int, x array<double>, r int")
    got = {r.i: r.y for r in signals.band_passed(df, "x", "r", 30, 120, "y").collect()}
    assert np.abs(np.array(got[1]) - mid)[300:-300].max() < 0.05 and got[2] is None and got[3] == [0.0] and got[4] == []
