"""Timelines against plain loops: each part takes the best clip left by the uses before it, and no gap stays open."""

import random

import numpy as np
import pytest

from cadenza.operators import composer

R = lambda x: None if x is None else round(float(x), 6)


def in_turn(scores, n):
    """Greedy choice one by one."""
    used, out = dict.fromkeys(scores, 0), []
    for _ in range(n):
        c = min(scores, key=lambda c: (-max(scores[c], 0.0) * (1 / (1 + used[c] * 0.5)), c))
        used[c] += 1
        out.append(c)
    return out


def test_clips_are_assigned_as_one_by_one(spark):
    rng = random.Random(2)
    parts, scores, want = [], [], {}
    for k in range(25):
        n, clips = rng.randrange(0, 40), rng.randrange(0, 12)
        own = {c: rng.choice([0.0, 0.5, 0.5, 0.75, -0.2, rng.random()]) for c in rng.sample(range(100), clips)}
        parts += [(k, i, float(i)) for i in range(n)]
        scores += [(k, c, s) for c, s in own.items()]
        if own:
            want[k] = in_turn(own, n)
    p, s = spark.createDataFrame(parts, "k int, n long, start double"), spark.createDataFrame(scores, "k int, clip int, score double")
    got = {}
    for r in composer.assigned(p, s, ["k"], "clip").orderBy("k", "n").collect():
        got.setdefault(r.k, []).append(r.clip)
    assert got == {k: w for k, w in want.items() if w}
    assert composer.assigned(p.where("false"), s, ["k"], "clip").count() == 0


def song(rng, k):
    total = rng.uniform(20, 60)
    beats = sorted({round(rng.uniform(-1, total + 2), 3) for _ in range(rng.randrange(0, 60))})
    return {
        "k": k, "total": total, "every": rng.choice([2, 4]), "beats": beats, "downbeats": [b + rng.choice([0, 0.04, 0.06]) for b in beats if rng.random() < 0.3],
        "energy": [(t / 2, rng.random()) for t in range(int(total))] if rng.random() < 0.9 else [], "scores": {c: round(rng.random(), 2) for c in range(6)} if rng.random() < 0.9 else {},
    }


def compose(s, clips, ends):
    points = [b for i, b in enumerate(b for b in s["beats"] if 0 <= b <= s["total"]) if i % s["every"] == 0]
    points = sorted({*points, *((0.0, s["total"]) if ends else ())})
    n = len(points) - 1
    if n < 1 or not s["scores"]:
        return [], []

    def level(t):
        if not s["energy"]:
            return None
        return next((v for e, v in s["energy"] if e >= t), s["energy"][-1][1])

    kind = lambda v: None if v is None else "cut" if v > 0.7 else "fade" if v < 0.3 else "dissolve"
    rows = []
    for i, (a, b, c) in enumerate(zip(points, points[1:], in_turn(s["scores"], n), strict=False)):
        length, motion = clips[c]
        e = level(a)
        fit = None if e is None else 1 - abs(motion - e)
        on = any(abs(a - d) < composer.ON_BEAT for d in s["downbeats"])
        rows.append((R(a), R(b), c, R(s["scores"][c]), R(fit), R(None if fit is None else (s["scores"][c] + fit) / 2), "cut" if on else kind(e) or "dissolve" if e is not None else "cut" if on else "dissolve", "cut" if i == n - 1 else kind(level(points[i + 1])) or "dissolve", min(length, b - a)))
    return rows, points


@pytest.mark.parametrize("ends", [True, False])
def test_composed_timelines(spark, ends):
    rng = random.Random(11)
    songs = [song(rng, k) for k in range(20)]
    clips = {c: (rng.choice([0.0005, 1.5, 4.0, 30.0]), round(rng.random(), 2)) for c in range(6)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = composer.composed(
        frame([(s["k"], b) for s in songs for b in s["beats"]], "k int, at double"), frame([(s["k"], b) for s in songs for b in s["downbeats"]], "k int, at double"),
        frame([(s["k"], t, v) for s in songs for t, v in s["energy"]], "k int, at double, value double"), frame([(s["k"], s["total"], s["every"]) for s in songs], "k int, total double, every int"),
        frame([(s["k"], c, x) for s in songs for c, x in s["scores"].items()], "k int, clip int, score double"), frame([(c, *x) for c, x in clips.items()], "clip int, length double, motion double"), ["k"], "clip", ends,
    )
    rows = out.collect()
    assert any(r.filler for r in rows) or ends
    for s in songs:
        own = sorted((r for r in rows if r.k == s["k"]), key=lambda r: r.start)
        plain = [r for r in own if not r.filler]
        want, points = compose(s, clips, ends)
        assert [(R(r.start), R(r.end), r.clip, R(r.score), R(r.energy_match), R(r.match), r.transition_in, r.transition_out) for r in plain] == [w[:8] for w in want]
        for r, w in zip(plain, want, strict=True):
            assert 0 <= r.source_start and r.source_end <= clips[r.clip][0] + 1e-9 and r.source_end - r.source_start == pytest.approx(w[8])
        # fillers take the clips in turn, none twice in a row, and leave no gap of more than LEAST_GAP
        held = [(r.clip, r.source_start, r.source_end) for r in plain if r.source_end - r.source_start > composer.LEAST_FILL]
        found, turn, before = [], 0, None
        gaps = [(0.0, points[0]), (points[-1], s["total"])] if plain else []
        for a, b in gaps:
            if b - a <= composer.LEAST_GAP:
                continue
            while held and a < b - composer.LEAST_GAP:
                c, low, high = held[turn % len(held)]
                turn += 1
                if len(held) > 1 and c == before:
                    c, low, high = held[turn % len(held)]
                    turn += 1
                length = min(high - low, b - a)
                found.append((R(a), R(a + length), c, R(low), R(low + length)))
                before, a = c, a + length
        assert [(R(r.start), R(r.end), r.clip, R(r.source_start), R(r.source_end)) for r in own if r.filler] == found
        if held:
            edges = np.array([[r.start, r.end] for r in own])
            assert edges[0, 0] <= composer.LEAST_GAP and s["total"] - edges[-1, 1] <= composer.LEAST_GAP + 1e-9
            assert np.abs(edges[1:, 0] - edges[:-1, 1]).max(initial=0) <= composer.LEAST_GAP + 1e-9


def test_clips_that_match_alike_are_scored_once(spark):
    """Clips of one kind, ties across kinds and scores under 0 fall to the parts as if every clip had its own score."""
    import random

    rng = random.Random(8)
    match = spark.createDataFrame([(c, m, [0.5, 0.25, -1.0, 0.5, -2.0][c % 5] * (1 + m)) for c in range(60) for m in (0, 1)], "clip long, mood long, score double")
    moods = spark.createDataFrame([(u, m, rng.choice([1.0, 2.0])) for u in range(6) for m in (0, 1)], "u long, mood long, weight double")
    parts = spark.createDataFrame([(u, n, float(n), n + 1.0) for u, many in enumerate((1, 7, 13, 40, 59, 90)) for n in range(many)], "u long, n long, start double, end double")
    kinds = composer.alike(match, ["mood"], "clip", "score")
    assert kinds.select("kind").distinct().count() == 4
    few = match.join(kinds.selectExpr("kind as clip").distinct(), "clip")
    scored = lambda m: composer.mood_scores(moods, m, ["u"], ["mood"], "weight", "clip", "score")
    rows = lambda df: sorted(map(tuple, df.select("u", "n", "clip").collect()))
    got = composer.assigned(parts, scored(few), ["u"], "clip", kinds=kinds)
    assert rows(got) == rows(composer.assigned(parts, scored(match), ["u"], "clip")) and got.count() == 210
