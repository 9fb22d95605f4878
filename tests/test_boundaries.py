"""Sections and novelty of curves against plain NumPy over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import boundaries


def smoothed_curve(x, size):
    padded = np.concatenate([np.repeat(x[0], size // 2), x, np.repeat(x[-1], size - 1 - size // 2)])
    return np.array([padded[i : i + size].mean() for i in range(len(x))])


def brute(x, step, context_s=60.0):
    """Sections of one curve: every mean taken by itself, boundaries chosen one by one."""
    smooth, context, apart = boundaries.widths(step, context_s)
    n = len(x)
    s = smoothed_curve(x, smooth)
    least, scale = max(np.ptp(s) * 0.15, s.std() * 0.35, 1e-8), max(np.ptp(s), 1e-8)
    sides = {i: (s[i - context : i].mean(), s[i : i + context].mean()) for i in range(context, n - context)}
    size = {i: abs(b - a) for i, (a, b) in sides.items()}
    near = 1e-9  # means by different sums differ in their last digits
    peaks = [i for i in size if size[i] >= least and all(size[i] >= size.get(j, -1) - near for j in (i - 1, i + 1))]
    kept = []
    for i in sorted(peaks, key=lambda i: (-round(size[i], 9), -i)):
        if all(abs(i - j) >= apart for j in kept):
            kept.append(i)
    kept.sort()
    edges = [0, *kept, n]
    quiet = max(0.08 * max(s.max(), 1e-8), 0.25 * s.mean())
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        mean = s[a:b].mean()
        label = "section"
        if k == 0 and kept and sides[kept[0]][0] <= quiet and sides[kept[0]][1] >= sides[kept[0]][0] + least:
            label = "intro"
        if k == len(kept) and kept and mean <= quiet and out[-1][4] >= mean + least:
            label = "outro"
        strengths = [min(1.0, size[i] / scale) for i in (a, b) if i in kept]
        out.append((k, a, b, label, mean, max(strengths, default=0.0)))
    return out


def curves():
    rng = np.random.default_rng(7)
    flat = lambda *parts: np.concatenate([np.full(n, v) + rng.random(n) * 0.02 for n, v in parts])
    return {
        "song": flat((40, 0.02), (90, 0.8), (60, 0.4), (70, 0.9), (50, 0.01)),
        "steady": flat((150, 0.5)),
        "long": flat(*[(int(rng.integers(10, 60)), float(rng.random())) for _ in range(30)]),
        "short": rng.random(12),
        "one": np.array([0.4]),
    }


@pytest.mark.parametrize("block", [65_536, 64])
def test_sections_match_brute_force(spark, block):
    data = curves()
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "k string, idx long, v double")
    got = {k: [] for k in data}
    for r in boundaries.sections(df, ["k"], "idx", "v", 1.0, block=block).orderBy("k", "section").collect():
        got[r.k].append((r.section, r["first"], r["last"], r.label, r.energy, r.confidence))
    for k, x in data.items():
        want = brute(x, 1.0)
        assert [g[:4] for g in got[k]] == [w[:4] for w in want], k
        assert np.allclose([g[4:] for g in got[k]], [w[4:] for w in want])
    labels = [g[3] for g in got["song"]]
    assert labels[0] == "intro" and labels[-1] == "outro" and len(labels) == 5
    assert boundaries.sections(df.where("false"), ["k"], "idx", "v", 1.0).count() == 0


@pytest.mark.parametrize(("smooth", "context"), [(1, 1), (2, 8), (5, 3)])
def test_contrasts_at_every_sample(spark, smooth, context):
    data = curves()
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "k string, idx long, v double")
    rows = boundaries.contrasts(df, ["k"], "idx", "v", smooth, context, 32).collect()
    assert len(rows) == sum(map(len, data.values()))
    means = {k: smoothed_curve(x, smooth) for k, x in data.items()}
    for r in rows:
        s = means[r.k]
        assert r.smoothed == pytest.approx(s[r.idx])
        if context <= r.idx < len(s) - context:
            assert (r.left, r.right) == pytest.approx((s[r.idx - context : r.idx].mean(), s[r.idx : r.idx + context].mean()))
        else:
            assert r.contrast is None and not r.peak


def test_a_million_samples_of_one_key_are_shared_out(spark):
    n, block = 1_000_000, 50_000
    level = F.when(F.floor(F.col("id") / 1000) % 2 == 0, 1.0).otherwise(0.0)
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("idx"), level.alias("v"))
    c = boundaries.contrasts(df, ["k"], "idx", "v", 2, 8, block)
    sizes = [r["count"] for r in c.groupBy(F.floor(F.col("idx") / block).alias("b")).count().collect()]
    assert sizes == [block] * 20
    windows = [line for line in c._jdf.queryExecution().optimizedPlan().toString().splitlines() if "+- Window [" in line or line.startswith("Window [")]
    assert windows and all("_block" in line for line in windows)
    s = boundaries.sections(df, ["k"], "idx", "v", 1.0, block=block)
    assert s.agg(F.count("*"), F.min("first"), F.max("last")).first() == (1000, 0, n)
    assert s.where((F.col("first") % 1000 > 1) | (F.abs(F.col("energy") - F.col("section") % 2 * -1 - 1) > 0.01)).count() == 0


def matrix_form(x, kernel, half, padded):
    """The kernel laid on the matrix of cosines around each position, block by block."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    ssm = unit @ unit.T
    n = len(x)
    out = np.zeros(n)
    if padded:
        ssm = np.pad(ssm, half, mode="edge")
        for i in range(n):
            out[i] = (ssm[i : i + 2 * half, i : i + 2 * half] * kernel).sum()
        return np.maximum(out, 0)
    for i in range(half, n - half):
        out[i] = abs((ssm[i - half : i + half, i - half : i + half] * kernel).sum())
    return out


@pytest.mark.parametrize("block", [8192, 13])
@pytest.mark.parametrize("padded", [True, False])
def test_novelty_is_the_matrix_form(spark, block, padded):
    rng = np.random.default_rng(5)
    size = 12
    weights = boundaries.tapered(size) if padded else [-1.0] * 6 + [1.0] * 6
    place = np.arange(size) - (size - 1) / 2
    g = np.exp(-(place**2) / (2 * (size / 4) ** 2)) if padded else np.ones(size)
    side = np.repeat([1.0, -1.0], size // 2)
    kernel = np.outer(side * g, side * g)
    data = {"a": rng.normal(size=(80, 5)), "b": rng.normal(size=(7, 5)), "c": rng.normal(size=(1, 5))}
    data["a"][30:] += 2
    data["a"][11] = 0
    df = spark.createDataFrame([(k, i, [float(v) for v in row]) for k, x in data.items() for i, row in enumerate(x)], "k string, idx long, vec array<double>")
    got = {(r.k, r.idx): r.novelty for r in boundaries.kernel_novelty(df, ["k"], "idx", "vec", weights, padded, block).collect()}
    assert len(got) == 88
    for k, x in data.items():
        assert np.allclose([got[k, i] for i in range(len(x))], matrix_form(x, kernel, size // 2, padded)), k
    assert boundaries.kernel_novelty(df.where("false"), ["k"], "idx", "vec", weights).count() == 0
