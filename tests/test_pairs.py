"""Joint training of two matrices against a replay of its formulas."""

import numpy as np
import pytest

from cadenza.operators import learning


def replay(pairs, sizes, rate, passes, most):
    """The formulas in a row: p = x A, q = y B, cosine with 1e-9 beside the norms, slope of half the squared error, each cut to a length of `most`."""
    a, b = np.eye(sizes[0], sizes[2]), np.eye(sizes[1], sizes[2])
    ready = []
    for x, y, t in pairs:
        if x is None or y is None or t is None or len(x) != sizes[0] or len(y) != sizes[1] or not np.isfinite([*x, *y, t]).all() or not np.any(x) or not np.any(y):
            continue
        ready.append((np.array(x) / np.linalg.norm(x), np.array(y) / np.linalg.norm(y), min(1.0, max(-1.0, t))))

    def loss():
        return np.mean([0.5 * ((x @ a) @ (y @ b) / ((np.linalg.norm(x @ a) + 1e-9) * (np.linalg.norm(y @ b) + 1e-9)) - t) ** 2 for x, y, t in ready])

    before = loss()
    for _ in range(passes):
        for x, y, t in ready:
            p, q = x @ a, y @ b
            n_p, n_q = np.linalg.norm(p) + 1e-9, np.linalg.norm(q) + 1e-9
            u, v = p / n_p, q / n_q
            cos = u @ v
            g_a, g_b = np.outer(x, (cos - t) * (v - cos * u) / n_p), np.outer(y, (cos - t) * (u - cos * v) / n_q)
            for g in (g_a, g_b):
                if np.linalg.norm(g) > most:
                    g *= most / (np.linalg.norm(g) + 1e-9)
            a, b = a - rate * g_a, b - rate * g_b
    return a, b, before, loss(), len(ready)


@pytest.mark.parametrize(("passes", "most"), [(1, 1.0), (4, 0.05)])
def test_matches_replay(spark, passes, most):
    rng = np.random.default_rng(3)
    rows = []
    for k in ("a", "b"):
        rows += [(k, i, rng.normal(size=5).tolist(), rng.normal(size=4).tolist(), float(rng.choice([-1, -0.5, 0.5, 1, 7]))) for i in range(25)]
        rows += [(k, 30, None, [1.0] * 4, 1.0), (k, 31, [0.0] * 5, [1.0] * 4, 1.0), (k, 32, [1.0] * 3, [1.0] * 4, 1.0), (k, 33, [1.0] * 5, [1.0, float("nan"), 1.0, 1.0], 1.0), (k, 34, [1.0] * 5, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "k string, n int, x array<double>, y array<double>, t double").repartition(5)
    got = {r.k: r for r in learning.pair_passes(df, ["k"], ["n"], "x", "y", "t", (5, 4, 3), 0.1, passes, most).collect()}
    for k in ("a", "b"):
        a, b, before, after, n = replay([r[2:] for r in rows if r[0] == k], (5, 4, 3), 0.1, passes, most)
        r = got[k]
        assert (r.n_pairs, r.passes) == (n, passes) == (25, passes)
        assert np.allclose(r.x_matrix, a) and np.allclose(r.y_matrix, b)
        assert (r.loss_before, r.loss_after) == pytest.approx((before, after))
        assert after < before
    assert learning.pair_passes(df.where("false"), ["k"], ["n"], "x", "y", "t", (5, 4, 3)).count() == 0


def test_step_follows_the_slope():
    """Against difference quotients of half the squared error; a long slope is cut, a step of rate 0 changes nothing."""
    rng = np.random.default_rng(1)
    a, b, x, y, t = rng.normal(size=(4, 3)), rng.normal(size=(5, 3)), rng.normal(size=4), rng.normal(size=5), 0.3

    def error(a, b):
        p, q = x @ a, y @ b
        return 0.5 * (p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) - t) ** 2

    a2, b2 = a.copy(), b.copy()
    learning.joint_step(a2, b2, x, y, t, 1.0, most=1e9)
    for k in range(4):
        for j in range(3):
            e = np.zeros_like(a)
            e[k, j] = 1e-6
            assert (a - a2)[k, j] == pytest.approx((error(a + e, b) - error(a - e, b)) / 2e-6, abs=1e-6)
    cut_a, cut_b = a.copy(), b.copy()
    learning.joint_step(cut_a, cut_b, x, y, t, 1.0, most=1e-3)
    assert np.linalg.norm(a - cut_a) == pytest.approx(1e-3, rel=1e-3) and np.linalg.norm(b - cut_b) == pytest.approx(1e-3, rel=1e-3)
