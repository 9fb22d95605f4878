import math
import random

from pyspark.sql import functions as F

from cadenza.llm import knn_join


def brute(rows, k, every):
    vs = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in vs:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vs if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "DATA_BLOCK", 16)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[10][1]) for i in range(150, 260)]  # one very common vector
    rows += [(300, None), (301, [None] + [0.1] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8), (305, []), (304, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash")).withColumn("v", F.lit(0))
    v = knn_join.quantised(df, "vec_id", "embedding")
    got = {tuple(r) for r in knn_join.top_k_inner_product(v, v.where("vec_id % 5 = 0"), 5).collect()}
    assert got == brute(rows, 5, 5)


def test_large_numbers_and_repeated_ids(spark, monkeypatch):
    """Components far beyond two bytes, many cells and blocks, one id with two vectors."""
    monkeypatch.setattr(knn_join, "DATA_BLOCK", 8)
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-9000, 9000)) for _ in range(3)]) for i in range(300)] + [(7, [1.0, 2.0, 3.0]), (8, [0.001, 0.0, -0.001])]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in knn_join.top_k_inner_product(v, v.where("vec_id % 9 = 0"), 3).collect())
    assert got == sorted(brute(rows, 3, 9))


def test_bounds_hold_and_prune():
    rng = knn_join.np.random.default_rng(3)
    centres = rng.normal(0, 1000, (20, 6))
    data = knn_join.np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 30, (4000, 6)))
    pivots = data[:40]
    cell = ((data[:, None] - pivots) ** 2).sum(2).argmin(1)
    radius = knn_join.np.array([knn_join.np.sqrt(((data[cell == c] - pivots[c]) ** 2).sum(1)).max() for c in range(40)])
    longest = knn_join.np.array([knn_join.np.sqrt((data[cell == c] ** 2).sum(1)).max() for c in range(40)])
    q = data[::50]
    most = knn_join.bounds(q, pivots, radius, longest)
    scores = q @ data.T
    assert all((scores[:, cell == c] <= most[:, [c]]).all() for c in range(40))
    least = knn_join.np.sort(q @ pivots.T, axis=1)[:, -6]
    assert (most >= least[:, None]).mean() < 0.5


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [3.0, 1.0])]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert {tuple(r) for r in knn_join.top_k_inner_product(v, v, 5).collect()} == brute(rows, 5, 1)
    none = v.where("false")
    assert knn_join.top_k_inner_product(none, none, 5).collect() == []
    assert knn_join.top_k_inner_product(v, none, 5).collect() == []


def test_no_side_is_broadcast(spark, monkeypatch):
    """Sizes guessed from files don't tell how often queries are sent: broadcast sides went through the driver whole."""
    plans, cut = [], knn_join.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(knn_join, "DATA_BLOCK", 16)
    monkeypatch.setattr(knn_join, "cut", lambda df, name: (plans.append(plan(df)), cut(df, name))[1])
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    out = knn_join.top_k_inner_product(v, v.where("vec_id % 5 = 0"), 5)
    plans.append(plan(out))
    assert {tuple(r) for r in out.collect()} == brute(rows, 5, 5)
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_queries_are_sent_once_a_group(spark, monkeypatch):
    """Far fewer groups than cells and data blocks, some cells of several groups; near centres have close scores."""
    monkeypatch.setattr(knn_join, "DATA_BLOCK", 8)
    monkeypatch.setattr(knn_join, "GROUPS", 5)
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", 7)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 9) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1 if i % 3 else 0) for x in centres[i % 6 if i % 4 else 0]]) for i in range(600)]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert {tuple(r) for r in knn_join.top_k_inner_product(v, v.where("vec_id % 3 = 0"), 5).collect()} == brute(rows, 5, 3)


def test_groups_hold_all_cells():
    assert knn_join.groups_of([3, 4, 0, 25, 2, 9, 10], 10) == ([0, 0, 0, 1, 0, 4, 5], [1, 1, 1, 3, 1, 1, 1], 6)
    assert knn_join.groups_of([0], 10) == ([0], [1], 1)


def test_scores_beyond_floats(spark):
    """Components of two bytes whose scores differ in the last of 25 bits."""
    rng = random.Random(6)
    rows = [(i, [(4100 + rng.randrange(2)) / 256, (900 + rng.randrange(3)) / 256, (900 + rng.randrange(3)) / 256]) for i in range(200)]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert {tuple(r) for r in knn_join.top_k_inner_product(v, v.where("vec_id % 9 = 0"), 5).collect()} == brute(rows, 5, 9)
