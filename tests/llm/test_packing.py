import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from cadenza.llm.packing import best_fit, pack


def brute(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[i]["left"] -= n
        bins[i]["s"] |= {s}
        bins[i]["c"] |= {c}
        out.append(i)
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(2)
    n = 600
    sizes = sorted((rng.randrange(0, 101) for _ in range(n)), reverse=True)
    sources = [rng.choice(["a", "a", "b", "c", "d", None]) for _ in range(n)]
    clusters = [rng.choice([None, *range(30)]) for _ in range(n)]
    assert best_fit(sizes, sources, clusters, 100) == brute(sizes, sources, clusters, 100)


def test_bins_hold_their_rules(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 120))), rng.choice(["hot"] * 5 + ["b", "c", None])) for i in range(400)]
    rows += [(400, None, "b"), (401, "", "b"), (402, "x " * 1000, "c"), (403, rows[0][1], "d"), (403, rows[0][1], "d"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("piece", F.lit("clash")).withColumn("shard", F.lit(1))
    out = pack(df, capacity=100).collect()
    total = defaultdict(int)
    for r in out:
        total[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for d, t, _ in rows:
        want[d] += len((t or "").split())
    assert total == want
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for members in bins.values():
        assert sum(r.n_tokens for r in members) <= 100
        named = [r.source for r in members if r.source is not None]
        assert len(named) == len(set(named))
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == at
            at += r.n_tokens
    assert pack(df.where("false")).collect() == []


def test_shards_against_brute_force(spark):
    """The whole operator: each shard is best fit over its pieces, largest first."""
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 250))), rng.choice("abcd")) for i in range(300)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=100).collect()
    assert len(out) == sum(max(1, -(-len(t.split()) // 100)) for _, t, _ in rows)
    order = sorted(out, key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
    text = {i: t for i, t, _ in rows}
    assert [r.bin_id for r in order] == brute([r.n_tokens for r in order], [r.source for r in order], [text[r.doc_id] for r in order], 100)


def test_repeated_rows_are_shared_out(spark):
    began = time.perf_counter()
    one = spark.createDataFrame([(7, "same text here", "s")], "doc_id long, text string, source string")
    many = one.crossJoin(spark.range(200_000)).select("doc_id", "text", "source")
    out = pack(many)
    per_shard = out.groupBy((F.col("bin_id") / (1 << 24)).cast("int").alias("shard")).count().collect()
    assert sum(r["count"] for r in per_shard) == 200_000 and max(r["count"] for r in per_shard) < 6000
    assert out.select("bin_id").distinct().count() == 200_000
    assert time.perf_counter() - began < 120
