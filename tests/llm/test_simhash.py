import random

import xxhash
from pyspark.sql import functions as F

from cadenza.llm import simhash


def brute_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    if not words:
        return 0
    n = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{doc_id: smallest reachable doc_id} by comparing every pair."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)] + ["É", "straße", "ñ"]
    rows = [None, "", "  \t\n", "One", "one two three", "ONE two\x0bthree", "x" * 5000]
    base = [rng.choice(vocab) for _ in range(220)]
    rows += [" ".join(base)] * 3
    for _ in range(25):
        words = list(base)
        words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append(" ".join(words))
    rows += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i, _ in rows}
    assert sum(v < i for i, v in want.items()) > 10


def test_dense_keys_go_through_midpoints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 3)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(60):
        v = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 6])):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(20)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    from cadenza.llm.components import connected

    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r.node: r.root for r in connected(pairs, "a", "b").collect()}
    want = brute_components({v: v % (1 << 64) for v in signed})
    assert {v: got.get(v, v) for v in signed} == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
