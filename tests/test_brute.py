"""Queries that SQL can't say, against plain loops over the smallest tables."""

import os
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def picked(curve, apart):
    """Maxima at the median plus one deviation and above; the highest first, none nearer than `apart` to one that stays, ties to the earlier."""
    level = np.median(curve) + np.std(curve)
    peaks = [i for i in range(1, len(curve) - 1) if curve[i - 1] < curve[i] > curve[i + 1] and curve[i] >= level]
    kept = []
    for i in sorted(peaks, key=lambda i: (-curve[i], i)):
        if all(abs(i - j) >= apart for j in kept):
            kept.append(i)
    return kept


def test_picked_peaks(spark):
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    want = {(u, i) for u, own in e.groupby("user_id") for i in picked(own["value"].to_numpy(), 4)}
    got = {(r.user_id, r.idx) for r in QUERIES["win30_picked_peaks"](spark, SF).collect()}
    assert got == want and len(want) > 20


def test_boundaries_of_novelty(spark):
    v = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    want = set()
    for label, own in v.groupby("label"):
        x = np.array(own["embedding"].tolist(), "float64")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        curve = [0.0] + [float(((x[i : i + 4].mean(0) - x[max(0, i - 4) : i].mean(0)) ** 2).sum()) for i in range(1, len(x))]
        want |= {(label, i) for i in picked(np.round(curve, 9), 8)}
    got = {(r.label, r.idx) for r in QUERIES["win10_boundaries"](spark, SF).collect()}
    assert got == want and len(want) > 5


def test_hashed_choice(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")

    def hashed(i):
        h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest((42).to_bytes(4, "little"), h)  # the seed is hashed as a second column
        return h - (1 << 64) if h >> 63 else h

    want = {u: min(own["event_id"], key=hashed) for u, own in e.groupby("user_id")}
    assert {r.user_id: r.event_id for r in QUERIES["udf18_hashed_choice"](spark, SF).collect()} == want


def test_clusters_are_a_fixed_point_of_few_steps(spark):
    """Every vector counts for the nearest of five means, and these explain more than five vectors taken at random do."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = np.array(pd.read_parquet(f"{SF}/embeddings.parquet")["embedding"].tolist(), "float64")
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    centres = np.array(KMeans(k=5, seed=42, maxIter=10).fit(df).clusterCenters())
    near = ((x[:, None] - centres[None]) ** 2).sum(2)
    counts = np.bincount(near.argmin(1), minlength=5)
    got = {r.prediction: r.n for r in QUERIES["agg28_kmeans"](spark, SF).collect()}
    assert [got.get(i, 0) for i in range(5)] == counts.tolist()
    rng = np.random.default_rng(0)
    for _ in range(20):
        some = x[rng.choice(len(x), 5, replace=False)]
        assert near.min(1).sum() < ((x[:, None] - some[None]) ** 2).sum(2).min(1).sum()


def told(raw, most=3):
    """A text without a leading label and bullets, blanks folded, its first sentences."""
    out = (raw or "").strip(" ")
    for p in ("answer:", "explanation:"):
        if out.lower().startswith(p):
            out = out[len(p) :].strip(" ")
    out = re.sub(r"(?m)^[ \t]*[-*•]+[ \t]+", "", out)
    return " ".join(re.split(r"(?<=[.!?])\s+", re.sub(r"[ \t\n\x0b\f\r]+", " ", out).strip())[:most])


def test_narratives(spark):
    c = pd.read_parquet(f"{SF}/conversations.parquet")
    want = sorted(((a, b, told(t)) for a, b, t in zip(c["conv_id"], c["turn"], c["text"], strict=True)), key=repr)
    got = sorted(((r.conv_id, r.turn, r.text) for r in QUERIES["str10_narrative"](spark, SF).collect()), key=repr)
    assert got == want
    raw = ["Answer: Explanation: - one.\n* two!  Three? four.", None, "", "ANSWER:x", "no end", "  a.b. c\n• d. e. f", "answer"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").select("i", text.narrative(F.col("t"), ["answer:", "explanation:"]).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: told(t) for i, t in enumerate(raw)}
