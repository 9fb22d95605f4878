"""SimHash near-duplicates with pigeonring candidate pruning.

Fingerprints of 64 bits link at `radius` differing bits or fewer. The bits are cut into
radius + 1 consecutive segments laid out as a ring. By the pigeonring principle two linked
fingerprints have a start segment from which every chain of l consecutive segments differs in at
most floor(l * radius / segments) bits: with 5 segments and radius 4 that is 0, 1, 2, 3 and 4 bits.
The chain of two is found by an equi-join (one segment equal, the next equal or one flip away), the
longer chains are a filter, and only pairs that pass it get the full Hamming check.

A key that more than DENSE fingerprints share would make pairs with the square of its size. Such
fingerprints are linked with each other through midpoints instead: two fingerprints differ in at
most four bits exactly if some 64-bit value lies within two bits of both, so all that reach the
same value are linked to the least of them, and no pair is made. Everything else probes keys of at
most DENSE members, so work stays in proportion to the number of fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import connected

#: (first bit, width) of each segment of the ring, from the lowest bit.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members of a key from which midpoints take the place of pairs.
DENSE = 512
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit SimHash of one text: a bit is 1 if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)),
        "uint64", len(words) - width + 1,
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit value whose bits are 1 if they are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    bits = (2 * ones > len(hashes)).astype("uint8")
    return int(np.packbits(bits, bitorder="little").view("int64")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, from its whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype="int64")})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def _bits(fp, segment: int):
    at, width = SEGMENTS[segment % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _key(fp, i: int):
    """Segment number, segment i and segment i + 1 in one long."""
    return F.lit(i << 26).cast("long") + F.shiftleft(_bits(fp, i), 13) + _bits(fp, i + 1)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that together connect all that lie within radius bits.

    fps has a column fp of distinct values. Every pair within the radius is either returned or
    joined by a path of returned pairs, each of them within the radius.
    """
    if radius != 4:
        raise ValueError("the ring is laid out for a radius of 4 bits")
    n = len(SEGMENTS)
    fp = F.col("fp")
    keyed = fps.select("fp", F.explode(F.array(*[_key(fp, i) for i in range(n)])).alias("key"))
    dense_keys = keyed.groupBy("key").count().where(F.col("count") > DENSE).select("key", F.lit(True).alias("dense"))
    keyed = cut(keyed.join(dense_keys, "key", "left").select("fp", "key", F.coalesce("dense", F.lit(False)).alias("dense")), "simhash-keys")
    index = keyed.where(~F.col("dense")).select("key", F.col("fp").alias("a"))
    segment = F.shiftright("key", 26).cast("int")
    # of two members of sparse keys the one with the bit set probes the other; a dense one probes either way
    narrow = (segment == n - 2) & F.lit(SEGMENTS[-1][1] < SEGMENTS[0][1])

    def flip(j: int):
        bit = F.lit(1 << j).cast("long")
        wide = ~narrow if j >= SEGMENTS[-1][1] else F.lit(True)
        return F.when(wide & (F.col("dense") | (F.col("key").bitwiseAND(bit) != 0)), F.col("key").bitwiseXOR(bit))

    flipped = F.array_compact(F.array(*[flip(j) for j in range(SEGMENTS[0][1])]))
    same = keyed.where(~F.col("dense")).select(F.col("fp").alias("b"), "key", F.lit(True).alias("same"))
    probe = same.unionByName(keyed.select(F.col("fp").alias("b"), F.explode(flipped).alias("key"), F.lit(False).alias("same")))
    diff = F.col("a").bitwiseXOR(F.col("b"))

    def chain(i: int, length: int):
        return sum((F.bit_count(_bits(diff, i + k)) for k in range(1, length)), F.bit_count(_bits(diff, i)))

    viable = F.lit(False)
    for i in range(n):
        ok = F.lit(True)
        for length in range(1, n):
            ok = ok & (chain(i, length) <= length * radius // n)
        viable = viable | (ok & (segment == i))
    pairs = probe.join(index, "key").where(~F.col("same") | (F.col("a") < F.col("b"))).where(viable).where(F.bit_count(diff) <= radius)
    return pairs.select("a", "b").unionByName(_midpoint_links(keyed.where("dense").select("fp").distinct()))


def _midpoint_links(fps: DataFrame) -> DataFrame:
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    flips = np.array(masks, dtype="uint64").view("int64")

    def run(batches):
        for pdf in batches:
            for fp in pdf["fp"].to_numpy():
                yield pd.DataFrame({"point": flips ^ fp, "fp": np.full(len(flips), fp)})

    near = cut(fps.mapInPandas(run, "point long, fp long"), "simhash-midpoints")
    least = near.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, "point").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    A null or blank text has fingerprint zero and is linked like any other. Repeated rows keep one
    result row each; a null doc_id never names a component unless all of its members have none. Empty
    tables give an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = connected(links(least.select("fp")), "a", "b")
    named = least.join(labels, least.fp == labels.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(names, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; nulls, repeats and empty tables as near_duplicates() says."""
    return near_duplicates(table(spark, sf_dir, "documents"))
