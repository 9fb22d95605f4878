"""Conflict-constrained best-fit packing of documents into training bins.

Documents are cut into pieces of at most `capacity` tokens. Pieces are dealt by hash to shards of
about SHARD pieces, so that neither a large source nor a large group of copies meets in one task;
rows that repeat are counted first and dealt by their running number.
Within a shard, pieces go largest first to the bin of least sufficient residual. Bins stand in order
of residual and carry bitmaps of their sources and duplicate clusters; where the tightest bin holds
the piece's source or cluster already, the search moves on to its successor until one is compatible,
and else a new bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

CAPACITY = 2048
#: Pieces packed together on average; a shard's rows are numbers, under 1 MB.
SHARD = 4096
#: Pieces of one distinct row that a task makes at most before they are dealt to shards.
RUN = 1 << 16


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin number of each piece, in the order given; a null source or cluster conflicts with none."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    held_sources: list[int] = []
    held_clusters: list[int] = []
    holding: dict[int, int] = {}  # bins with each source; with each cluster, as a negative bit
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        n = len(order)  # where every bin holds the source or every one the cluster, no search is needed
        at = n if n and n in (holding.get(s), holding.get(-c)) else bisect_left(order, (size, -1))
        while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            held_sources[b] |= s
            held_clusters[b] |= c
        else:
            residual, b = capacity, len(held_sources)
            held_sources.append(s)
            held_clusters.append(c)
        for key in (s, -c):
            if key:
                holding[key] = holding.get(key, 0) + 1
        insort(order, (residual - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, source, bin_id and bin_offset of every piece of every row.

    Tokens are runs of non-blank characters. A text of more than `capacity` tokens gives full pieces
    and a rest; null and blank texts give one piece without tokens. No bin exceeds `capacity`, and none
    holds two pieces of one source or of one duplicate cluster (without cluster_col: of equal texts),
    so the pieces of one document part. Rows that repeat are packed each, in different bins. A null
    source or cluster conflicts with none. Ties in size go by id and piece. Empty tables give no bins,
    and further columns don't matter.
    """
    text = F.col(text_col).cast("string")
    cluster = F.xxhash64(text) if cluster_col is None else F.col(cluster_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n"),
        F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster"),
    )
    # equal rows are one row with a count: written once, so that texts are read and counted once
    rows = cut(rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count("*").alias("copies")), "packing-sizes")
    cap = F.lit(capacity)
    each = F.greatest(F.ceil(F.col("n") / cap), F.lit(1)).cast("long")
    total = rows.agg(F.sum(each * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    made = rows.withColumn("pieces", each).withColumn("all", F.col("pieces") * F.col("copies"))
    # a document of many pieces or copies is made by several tasks
    parts = made.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / F.lit(RUN)))))
    if not parts.where("part > 0").isEmpty():
        parts = parts.repartition("doc_id", "cluster", "part")
    first = F.col("part") * F.lit(RUN)
    numbered = parts.withColumn("number", F.explode(F.sequence(first, F.least(first + F.lit(RUN), F.col("all")) - 1)))
    pieces = numbered.withColumn("piece", F.pmod("number", "pieces").cast("int")).withColumn("first_token", F.col("piece") * cap)
    pieces = pieces.withColumn("n_tokens", F.least(cap, F.col("n") - F.col("first_token")))
    pieces = pieces.select("doc_id", "piece", "first_token", "n_tokens", "source", "cluster", F.pmod(F.xxhash64("doc_id", "number", "cluster"), F.lit(shards)).alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        opt = lambda col: [None if v is None or v != v else v for v in pdf[col]]
        bins = pd.Series(best_fit(pdf["n_tokens"].tolist(), opt("source"), opt("cluster"), capacity), index=pdf.index)
        offset = pdf["n_tokens"].groupby(bins).cumsum() - pdf["n_tokens"]
        pdf = pdf.assign(bin_id=pdf["shard"] * (1 << 24) + bins, bin_offset=offset)
        return pdf[["doc_id", "piece", "first_token", "n_tokens", "source", "bin_id", "bin_offset"]]

    id_type = dict(rows.dtypes)["doc_id"]
    return pieces.groupBy("shard").applyInPandas(run, f"doc_id {id_type}, piece int, first_token int, n_tokens int, source string, bin_id long, bin_offset int")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed; nulls, repeats and empty tables as pack() says."""
    return pack(table(spark, sf_dir, "documents"))
