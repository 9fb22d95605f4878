"""Exact top-k inner-product search as a Voronoi kNN join.

Data vectors go to the cell of their nearest pivot. Each cell is summarised by its pivot p, its
radius r and its longest vector m, so that for every x of the cell q.x is at most q.p + |q| r, |q| m
and (|q|^2 + m^2 - max(0, |q - p| - r)^2) / 2. A query's (k+1)-th best score over a few drawn vectors
bounds its final scores from below. Query blocks are sent only to groups that hold a cell whose
least upper bound reaches that lower bound, and are scored there with such cells alone.

A group is one task's work: its vectors are held, packed, and the query blocks pass by them in one
sorted stream. So vectors are shuffled once, queries once for each group, and neither side is ever
broadcast or held whole.

Equal vectors are merged first, keeping the k+1 smallest ids of each: ties go to the smaller id
and a query leaves out at most its own row, so no other id can reach a top k. A vector that
stands in a third of all rows is one row from then on.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches, table

#: Pivots: the first of the drawn vectors, one for each data block, but so many at least and at most; as many as most are drawn.
PIVOTS = 32
PIVOTS_MOST = 1024
#: Vectors that are scored at once.
DATA_BLOCK = 4096
#: Groups of cells that are aimed at, unless they get smaller than a data block or their vectors larger than so many bytes as numbers.
GROUPS = 32
GROUP_BYTES = 1 << 25
#: Queries in a query block, and its bytes; blocks in a batch.
QUERY_BLOCK = 256
QUERY_BYTES = 1 << 16
BATCH = 512


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows null or holding null or non-finite components go."""
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"))
        .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
        .where(~F.coalesce(F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)))
        .select("vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
        .distinct()
    )


def bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of each query with any vector of each cell, rounding included."""
    dots, norm = q @ pivots.T, np.sqrt((q**2).sum(1))[:, None]
    apart = np.sqrt(np.maximum(norm**2 - 2 * dots + (pivots**2).sum(1), 0))
    by_pivot = dots + norm * radius
    by_length = norm * longest
    by_distance = (norm**2 + longest**2 - np.maximum(apart - radius, 0) ** 2) / 2
    slack = 1e-3 + 1e-9 * (norm + longest) ** 2
    return np.minimum(np.minimum(by_pivot, by_length), by_distance) + slack


def groups_of(sizes: list[int], most: int) -> tuple[list[int], list[int], int]:
    """Of each cell its first group and over how many it is dealt, and the number of groups; a group takes about `most` vectors."""
    first, dealt, made, last, free = [], [], 0, -1, 0
    for n in sizes:
        parts = max(1, -(-n // most))
        if parts > 1:
            first.append(made)
            made += parts
        else:
            if last < 0 or n > free:
                last, free, made = made, most, made + 1
            first.append(last)
            free -= n
        dealt.append(parts)
    return first, dealt, made


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows padded with zeros to dim; doubles hold these integers exactly."""
    n, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each query's `keep` best, by query and best first, and each row's place from 0."""
    order = np.lexsort((vec_id, -score, query))
    query, vec_id, score = query[order], vec_id[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    near = place < keep
    return query[near], vec_id[near], score[near], place[near]


def top_k_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query row (vec_id, v) the k rows of vectors with the highest inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a row with the
    query's own vec_id takes no part; fewer than k rows give all of them. Shorter vectors count as
    padded with zeros. Scores must stay below 2**53. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark, BATCH)
    keep = k + 1
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    distinct = cut(
        vectors.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= keep)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "knn-distinct",
    )
    wanted = cut(queries.groupBy("v").agg(F.min("vec_id").alias("rep")), "knn-queries")
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    squares = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n_vectors, *of_vectors = distinct.agg(F.count("*"), F.max(F.size("v")), largest).first()
    *of_queries, longest_query = wanted.agg(F.max(F.size("v")), largest, F.sqrt(squares)).first()
    dim, most = (max(a or 0, b or 0, 1) for a, b in zip(of_vectors, of_queries, strict=True))
    # the vectors of the smallest hashes; others don't come near the driver
    share = min(1.0, 2 * PIVOTS_MOST / max(n_vectors, 1))
    hashed = F.xxhash64("v")
    drawn_rows = distinct.where(hashed <= min((1 << 63) - 1, int((2 * share - 1) * (1 << 63)))).orderBy(hashed, F.element_at("ids", 1)).limit(PIVOTS_MOST).collect()
    if not drawn_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = _matrix(pa.array([r.v for r in drawn_rows], pa.list_(pa.int64())), dim)
    pivots = drawn[: min(PIVOTS_MOST, max(PIVOTS, -(-n_vectors // DATA_BLOCK)))]
    packed = "<i2" if most < 1 << 15 else "<f8"

    def assign(batches):
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"), dim)
                cell = (half - m @ pivots.T).argmin(1)
                rows = m.astype(packed)
                yield pa.RecordBatch.from_pydict({
                    "v": pa.array([r.tobytes() for r in rows], pa.binary()), "ids": batch.column("ids"), "cell": pa.array(cell.astype("int32")),
                    "dist": np.sqrt(((m - pivots[cell]) ** 2).sum(1)), "length": np.sqrt((m**2).sum(1)),
                })

    cells = cut(distinct.mapInArrow(assign, "v binary, ids array<long>, cell int, dist double, length double"), "knn-cells")
    drop_cut(distinct)
    summary = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("length").alias("longest")).collect()}
    n_cells = len(pivots)
    sizes, radius, longest = (np.array([summary[c][x] if c in summary else 0 for c in range(n_cells)]) for x in ("n", "radius", "longest"))
    # no sum of products of components, in any order, exceeds the product of the lengths: below 2**24 floats are as exact as doubles
    number = "float32" if 1.001 * longest.max() * (longest_query or 0) < 1 << 24 else "float64"
    in_group = min(max(DATA_BLOCK, -(-n_vectors // GROUPS)), max(DATA_BLOCK, GROUP_BYTES // (dim * np.dtype(number).itemsize)))
    first, dealt, n_groups = groups_of(sizes.tolist(), in_group)
    holds = np.zeros((n_cells, n_groups), dtype="float32")
    for c in np.flatnonzero(sizes):
        holds[c, first[c] : first[c] + dealt[c]] = 1
    at_cell = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    group = at_cell(first) + F.pmod(F.xxhash64("v"), at_cell(dealt)).cast("int")
    data = cells.select(group.alias("grp"), "cell", "v", "ids", F.lit(None).cast("array<double>").alias("least"))

    stream = "grp int, cell int, v binary, ids array<long>, least array<double>"
    stream_arrow = pa.schema([("grp", pa.int32()), ("cell", pa.int32()), ("v", pa.binary()), ("ids", pa.list_(pa.int64())), ("least", pa.list_(pa.float64()))])
    in_block = max(1, min(QUERY_BLOCK, QUERY_BYTES // (dim * np.dtype(packed).itemsize)))

    def route(batches):
        """Blocks of queries with their lower bounds, for each group of cells that one of its queries needs; they come after the cells."""
        for batch in batches:
            for at in range(0, batch.num_rows, in_block):
                part = batch.slice(at, in_block)
                m, reps = _matrix(part.column("v"), dim), part.column("rep").to_numpy()
                least = np.partition(m @ drawn.T, -keep, axis=1)[:, -keep] if len(drawn) >= keep else np.full(len(m), -np.inf)
                need = (bounds(m, pivots, radius, longest) >= least[:, None]).astype("float32") @ holds > 0
                own = {g: np.flatnonzero(need[:, g]) for g in np.flatnonzero(need.any(0))}
                if own:
                    yield pa.RecordBatch.from_pydict({
                        "grp": list(own), "cell": [n_cells] * len(own), "v": [m[x].astype(packed).tobytes() for x in own.values()],
                        "ids": [reps[x] for x in own.values()], "least": [least[x] for x in own.values()],
                    }, stream_arrow)

    def unpacked(rows: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows.to_pylist()), packed).reshape(-1, dim).astype(kind)

    def held(parts: list[pa.RecordBatch]):
        """A function that gives the best of a group's rows for a block of queries."""
        rows = pa.Table.from_batches(parts)
        m, ids = unpacked(rows["v"], number), rows["ids"].combine_chunks()
        per, ids = pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy()
        start, cell = np.cumsum(per) - per, rows["cell"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        spans = list(pairwise(edges))
        here = cell[edges[:-1]]

        def best(q: np.ndarray, least: np.ndarray):
            upper, qn, least = bounds(q, pivots[here], radius[here], longest[here]), q.astype(number), least.copy()
            query, vec_id, score = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
            for c in np.argsort(-upper.max(0)):
                for lo in range(spans[c][0], spans[c][1], DATA_BLOCK):
                    own = np.flatnonzero(upper[:, c] >= least)
                    if not len(own):
                        break
                    scores = qn[own] @ m[lo : min(lo + DATA_BLOCK, spans[c][1])].T
                    # every vector that ties with the keep-th best so far is looked at
                    i, j = np.divmod(np.flatnonzero(scores >= least[own].astype(number)[:, None]), scores.shape[1])
                    if not len(i):
                        continue
                    row = lo + j
                    n = per[row]
                    ids_at = np.repeat(start[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found = np.repeat(own[i], n), ids[ids_at], np.repeat(scores[i, j].astype("float64"), n)
                    query, vec_id, score, place = _best(*map(np.concatenate, zip((query, vec_id, score), found, strict=True)), keep)
                    full = place == keep - 1
                    least[query[full]] = np.maximum(least[query[full]], score[full])
            return query, vec_id, score

        return best

    def solve(batches):
        """Groups come one after the other, cells first, then blocks of queries."""
        now, parts, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, is_block = batch.column("grp").to_numpy(), batch.column("cell").to_numpy() == n_cells
            edges = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (is_block[1:] != is_block[:-1])) + 1), len(grp)]
            for lo, hi in pairwise(edges):
                part = batch.slice(lo, hi - lo)
                if grp[lo] != now:
                    now, parts, best = grp[lo], [], None
                if not is_block[lo]:
                    parts.append(part)
                    continue
                if best is None:
                    best, parts = held(parts), []
                for i in range(part.num_rows):
                    one = part.slice(i, 1)
                    reps, least = (one.column(x).flatten().to_numpy() for x in ("ids", "least"))
                    query, vec_id, score = best(unpacked(one.column("v"), "float64"), least)
                    yield pa.RecordBatch.from_pydict({"rep": reps[query], "vec_id": vec_id, "score": score.astype("int64")})

    best_first = [F.desc("score"), F.asc("vec_id")]
    passing = data.unionByName(wanted.mapInArrow(route, stream)).repartitionById(n_groups, F.col("grp")).sortWithinPartitions("grp", "cell")
    found = passing.mapInArrow(solve, "rep long, vec_id long, score long")
    found = cut(found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(*best_first))).where(F.col("r") <= keep).drop("r"), "knn-found")
    drop_cut(cells)
    # both sides grow with the queries, and their sizes as guessed from files are far too low: never broadcast
    own = queries.select("v", F.col("vec_id").alias("query_id")).hint("merge").join(wanted, "v").select("query_id", "rep")
    return (
        own.hint("merge").join(found, "rep").where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first)).cast("int"))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every fiftieth vector; nulls, repeats and empty tables as top_k_inner_product() says."""
    v = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k_inner_product(v, v.where(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
