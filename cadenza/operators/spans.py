"""One long series over many tasks: spans of time with carried rows, blocks with halos, sums on two levels.

A window over a whole key puts that key into one task. Here a series is dealt to spans (of time, between
quantiles) or blocks (of so many rows), and tasks meet their neighbours' rows in one of three ways:
the last row of each span is carried over the few summaries of spans, the rows near a block's ends are
copied to its neighbours, or a block starts from the sums of all blocks before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a span, and spans at most: the summaries of a key are put in order by one task.
ROWS = 1_000_000
SPANS = 4096
#: Rows of a block.
BLOCK = 65_536


def edges(df: DataFrame, at: str, rows: int | None = None) -> list[float]:
    """Instants that part df into spans of about `rows` (ROWS) rows; none if it holds no more. No key has more rows in a span than all keys together, so a hot key is shared out as well."""
    rows = rows or ROWS
    n = df.count()
    if n <= rows:
        return []
    k = min(SPANS, -(-n // rows))
    return sorted(set(df.select(F.col(at).cast("double").alias("t")).approxQuantile("t", [i / k for i in range(1, k)], 1 / (4 * k))))


def spanned(df: DataFrame, at: str, parts: list[float], out: str = "_span") -> DataFrame:
    """Add the number of each row's span; it never falls as `at` rises. Rows without an instant come first, in a span of their own."""
    if not parts:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *parts, float("inf")], inputCol="_cut", outputCol="_found", handleInvalid="keep")
    return cut.transform(df.withColumn("_cut", F.col(at).cast("double"))).withColumn(out, F.when(F.col("_cut").isNull(), -1).otherwise(F.col("_found").cast("int"))).drop("_cut", "_found")


def carried(rows: DataFrame, keys: list[str], at: str, first: str, value: str, parts: list[float], backward: str | None = None, forward: str | None = None) -> DataFrame:
    """rows with the last `value` that isn't null at or before (backward) and the first at or after (forward) each row, as columns of these names.

    Rows of one instant come in the order of `first`, which must put rows with a value before those
    that ask for it. Each (key, span) is sorted by itself. The values at the ends of all spans, one row a
    span, are put in order by key, and what comes from earlier or later spans enters a span as a row.
    """
    placed = spanned(rows.withColumn("_rank", F.lit(0)), at, parts)
    if parts:
        has = F.when(F.col(value).isNotNull(), F.struct(at, first))
        ends = placed.groupBy(*keys, "_span").agg(F.max_by(value, has).alias("_last"), F.min_by(value, has).alias("_first"))
        w = Window.partitionBy(*keys).orderBy("_span")
        before = F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("_first", True).over(Window.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*keys, "_span", before.alias("_before"), after.alias("_after"))
        row = lambda rank, c: F.struct(F.lit(rank).alias("_rank"), F.col(c).alias(value))
        ends = ends.select(*keys, "_span", F.inline(F.array(row(-1, "_before"), row(1, "_after")))).where(F.col(value).isNotNull())
        placed = placed.unionByName(ends, allowMissingColumns=True)
    start = Window.partitionBy(*keys, "_span")
    past = lambda *order: start.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if backward:
        placed = placed.withColumn(backward, F.last(value, True).over(past("_rank", at, first)))
    if forward:  # the same from the end: a frame that reaches to the end would be read anew for every row
        placed = placed.withColumn(forward, F.last(value, True).over(past(F.desc("_rank"), F.desc(at), first)))
    return placed.where("_rank = 0").drop("_rank", "_span")


def numbered(df: DataFrame, keys: list[str], by: list[str], out: str = "idx", rows: int | None = None, parts: list[float] | None = None) -> DataFrame:
    """Add the position of each row in its series from 0, in the order of `by`, whose first column is an instant: numbers within spans, on from the rows of earlier spans."""
    placed = spanned(df, by[0], edges(df, by[0], rows) if parts is None else parts)
    n = placed.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select(*[F.col(c).alias(f"_r{c}") for c in (*keys, "_span")], F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*by)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in (*keys, "_span")]
    return placed.withColumn("_here", here).join(n, same).select(*df.columns, (F.col("_here") + F.col("_before")).cast("long").alias(out))


def running_sum(df: DataFrame, keys: list[str], by: list[str], value: str, out: str, rows: int | None = None) -> DataFrame:
    """Add the sum of the values up to and with each row in the order of `by`, whose first column is an instant and whose last makes it unique: sums within spans, on from those of earlier spans."""
    parts = edges(df, by[0], rows)
    upto = lambda *k: Window.partitionBy(*k).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    if not parts:
        return df.withColumn(out, F.sum(value).over(upto(*keys)))
    placed = spanned(df, by[0], parts)
    sums = placed.groupBy(*keys, "_span").agg(F.sum(value).alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_r{c}") for c in (*keys, "_span")], F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in (*keys, "_span")]
    return placed.withColumn("_here", F.sum(value).over(upto(*keys, "_span"))).join(sums, same).select(*df.columns, (F.col("_here") + F.col("_before")).alias(out))


def framed(df: DataFrame, keys: list[str], by: list[str], reach: int, make: Callable, rows: int | None = None) -> DataFrame:
    """Add what make(window) gives, a column for each name, where each row sees the `reach` rows to each side of it in the order of `by`.

    Up to ROWS rows the window is one over the key; beyond, rows are numbered and copied to the blocks
    whose rows they lie beside, so a window sorts a block of BLOCK rows and its halo.
    """
    parts = edges(df, by[0], rows)
    if not parts:
        return df.withColumns(make(Window.partitionBy(*keys).orderBy(*by)))
    placed = haloed(numbered(df, keys, by, "_idx", parts=parts), "_idx", BLOCK, reach)
    made = make(Window.partitionBy(*keys, "_block").orderBy("_idx"))
    return placed.withColumns(made).where("_own").drop("_idx", "_block", "_own")


def prefix_sums(df: DataFrame, keys: list[str], idx: str, value: str, out: str, size: int | None = None) -> DataFrame:
    """Add the sum of the values up to and with each row: sums within blocks of `size` (BLOCK) positions, on from the sums of the blocks before."""
    rows = df.withColumn("_block", F.floor(F.col(idx) / (size or BLOCK)))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_r{c}") for c in (*keys, "_block")], F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in (*keys, "_block")]
    return rows.withColumn("_here", here).join(sums, same).select(*df.columns, (F.col("_here") + F.col("_before")).alias(out))


def haloed(df: DataFrame, idx: str, size: int, reach: int) -> DataFrame:
    """Every row in its block of `size` positions, and in each other block that lies within `reach` of it; _own marks the block that it counts for.

    A window over (key, _block) then sees all of a row's neighbours up to `reach`, if the row is the
    block's own. Rows are copied about 1 + 2 * reach / size times.
    """
    block = lambda x: F.floor(x / size)
    lists = F.sequence(F.greatest(block(F.col(idx) - reach), F.lit(0)), block(F.col(idx) + reach))
    return df.withColumn("_block", F.explode(lists)).withColumn("_own", F.col("_block") == block(F.col(idx)))


def blockwise(df: DataFrame, keys: list[str], idx: str, columns: list[str], size: int, reach: int, work: Callable, schema: str) -> DataFrame:
    """keys, idx and what work makes of each block: it gets an Arrow table of the block and its halo in order, and gives one array a column, as long as the table."""
    types = dict(df.dtypes)
    names = [*keys, idx]
    rows = haloed(df.select(*names, *columns), idx, size, reach)

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by(idx).combine_chunks()
        made = work(table)
        out = pa.Table.from_arrays([*(table.column(c) for c in names), *made], names=[*names, *made_names])
        return out.filter(table.column("_own")) if pc.any(table.column("_own")).as_py() else out.slice(0, 0)

    made_names = [part.split()[0] for part in schema.split(",")]
    return rows.groupBy(*keys, "_block").applyInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in names), schema]))
