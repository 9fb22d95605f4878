"""Store operators: tombstones and compaction, guarded states, receipts, first-wins guards, replay and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tombstoned(vectors: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """vectors with tombstoned set for the keys in gone; setting it again changes nothing."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return vectors.join(marks, key, "left").withColumn("tombstoned", F.col("tombstoned") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def compaction_due(vectors: DataFrame, least: int = 100, share: float = 0.2) -> DataFrame:
    """One row: n, dead and due, whether enough rows and a large enough share of them are tombstoned."""
    n = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("tombstoned")).alias("dead"))
    return n.withColumn("due", (F.col("dead") >= least) & (F.col("dead") >= share * F.col("n")))


def dense_ids(df: DataFrame, key: str, out: str, ranges: int = 256) -> DataFrame:
    """Add out: 0, 1, 2, ... in the order of a numeric key, without one task that sees all rows.

    Keys are dealt to ranges between approximate quantiles, so an outlying key doesn't crowd the rest;
    rows are numbered in their range and moved by the counts of the ranges before. Rows without a key go.
    """
    rows = df.where(F.col(key).isNotNull())
    edges = rows.agg(F.percentile_approx(key, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges).alias("_edges"))
    at = F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(key)))
    ranged = rows.crossJoin(F.broadcast(edges)).withColumn("_range", at).drop("_edges")  # one row
    counts = ranged.groupBy("_range").count()  # at most `ranges` rows
    offsets = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return numbered.join(F.broadcast(offsets.select("_range", "_before")), "_range").withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_range", "_rn", "_before")


def appended_vectors(store: DataFrame, new: DataFrame, vec: str) -> DataFrame:
    """store and new; the store's vectors fix the dimension, and a new one of another size raises an error."""
    size = store.agg(F.first(F.size(vec), ignorenulls=True)).first()[0]  # one number
    if size is None:
        return store.unionByName(new)
    ok = F.when(F.size(vec) == size, F.col(vec)).otherwise(F.raise_error(F.lit("vector of another dimension")).cast(new.schema[vec].dataType))
    return store.unionByName(new.withColumn(vec, ok))


def linked(vectors: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """New vectors with tombstoned set where their link wasn't written, so that search never finds half of a pair."""
    there = links.select(key).distinct().withColumn("_there", F.lit(True))
    return vectors.join(there, key, "left").withColumn("tombstoned", F.col("_there").isNull()).drop("_there")


def current_only(rows: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """is_current for the newest row of each key, and for no other."""
    order = [F.desc(c) for c in newest]
    return rows.withColumn("is_current", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: what an insert that ignores duplicates leaves."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def enqueue(queue: DataFrame, jobs: DataFrame, key: str, order: str) -> DataFrame:
    """queue with the jobs whose key it doesn't hold yet, one of each."""
    return queue.unionByName(first_wins(jobs, [key], order).join(queue.select(key), key, "left_anti").select(*queue.columns))


def guarded(rows: DataFrame, state: str, target: Column, allowed: dict[str, list[str]], stamp: str, now: Column, stamped: str) -> DataFrame:
    """Rows moved to target where that step is allowed; stamp keeps the first time at which the state `stamped` was entered."""
    ok = F.lit(False)
    for a, targets in allowed.items():
        ok = ok | ((F.col(state) == a) & target.isin(targets))
    ok = F.coalesce(ok, F.lit(False))
    entered = F.when(ok & (target == stamped), F.coalesce(F.col(stamp), now)).otherwise(F.col(stamp))
    return rows.withColumn("moved", ok).withColumn(stamp, entered).withColumn(state, F.when(F.col("moved"), target).otherwise(F.col(state)))


def version_faults(migrations: DataFrame, version: str) -> DataFrame:
    """version and fault ('gap' or 'duplicate') of an ordered list of migrations, which is a list of files and short."""
    n = migrations.groupBy(version).count()
    gap = F.col(version) - F.lag(version).over(Window.orderBy(version)) > 1
    return n.withColumn("_gap", gap).select(version, F.when(F.col("count") > 1, "duplicate").when(F.col("_gap"), "gap").alias("fault")).where("fault is not null")


def unique_times(rows: DataFrame, keys: list[str], us: str, tie: str, out: str) -> DataFrame:
    """Add out: the row's time, moved on by microseconds where needed to be later than every one before it in its series."""
    w = Window.partitionBy(*keys).orderBy(us, tie)
    return rows.withColumn("_rn", F.row_number().over(w)).withColumn("_m", F.col(us) - F.col("_rn")).withColumn(out, F.max("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_rn")).drop("_rn", "_m")


def replay(journal: DataFrame, clients: DataFrame, client: str, seq: str, last_seen: str, kept: int) -> DataFrame:
    """For each client the events after its last seen one that a journal of the last `kept` still holds; gap tells whether some are lost."""
    bounds = journal.agg(F.max(seq).alias("_top")).first()[0] or 0  # one number
    oldest = bounds - kept + 1
    start = clients.select(client, F.greatest(F.col(last_seen) + 1, F.lit(oldest)).alias("_from"), (F.col(last_seen) + 1 < oldest).alias("gap"))
    events = start.where(F.col("_from") <= bounds).withColumn(seq, F.explode(F.sequence(F.col("_from"), F.lit(bounds).cast("long"))))
    return events.join(journal, seq).drop("_from")


def resumable(want: dict[str, object]) -> Column:
    """Whether a checkpoint was written under exactly this configuration; a null never fits."""
    out = F.lit(True)
    for name, value in want.items():
        out = out & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return out


def valid_rows(rows: DataFrame, idx: str, start: str, length: str, step: float, status: str) -> DataFrame:
    """Checkpointed rows that may be used again: at the place their number says, of a positive length, completed."""
    return rows.where((F.abs(F.col(start) - F.col(idx) * step) < 1e-6) & (F.col(length) > 0) & (F.col(status) == "completed"))
