"""Hopping windows whose overlap is counted once, streamed and batched alike, and repeatable sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all run in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/cadenza-stream/{uuid.uuid4().hex}"


def hopping(df: DataFrame, us: str, length: int, overlap: int) -> DataFrame:
    """Each row once per window [start, start + length) that holds it; windows start every length - overlap microseconds."""
    hop = length - overlap
    last = F.floor(F.col(us) / hop)
    first = F.floor((F.col(us) - length) / hop) + 1
    return df.withColumn("window_start", F.explode(F.transform(F.sequence(first, last), lambda n: n * hop)))


def tiled(df: DataFrame, us: str, length: int, overlap: int) -> DataFrame:
    """As hopping(), without what a window has from the overlap with the one before: every instant belongs to one window."""
    return hopping(df, us, length, overlap).where(F.col(us) >= F.col("window_start") + overlap)


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming frame over all that is there and return its table.

    Each micro-batch replaces (complete) or adds under its own number (append), so a batch that is
    repeated after a failure changes nothing. Offsets and state live in the shared folder.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        name = "table" if mode == "complete" else f"table/batch={number}"
        batch.write.mode("overwrite").parquet(f"{root}/{name}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table") if mode == "complete" else spark.read.parquet(f"{root}/table").drop("batch")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*")


#: Steps a job may take; completed and failed are final. Fixed values.
TRANSITIONS = {
    "new": {"queued", "running"},
    "queued": {"running", "failed"},
    "running": {"completed", "failed", "queued"},
}


def advance(state: str, revision: int, steps) -> tuple[str, int, int]:
    """State, revision and rejected steps after (target) steps in order; a final state takes no step."""
    rejected = 0
    for target in steps:
        if target in TRANSITIONS.get(state, ()):
            state, revision = target, revision + 1
        elif target != state:
            rejected += 1
    return state, revision, rejected


def job_states(stream: DataFrame, key: str, seq: str, target: str) -> DataFrame:
    """Keyed state machine over a stream of steps: key, state, revision and rejected after each micro-batch."""
    import pandas as pd

    def step(keys, batches, held: GroupState):
        state, revision, rejected = held.get if held.exists else ("new", 0, 0)
        pdf = pd.concat(list(batches)).sort_values(seq)
        state, revision, more = advance(state, revision, pdf[target])
        held.update((state, revision, rejected + more))
        yield pd.DataFrame({key: [keys[0]], "state": [state], "revision": [revision], "rejected": [rejected + more]})

    schema = f"{key} long, state string, revision long, rejected long"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "state string, revision long, rejected long", "append", GroupStateTimeout.NoTimeout)


def progress_blocks(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Blocks of key=value lines of each stream, each closed by a progress line: keys, block, ended, values (a map).

    Blocks are numbered from 0 in the stream's own order. The last of equal names in a block counts;
    lines without = and what no progress line closes are no part of a block.
    """
    from pyspark.sql import Window

    kv = lines.select(*keys, order, F.split(F.trim(line), "=", 2).alias("_p")).where(F.size("_p") == 2)
    kv = kv.select(*keys, order, F.trim(F.col("_p")[0]).alias("_name"), F.trim(F.col("_p")[1]).alias("_value"))
    closed = (F.col("_name") == "progress").cast("int")
    block = F.sum(closed).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - closed
    last = kv.withColumn("block", block).groupBy(*keys, "block", "_name").agg(F.max_by("_value", order).alias("_value"))
    out = last.groupBy(*keys, "block").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_value")))).alias("values"))
    return out.where(F.map_contains_key("values", "progress")).select(*keys, "block", (F.col("values")["progress"] == "end").alias("ended"), "values")
