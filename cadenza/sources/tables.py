"""The driver's tables, with the columns that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Epoch microseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as triggers: us (epoch microseconds) and strength (value / 100, 1 at most)."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", micros(F.col("ts")).alias("us"), F.least(F.col("value") / 100, F.lit(1.0)).alias("strength"))


#: The same rows in DuckDB.
EVENTS_SQL = "(SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, least(value / 100, 1.0) AS strength FROM events)"
