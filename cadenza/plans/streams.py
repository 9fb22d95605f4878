"""Queries that run as Structured Streaming over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, events, micros
from ..streaming import windows

HOUR = 3_600_000_000
LENGTH, OVERLAP = 6 * HOUR, HOUR

_HOPS = f"(SELECT *, unnest(range(CAST(floor((us - {LENGTH}) / {LENGTH - OVERLAP}.0E0) AS BIGINT) + 1, CAST(floor(us / {LENGTH - OVERLAP}.0E0) AS BIGINT) + 1)) * {LENGTH - OVERLAP} AS window_start FROM {EVENTS_SQL})"


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    s = windows.event_stream(spark, f"{d}/events.parquet")
    return s.withColumn("us", micros(F.col("ts")))


def stm01(spark: SparkSession, d: str) -> DataFrame:
    e = windows.hopping(events(spark, d), "us", LENGTH, OVERLAP)
    return e.groupBy("window_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def stm02(spark: SparkSession, d: str) -> DataFrame:
    """The tiled windows, streamed: partial sums in state, each instant in one window."""
    e = windows.tiled(_streamed(spark, d), "us", LENGTH, OVERLAP)
    out = windows.run_available(e.groupBy("window_start", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return out.withColumn("total", F.round("total", 4))


def stm13(spark: SparkSession, d: str) -> DataFrame:
    """Operations that arrive twice count once."""
    s = _streamed(spark, d).select("event_id", "user_id", "value")
    once = s.unionByName(s.where("event_id % 2 = 0")).dropDuplicates(["event_id"])
    out = windows.run_available(once, "append")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def stm18(spark: SparkSession, d: str) -> DataFrame:
    """A job for each user, its steps from the event types; the last state that was reported."""
    kind = F.col("event_type")
    target = F.when(kind == "signup", "queued").when(kind == "click", "running").when(kind == "purchase", "completed").when(kind == "error", "failed")
    steps = _streamed(spark, d).select("user_id", F.struct("us", "event_id").alias("o"), target.alias("target")).where("target is not null")
    steps = steps.select("user_id", F.format_string("%020d-%020d", "o.us", "o.event_id").alias("seq"), "target")
    out = windows.run_available(windows.job_states(steps, "user_id", "seq", "target"), "append")
    return out.groupBy("user_id").agg(F.max_by(F.struct("state", "rejected"), F.struct("revision", "rejected")).alias("s"), F.max("revision").alias("revision")).select("user_id", "s.state", "revision", "s.rejected")


QUERIES = {"stm01_hopping_windows": stm01, "stm02_streamed_tiles": stm02, "stm13_exactly_once": stm13, "stm18_job_states": stm18}
ORACLES = {
    "stm01_hopping_windows": f"SELECT window_start, count(*) AS n, round(sum(value), 4) AS total FROM {_HOPS} GROUP BY window_start",
    "stm02_streamed_tiles": f"SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_HOPS} WHERE us >= window_start + {OVERLAP} GROUP BY window_start, event_type",
    "stm13_exactly_once": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id",
    "stm18_job_states": f"""WITH RECURSIVE s AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {EVENTS_SQL} WHERE event_type <> 'view'),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 'new' AS state, CAST(0 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS rejected FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT f.user_id, s.rn, CASE WHEN ok THEN s.t ELSE f.state END, f.revision + CASE WHEN ok THEN 1 ELSE 0 END, f.rejected + CASE WHEN NOT ok AND s.t <> f.state THEN 1 ELSE 0 END
  FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1, LATERAL (SELECT (f.state = 'new' AND s.t IN ('queued', 'running')) OR (f.state = 'queued' AND s.t IN ('running', 'failed')) OR (f.state = 'running' AND s.t IN ('completed', 'failed', 'queued')) AS ok))
SELECT user_id, max_by(state, rn) AS state, max(revision) AS revision, max(rejected) AS rejected FROM f GROUP BY user_id""",
}
