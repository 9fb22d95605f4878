"""Queries over stores, selection, identifiers and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import selection, sequence, spans, stores
from ..sources.tables import EVENTS_SQL, events, read

QUERIES: dict = {}
ORACLES: dict = {}
TOKENS_SQL = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


def vector_store(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").withColumn("tombstoned", F.col("label") == 9)
    return stores.tombstoned(v, v.where("vec_id % 5 = 0"), "vec_id")


_STORE = "(SELECT vec_id, label, label = 9 OR vec_id % 5 = 0 AS tombstoned FROM embeddings)"


# --- stores ---


@query("src04_newest_first", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders")
def src04(spark: SparkSession, d: str) -> DataFrame:
    """All orders with their place, the newest first."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("late"))
    n = spans.numbered(o, [], ["late", "o_orderkey"], "pos")
    return n.select("o_orderkey", "o_orderdate", (F.col("pos") + 1).alias("pos"))


@query("src08_live_vectors", f"SELECT vec_id, label FROM {_STORE} WHERE NOT tombstoned")
def src08(spark: SparkSession, d: str) -> DataFrame:
    return vector_store(spark, d).where(~F.col("tombstoned")).select("vec_id", "label")


@query("snk11_compaction_due", f"SELECT count(*) AS n, count(*) FILTER (tombstoned) AS dead, count(*) FILTER (tombstoned) >= 100 AND count(*) FILTER (tombstoned) >= 0.2 * count(*) AS due FROM {_STORE}")
def snk11(spark: SparkSession, d: str) -> DataFrame:
    return stores.compaction_due(vector_store(spark, d))


@query("snk12_dense_ids", f"SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM {_STORE} WHERE NOT tombstoned")
def snk12(spark: SparkSession, d: str) -> DataFrame:
    return stores.dense_ids(vector_store(spark, d).where(~F.col("tombstoned")).select("vec_id"), "vec_id", "new_id")


@query("snk03_bulk_status", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4) THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def snk03(spark: SparkSession, d: str) -> DataFrame:
    hit = read(spark, d, "customer").where("c_nationkey = 4").select(F.col("c_custkey").alias("o_custkey"), F.lit("X").alias("new"))
    return read(spark, d, "orders").join(hit, "o_custkey", "left").select("o_orderkey", F.coalesce("new", "o_orderstatus").alias("status"))


@query("snk04_reset_derived", "SELECT p_partkey, CASE WHEN p_size = 5 THEN NULL ELSE p_type END AS p_type, CASE WHEN p_size = 5 THEN 'new' ELSE 'done' END AS status FROM part")
def snk04(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("p_size") == 5
    return read(spark, d, "part").select("p_partkey", F.when(~hit, F.col("p_type")).alias("p_type"), F.when(hit, "new").otherwise("done").alias("status"))


@query("snk09_appended_vectors", "SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dim FROM (SELECT embedding FROM embeddings UNION ALL SELECT embedding FROM embeddings WHERE label = 1)")
def snk09(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return stores.appended_vectors(v, v.where("label = 1"), "embedding").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"))


@query("snk15_current_rows", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders")
def snk15(spark: SparkSession, d: str) -> DataFrame:
    return stores.current_only(read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "is_current")


@query("snk17_enqueued_jobs", "SELECT sha256(CAST(o_custkey AS VARCHAR) || '|/out/' || lower(o_orderpriority) || '|' || o_orderstatus) AS h, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus")
def snk17(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("\\OUT//"), F.col("o_orderpriority"))
    jobs = read(spark, d, "orders").select(ids.job_hash(F.col("o_custkey"), path, F.col("o_orderstatus"), path=1).alias("h"), "o_orderkey")
    first = stores.enqueue(jobs.where("false"), jobs.where("o_orderkey % 2 = 0"), "h", "o_orderkey")
    late = stores.enqueue(first, jobs, "h", "o_orderkey")
    return late.groupBy("h").agg(F.count("*").alias("n")).where("n = 1").select("h").join(jobs.groupBy("h").agg(F.min("o_orderkey").alias("o_orderkey")), "h")


@query(
    "snk18_guarded_states",
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS state, CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'queued' END AS target, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS started FROM orders),
m AS (SELECT *, (state = 'queued' AND target = 'running') OR (state = 'running' AND target IN ('completed', 'failed')) OR (state = 'failed' AND target = 'queued') AS moved FROM s)
SELECT o_orderkey, moved, CASE WHEN moved THEN target ELSE state END AS state, CASE WHEN moved AND target = 'running' THEN coalesce(started, 1.0E0) ELSE coalesce(started, 0.0E0) END AS started FROM m""",
)
def snk18(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, "queued").when(k % 4 == 1, "running").when(k % 4 == 2, "completed").otherwise("failed").alias("state"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("started")
    )
    target = F.when(k % 3 == 0, "running").when(k % 3 == 1, "completed").otherwise("queued")
    steps = {"queued": ["running"], "running": ["completed", "failed"], "failed": ["queued"]}
    return stores.guarded(o, "state", target, steps, "started", F.lit(1.0), "running").select("o_orderkey", "moved", "state", F.coalesce("started", F.lit(0.0)).alias("started"))


@query("snk19_interrupted", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' ELSE o_orderstatus END AS status FROM orders")
def snk19(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, d, "orders").select("o_orderkey", F.when(s == "P", "interrupted").otherwise(s).alias("status"))


@query("snk24_pruned_backups", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name DESC, p_partkey DESC) AS rn FROM part) WHERE rn > 4")
def snk24(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_name"), F.desc("p_partkey"))
    return read(spark, d, "part").withColumn("rn", F.row_number().over(w)).where("rn > 4").select("p_partkey")


@query("snk25_deleted_by_age", "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def snk25(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    newest = o.agg(F.max("o_orderdate").alias("newest"))
    return o.crossJoin(F.broadcast(newest)).where("o_orderdate < newest - interval 365 days").select("o_orderkey")  # one row


@query("snk26_version_faults", "WITH v AS (SELECT p_size AS version, count(*) AS n FROM part GROUP BY p_size), g AS (SELECT *, version - lag(version) OVER (ORDER BY version) > 1 AS gap FROM v) SELECT version, CASE WHEN n > 1 THEN 'duplicate' ELSE 'gap' END AS fault FROM g WHERE n > 1 OR gap")
def snk26(spark: SparkSession, d: str) -> DataFrame:
    return stores.version_faults(read(spark, d, "part").select(F.col("p_size").alias("version")), "version")


@query("snk27_first_wins", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority")
def snk27(spark: SparkSession, d: str) -> DataFrame:
    return stores.first_wins(read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")


_NS = "".join(f"\\x{ids.NAMESPACE_URL[i:i + 2].upper()}" for i in range(0, 32, 2))
_UUID = f"""(SELECT k, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u
FROM (SELECT o_orderkey AS k, sha1('{_NS}'::BLOB || encode(CAST(o_orderkey AS VARCHAR))) AS h FROM orders))"""


@query("dat01_uuid5", f"SELECT k AS o_orderkey, u AS uuid FROM {_UUID}")
def dat01(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", ids.uuid5(F.col("o_orderkey").cast("string")).alias("uuid"))


@query("snk28_uuid_audit", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS distinct_ids, CAST(0 AS BIGINT) AS missing FROM orders")
def snk28(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "orders").select(ids.uuid5(F.col("o_orderkey").cast("string")).alias("uuid"))
    return u.agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("distinct_ids"), F.count_if(F.col("uuid").isNull()).alias("missing"))


@query("dat02_unique_times", "WITH o AS (SELECT event_id, user_id, us // 60000000 AS us, row_number() OVER (PARTITION BY user_id ORDER BY us // 60000000, event_id) AS rn FROM {ev}) SELECT event_id, max(us - rn) OVER (PARTITION BY user_id ORDER BY rn) + rn AS at FROM o")
def dat02(spark: SparkSession, d: str) -> DataFrame:
    """Times cut to minutes, so that some are equal."""
    e = events(spark, d).withColumn("us", F.floor(F.col("us") / 60_000_000))
    return stores.unique_times(e, ["user_id"], "us", "event_id", "at").select("event_id", "at")


#: A frame rate as an exact fraction. Fixed value.
NTSC = (30000, 1001)


@query("dat04_frame_count", "SELECT event_id, CAST(round(CAST(value AS DECIMAL(12, 2)) * 30000 / 1001, 0) AS BIGINT) AS frames, 30000 AS num, 1001 AS den FROM {ev}")
def dat04(spark: SparkSession, d: str) -> DataFrame:
    num, den = NTSC
    frames = F.round(F.col("value").cast("decimal(12,2)") * num / F.lit(den).cast("decimal(6,0)"), 0).cast("long")
    return events(spark, d).select("event_id", frames.alias("frames"), F.lit(num).alias("num"), F.lit(den).alias("den"))


@query("stm06_valid_checkpoints", "SELECT event_id FROM (SELECT event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {ev}) WHERE idx % 3 <> 1 AND value > 50 AND event_type = 'click'")
def stm06(spark: SparkSession, d: str) -> DataFrame:
    e = sequence.indexed(events(spark, d), ["user_id"], "us", "event_id")
    rows = e.withColumn("start", F.col("idx") * 90.0 + F.when(F.col("idx") % 3 == 1, 1.0).otherwise(0.0)).withColumn("length", F.col("value") - 50)
    rows = rows.withColumn("status", F.when(F.col("event_type") == "click", "completed").otherwise("failed"))
    return stores.valid_rows(rows, "idx", "start", "length", 90.0, "status").select("event_id")


@query("stm05_resumable", "SELECT p_partkey FROM part WHERE p_size = 7 AND p_partkey % 2 = 1")
def stm05(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("odd", F.col("p_partkey") % 2 == 1)
    return p.where(stores.resumable({"p_size": 7, "odd": True})).select("p_partkey")


@query("stm07_typed_accumulators", "SELECT CAST(floor(us / 86400000000.0E0) AS BIGINT) AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM {ev} GROUP BY 1")
def stm07(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"click": "clicks", "view": "views", "purchase": "purchases", "error": "errors"}
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return e.groupBy("day").agg(*[F.count_if(F.col("event_type") == k).alias(n) for k, n in kinds.items()])


@query(
    "stm08_replay",
    "WITH c AS (SELECT n_nationkey, CAST(n_nationkey * 35 AS BIGINT) AS seen, (SELECT max(event_id) FROM events) AS top FROM nation) SELECT n_nationkey, gap, event_id FROM (SELECT n_nationkey, seen + 1 < top - 499 AS gap, greatest(seen + 1, top - 499) AS f FROM c) JOIN events ON event_id >= f",
)
def stm08(spark: SparkSession, d: str) -> DataFrame:
    clients = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 35).cast("long").alias("seen"))
    return stores.replay(read(spark, d, "events").select("event_id"), clients, "n_nationkey", "event_id", "seen", 500).select("n_nationkey", "gap", "event_id")


@query("stm11_journal", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM {ev} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) <= 30")
def stm11(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = events(spark, d).withColumn("seq", F.row_number().over(w.orderBy("us", "event_id")).cast("long")).withColumn("n", F.count("*").over(w))
    return e.where("seq > n - 30").select("event_id", "seq")


# --- selection ---

_CANDS = "(SELECT user_id, event_id % 5 AS slot, event_id, us, round(strength, 6) AS score, value FROM {ev})"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", (F.col("event_id") % 5).alias("slot"), "event_id", "us", F.round("strength", 6).alias("score"), "value")


@query("top03_reranked", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, slot ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM {_CANDS} WHERE score >= 0.4")
def top03(spark: SparkSession, d: str) -> DataFrame:
    return selection.reranked(candidates(spark, d), ["user_id", "slot"], "score", "event_id", 0.4).select("event_id", "rank")


@query("top05_excluded", "WITH s AS (SELECT event_id, strength, value, row_number() OVER (ORDER BY strength DESC, value, event_id) AS rn FROM {ev}) SELECT event_id FROM (SELECT event_id, rn FROM s WHERE rn <= 40 AND event_id % 3 <> 0 ORDER BY rn LIMIT 20)")
def top05(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    twice = e.orderBy(F.desc("strength"), "value", "event_id").limit(40)
    return twice.join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").orderBy(F.desc("strength"), "value", "event_id").limit(20).select("event_id")


@query(
    "top07_near_tie",
    f"WITH c AS {_CANDS}, m AS (SELECT *, max(score) OVER (PARTITION BY user_id, slot) AS best FROM c) SELECT user_id, slot, event_id FROM m WHERE score >= best - 0.03 QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY value % 7 DESC, score DESC, event_id) = 1",
)
def top07(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).withColumn("second", F.col("value") % 7)
    return selection.near_tie(c, ["user_id", "slot"], "score", "second", "event_id", 0.03).select("user_id", "slot", "event_id")


@query(
    "top09_best_or_fallback",
    f"WITH b AS (SELECT user_id, event_id FROM {_CANDS} WHERE score >= 0.999 AND slot = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1), r AS (SELECT DISTINCT user_id FROM {{ev}}) SELECT r.user_id, coalesce(b.event_id, -1) AS event_id, CASE WHEN b.event_id IS NULL THEN 'fallback' ELSE 'ranked' END AS source FROM r LEFT JOIN b ON b.user_id = r.user_id",
)
def top09(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    r = c.select("user_id").distinct()
    return selection.best_or(c.where("slot = 1"), r, ["user_id"], "event_id", "score", "event_id", F.lit(-1).cast("long"), 0.999)


@query(
    "top10_without_recent",
    """WITH RECURSIVE s AS (SELECT user_id, us, clip, max(1 - abs(clip / 10.0E0 - strength)) AS score FROM {ev}, range(10) r(clip) WHERE event_type = 'click' GROUP BY ALL),
o AS MATERIALIZED (SELECT user_id, us, list(clip ORDER BY score DESC, clip) AS c, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM s GROUP BY user_id, us),
k AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS clip, false AS fresh, CAST([] AS BIGINT[]) AS recent FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, rn, us, coalesce(pick, c[1]), pick IS NOT NULL, list_append(list_filter(recent, lambda x: x <> coalesce(pick, c[1])), coalesce(pick, c[1]))[-3:] FROM (
    SELECT o.user_id, o.rn, o.us, c, recent, list_filter(c, lambda x: NOT list_contains(recent, x))[1] AS pick FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1))
SELECT user_id, us, clip, fresh FROM k WHERE rn > 0""",
)
def top10(spark: SparkSession, d: str) -> DataFrame:
    """For each instant of a user one of ten clips, none of the last three."""
    c = events(spark, d).where("event_type = 'click'").select("user_id", "us", "strength", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("clip"))
    c = c.withColumn("score", 1 - F.abs(F.col("clip") / 10 - F.col("strength"))).groupBy("user_id", "us", "clip").agg(F.max("score").alias("score"))
    return selection.without_recent(c, ["user_id"], "us", "clip", "score", 3)


@query(
    "top14_usage_penalty",
    """WITH RECURSIVE s AS (SELECT user_id, us, clip, max(1 - abs(clip / 10.0E0 - strength)) AS score FROM {ev}, range(10) r(clip) WHERE event_type = 'view' GROUP BY ALL),
o AS MATERIALIZED (SELECT user_id, us, list({'clip': clip, 'score': score} ORDER BY clip) AS c, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM s GROUP BY user_id, us),
k AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS clip, list_transform(range(10), lambda x: CAST(0 AS INTEGER)) AS used FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, rn, us, pick, list_transform(range(10), lambda x: CAST(used[x + 1] + CASE WHEN x = pick THEN 1 ELSE 0 END AS INTEGER)) FROM (
    SELECT o.user_id, o.rn, o.us, used, list_sort(list_transform(c, lambda y: {'v': -y.score / (1 + 0.5::DOUBLE * used[y.clip + 1]), 'clip': y.clip}))[1].clip AS pick FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1))
SELECT user_id, us, clip FROM k WHERE rn > 0""",
)
def top14(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).where("event_type = 'view'").select("user_id", "us", "strength", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("clip"))
    c = c.withColumn("score", 1 - F.abs(F.col("clip") / 10 - F.col("strength"))).groupBy("user_id", "us", "clip").agg(F.max("score").alias("score"))
    return selection.with_usage_penalty(c, ["user_id"], "us", "clip", "score")


@query(
    "top15_contributions",
    "WITH c AS (SELECT user_id, 'a' || (event_id % 17) AS axis, round(sum(value), 4) * 0.5 AS c FROM {ev} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, axis) AS t, row_number() OVER (PARTITION BY user_id ORDER BY c, axis) AS b FROM c) SELECT user_id, axis, 'top' AS side, CAST(t AS INTEGER) AS rank, c AS contribution FROM r WHERE t <= 3 UNION ALL SELECT user_id, axis, 'bottom', CAST(b AS INTEGER), c FROM r WHERE b <= 3",
)
def top15(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d).groupBy("user_id", F.concat(F.lit("a"), F.col("event_id") % 17).alias("axis")).agg(F.round(F.sum("value"), 4).alias("v")).withColumn("w", F.lit(0.5))
    return selection.contributions(v, ["user_id"], "axis", "v", "w", 3)


@query(
    "top17_evicted_by_priority",
    "SELECT event_id FROM (SELECT event_id, coalesce(sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {ev} WHERE event_type <> 'purchase') WHERE b < 100000",
)
def top17(spark: SparkSession, d: str) -> DataFrame:
    m = events(spark, d).where("event_type <> 'purchase'").select("user_id", "event_id", "us", F.round(F.col("value") * 100).cast("long").alias("mb"), (F.col("event_id") % 4).alias("p"))
    return selection.evict_by_priority(m, ["user_id"], "mb", "p", "us", "event_id", 100_000).select("event_id")


@query("udf19_cyclic_choice", "SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) % 5 AS INTEGER) AS clip FROM {ev}")
def udf19(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events(spark, d).select("event_id", F.pmod(F.row_number().over(w) - 1, F.lit(5)).alias("clip"))


@query("udf18_hashed_choice", None)
def udf18(spark: SparkSession, d: str) -> DataFrame:
    """One event of each user, drawn by a seeded hash: the same one each time."""
    e = events(spark, d).groupBy("user_id").agg(F.min_by("event_id", F.xxhash64("event_id", F.lit(42))).alias("event_id"))
    return e


@query("udf15_cluster_labels", "WITH l AS (SELECT event_id, user_id, event_type, us, CASE WHEN strength > 0.8 THEN 'drop' WHEN strength < 0.2 THEN 'break' ELSE 'verse' END AS label FROM {ev}) SELECT event_id, first(label) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS label FROM l")
def udf15(spark: SparkSession, d: str) -> DataFrame:
    """Rule labels, then the first label of each cluster for all of it."""
    s = F.col("strength")
    e = events(spark, d).withColumn("label", F.when(s > 0.8, "drop").when(s < 0.2, "break").otherwise("verse"))
    return e.select("event_id", F.first("label").over(Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")).alias("label"))


@query("udf16_mood_match", "SELECT p_partkey, round(0.5 * CASE WHEN contains(lower(p_type), 'brass') THEN 1 ELSE 0 END + 0.3 * (1 - abs(p_size / 50.0E0 - 0.5)) + 0.2 * least(1.0, p_retailprice / 2000), 6) AS score FROM part")
def udf16(spark: SparkSession, d: str) -> DataFrame:
    word = F.contains(F.lower("p_type"), F.lit("brass")).cast("int")
    return read(spark, d, "part").select("p_partkey", F.round(0.5 * word + 0.3 * (1 - F.abs(F.col("p_size") / 50 - 0.5)) + 0.2 * F.least(F.lit(1.0), F.col("p_retailprice") / 2000), 6).alias("score"))


@query("set04_trigger_union", "SELECT user_id, us, 'beat' AS kind FROM {ev} WHERE event_type = 'click' UNION ALL SELECT user_id, us, 'onset' FROM {ev} WHERE event_type = 'view' UNION ALL SELECT user_id, us, 'energy' FROM {ev} WHERE value > 300 UNION ALL SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'start' FROM {ev}")
def set04(spark: SparkSession, d: str) -> DataFrame:
    """Triggers of three detectors and a start row for each series: one pass over the events."""
    e = events(spark, d)
    kinds = F.array_compact(F.array(F.when(F.col("event_type") == "click", "beat"), F.when(F.col("event_type") == "view", "onset"), F.when(F.col("value") > 300, "energy")))
    return e.select("user_id", "us", F.explode(kinds).alias("kind")).unionByName(e.select("user_id", F.lit(0).cast("long").alias("us"), F.lit("start").alias("kind")).distinct())


# --- texts and tags ---


@query(
    "str01_parsed_tags",
    """WITH t AS (SELECT p_partkey, list_distinct(list_filter(list_transform(string_split(lower(p_name || ', ' || p_type || ',ok;' || p_brand), ','), lambda x: trim(regexp_replace(regexp_replace(x, '[^a-z0-9 -]', ' ', 'g'), ' +', ' ', 'g'))), lambda x: len(x) > 2 AND x <> 'stop' AND len(string_split(x, ' ')) <= 4)) AS tags FROM (SELECT p_partkey, p_name, replace(p_type, ';', ',') AS p_type, p_brand FROM part)) SELECT p_partkey, CAST(len(tags) AS INTEGER) AS n FROM t""",
)
def str01(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(", "), "p_type", F.lit(",ok,"), "p_brand")
    return read(spark, d, "part").select("p_partkey", F.size(text.parsed_tags(raw, ["stop"], 12)).alias("n"))


@query("str02_generalised", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'tree' WHEN event_id % 9 = 1 THEN 'one person' WHEN event_id % 9 = 2 THEN 'two people' WHEN event_id % 9 > 2 THEN 'group of people' ELSE '0 people' END AS tag FROM events")
def str02(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    tag = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, "tree").otherwise(F.concat((i % 9).cast("string"), F.lit(" people")))
    return events(spark, d).select("event_id", text.generalised_tag(tag).alias("tag"))


@query("str04_refused", r"SELECT conv_id, turn, contains(lower(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), 'the') OR trim(coalesce(text, '')) = '' AS refused FROM conversations")
def str04(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.refused(F.col("text"), ["the"]).alias("refused"))


@query("str09_in_lexicon", f"SELECT p_partkey, list_has_any({TOKENS_SQL.format('p_type')}, ['brass', 'steel']) AS hit FROM part")
def str09(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.in_lexicon(F.col("p_type"), ["brass", "steel"]).alias("hit"))


@query("str07_same_meaning", f"WITH t AS (SELECT p_partkey, list_distinct(list_transform(list_filter({TOKENS_SQL.format('p_name')}, lambda x: len(x) > 2), lambda x: x[1:5])) AS a, list_distinct(list_transform(list_filter({TOKENS_SQL.format('p_type')}, lambda x: len(x) > 2), lambda x: x[1:5])) AS b FROM part) SELECT p_partkey, len(a) > 0 AND len(b) > 0 AND (list_has_all(b, a) OR list_has_all(a, b)) AS same FROM t")
def str07(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.same_meaning(F.col("p_name"), F.col("p_type")).alias("same"))


@query("str10_narrative", None)
def str10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.narrative(F.col("text"), ["answer:", "explanation:"]).alias("text"))


@query("str11_content_digest", """SELECT event_id, substr(sha256('{"kind":"' || event_type || '","score":"' || printf('%.2f', floor(value)) || '"}'), 1, 16) AS h FROM events""")
def str11(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", ids.content_digest({"kind": F.col("event_type")}, {"score": F.floor("value")}).alias("h"))


@query("str13_posix_path", "SELECT p_partkey, '/a/' || lower(p_brand) || '/b' AS path FROM part")
def str13(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("\\A//"), F.col("p_brand"), F.lit("\\.\\B/"))
    return read(spark, d, "part").select("p_partkey", text.posix_path(raw).alias("path"))


@query("udf01_registered_path_function", "SELECT p_partkey, '/a/' || lower(p_brand) || '/b' AS path FROM part")
def udf01(spark: SparkSession, d: str) -> DataFrame:
    """The same by the function that SQL texts can call."""
    text.register_functions(spark)
    raw = F.concat(F.lit("\\A//"), F.col("p_brand"), F.lit("\\.\\B/"))
    return read(spark, d, "part").select("p_partkey", raw.alias("raw")).selectExpr("p_partkey", "normalize_media_path(raw) as path")


@query("str16_request_fingerprint", "SELECT event_id, sha256(CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|' || event_type) AS h FROM events")
def str16(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", ids.job_hash(F.col("user_id"), F.col("event_id"), F.col("event_type")).alias("h"))


@query("str17_operation_id", "WITH g AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS m FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT user_id, 'delete-' || user_id || '-' || substr(sha256('delete|' || user_id || '|' || m), 1, 16) AS op FROM g")
def str17(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).where("event_type = 'signup'").groupBy("user_id").agg(F.collect_list("event_id").alias("m"))
    return g.select("user_id", ids.operation_id(F.lit("delete"), F.col("user_id"), F.col("m")).alias("op"))


@query("str19_int_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE event_id * 2 + 1 END AS total FROM events")
def str19(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, i).otherwise(F.concat(F.lit("["), i, F.lit(", x, "), (F.col("event_id") + 1).cast("string"), F.lit("]")))
    return events(spark, d).select("event_id", F.aggregate(text.int_list(raw), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("set07_canonical_tags", f"SELECT label, string_agg(DISTINCT w, ',' ORDER BY w) AS tags FROM (SELECT p_size % 7 AS label, unnest({TOKENS_SQL.format('p_type')}) AS w FROM part) GROUP BY label")
def set07(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select((F.col("p_size") % 7).alias("label"), F.explode(text.tokens(F.col("p_type"))).alias("w")).distinct()
    return t.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("tags"))


@query("jsn04_sorted_json", """SELECT event_id, '{"a":"' || event_type || '","b":"' || user_id || '"}' AS j FROM events""")
def jsn04(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return events(spark, d).select("event_id", text.sorted_json(m).alias("j"))


@query("jsn05_verified_receipt", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 7")
def jsn05(spark: SparkSession, d: str) -> DataFrame:
    """A cheap text filter first, the parsed value behind it."""
    return events(spark, d).where(F.contains("props", F.lit("7")) & (F.get_json_object("props", "$.k") == "7")).select("event_id")


@query("jsn07_typed_defaults", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 5) AS k, true AS enabled, 0.5E0 AS share FROM events")
def jsn07(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k int, enabled boolean, share double")
    return events(spark, d).select("event_id", F.coalesce(p["k"], F.lit(5)).alias("k"), F.coalesce(p["enabled"], F.lit(True)).alias("enabled"), F.coalesce(p["share"], F.lit(0.5)).alias("share"))
