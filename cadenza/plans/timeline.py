"""Queries over event series: the cut list, spacing, grouping, smoothing, peaks, interval and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, sequence
from ..sources.tables import EVENTS_SQL, events

HOUR = 3_600_000_000
DAY = 24 * HOUR
GAP = 4 * HOUR
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


def sections(e: DataFrame) -> DataFrame:
    """Sections of each user: from one signup to the next, the last one up to 30 days; energy is the signup's strength."""
    s = e.where("event_type = 'signup'").select("user_id", F.col("us").alias("start_us"), F.col("event_id").alias("section_id"), F.col("strength").alias("energy"))
    end = F.lead("start_us").over(Window.partitionBy("user_id").orderBy("start_us", "section_id"))
    return s.withColumn("end_us", F.coalesce(end, F.col("start_us") + 30 * DAY))


SECTIONS_SQL = f"""(SELECT user_id, us AS start_us, event_id AS section_id, strength AS energy,
  coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + {30 * DAY}) AS end_us FROM {{ev}} WHERE event_type = 'signup')"""


def weighted(e: DataFrame) -> DataFrame:
    """Triggers scaled by half plus half the energy of their section; outside of sections unchanged."""
    out = intervals.containing(e, sections(e), ["user_id"], "us", "start_us", "end_us", DAY)
    return out.withColumn("weighted", F.round(F.col("strength") * F.coalesce(0.5 + 0.5 * F.col("energy"), F.lit(1.0)), 9))


WEIGHTED_SQL = f"""(SELECT e.event_id, e.user_id, e.event_type, e.us, s.section_id,
  round(e.strength * coalesce(0.5 + 0.5 * s.energy, 1.0), 9) AS weighted
  FROM {{ev}} e LEFT JOIN {SECTIONS_SQL} s ON s.user_id = e.user_id AND e.us >= s.start_us AND e.us < s.end_us)"""

SPACED_SQL = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM w),
f AS (
  SELECT user_id, rn, us AS k_us, event_id AS k_id, weighted AS k_s, 1 AS slot FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn,
    CASE WHEN o.us - f.k_us >= {GAP} OR o.weighted > f.k_s THEN o.us ELSE f.k_us END,
    CASE WHEN o.us - f.k_us >= {GAP} OR o.weighted > f.k_s THEN o.event_id ELSE f.k_id END,
    CASE WHEN o.us - f.k_us >= {GAP} OR o.weighted > f.k_s THEN o.weighted ELSE f.k_s END,
    CASE WHEN o.us - f.k_us >= {GAP} THEN f.slot + 1 ELSE f.slot END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1
),
kept AS (SELECT user_id, slot, max_by(k_us, rn) AS us, max_by(k_id, rn) AS event_id, max_by(k_s, rn) AS weighted FROM f GROUP BY user_id, slot)
"""


@query("jon09_section_weights", f"SELECT event_id, user_id, section_id, weighted FROM {WEIGHTED_SQL}")
def section_weights(spark: SparkSession, d: str) -> DataFrame:
    return weighted(events(spark, d)).select("event_id", "user_id", "section_id", "weighted")


def spaced(e: DataFrame) -> DataFrame:
    return sequence.min_interval(weighted(e).select("user_id", "us", "event_id", "weighted"), ["user_id"], "us", "event_id", "weighted", GAP)


@query("win11_min_interval", f"WITH RECURSIVE w AS (SELECT * FROM {WEIGHTED_SQL}), {SPACED_SQL} SELECT user_id, us, event_id, weighted FROM kept")
def win11(spark: SparkSession, d: str) -> DataFrame:
    return spaced(events(spark, d))


@query(
    "flagship_cut_list",
    f"""WITH RECURSIVE w AS (SELECT * FROM {WEIGHTED_SQL}), {SPACED_SQL},
i AS (SELECT user_id, us, weighted, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS end_us FROM kept)
SELECT user_id, count(*) AS n_cuts, CAST(min(end_us - us) AS BIGINT) AS shortest_us, CAST(max(end_us - us) AS BIGINT) AS longest_us,
  round(avg(end_us - us), 3) AS mean_us, round(avg(weighted), 6) AS mean_strength FROM i WHERE end_us > us GROUP BY user_id""",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Merge events as triggers, scale by section, keep a minimum spacing, and report the intervals of each user."""
    cuts = sequence.to_intervals(spaced(events(spark, d)), ["user_id"], "us", "event_id")
    length = F.col("end_at") - F.col("us")
    return cuts.groupBy("user_id").agg(
        F.count("*").alias("n_cuts"), F.min(length).alias("shortest_us"), F.max(length).alias("longest_us"),
        F.round(F.avg(length), 3).alias("mean_us"), F.round(F.avg("weighted"), 6).alias("mean_strength"),
    )


@query(
    "win12_auto_split",
    f"""WITH i AS (SELECT event_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS e FROM {{ev}}),
n AS (SELECT *, greatest(CAST(ceil((e - us) / {12 * HOUR}.0) AS INTEGER), 1) AS n FROM i WHERE e > us),
p AS (SELECT *, unnest(range(0, n)) AS part FROM n)
SELECT event_id, CAST(part AS INTEGER) AS part, round(us + part * ((e - us) / CAST(n AS DOUBLE)), 0) AS part_start, round(us + (part + 1) * ((e - us) / CAST(n AS DOUBLE)), 0) AS part_end FROM p""",
)
def win12(spark: SparkSession, d: str) -> DataFrame:
    cuts = sequence.to_intervals(events(spark, d).select("user_id", "event_id", "us"), ["user_id"], "us", "event_id")
    out = sequence.auto_split(cuts, "us", "end_at", 12 * HOUR)
    return out.select("event_id", "part", F.round("part_start", 0).alias("part_start"), F.round("part_end", 0).alias("part_end"))


@query(
    "win13_anchored_groups",
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {{ev}}),
f AS (SELECT user_id, rn, us, us AS first_at FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, o.us, CASE WHEN o.us - f.first_at <= {6 * HOUR} THEN f.first_at ELSE o.us END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, first_at, round(avg(CAST(us AS DOUBLE)) / 1000, 0) AS mean_ms, count(*) AS n FROM f GROUP BY user_id, first_at""",
)
def win13(spark: SparkSession, d: str) -> DataFrame:
    out = sequence.anchored_groups(events(spark, d), ["user_id"], "us", "event_id", 6 * HOUR)
    return out.select("user_id", "first_at", F.round(F.col("mean_at") / 1000, 0).alias("mean_ms"), "n")


@query(
    "win15_running_mean_groups",
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {{ev}}),
f AS (SELECT user_id, rn, CAST(us AS DOUBLE) AS m, CAST(1 AS BIGINT) AS n, 1 AS g FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, CASE WHEN o.us - f.m <= {6 * HOUR} THEN f.m + (CAST(o.us AS DOUBLE) - f.m) / (f.n + 1) ELSE CAST(o.us AS DOUBLE) END,
  CASE WHEN o.us - f.m <= {6 * HOUR} THEN f.n + 1 ELSE 1 END, CASE WHEN o.us - f.m <= {6 * HOUR} THEN f.g ELSE f.g + 1 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, round(max_by(m, rn) / 1000, 0) AS mean_ms, max(n) AS n FROM f GROUP BY user_id, g""",
)
def win15(spark: SparkSession, d: str) -> DataFrame:
    out = sequence.running_mean_groups(events(spark, d), ["user_id"], "us", "event_id", float(6 * HOUR))
    return out.select("user_id", F.round(F.col("mean_at") / 1000, 0).alias("mean_ms"), "n")


CURVE_SQL = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {ev})"


def curve(spark: SparkSession, d: str) -> DataFrame:
    return sequence.indexed(events(spark, d).select("user_id", "us", "event_id", "value"), ["user_id"], "us", "event_id").drop("us")


@query("win01_moving_average", f"SELECT user_id, idx, round(sum(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM {CURVE_SQL}")
def win01(spark: SparkSession, d: str) -> DataFrame:
    return sequence.moving_average(curve(spark, d), ["user_id"], "idx", "value", 5, "s").select("user_id", "idx", F.round("s", 6).alias("smooth"))


@query(
    "win02_smooth_min_max",
    f"""WITH s AS (SELECT user_id, idx, sum(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM {CURVE_SQL}),
m AS (SELECT *, min(s) OVER (PARTITION BY user_id) AS lo, max(s) OVER (PARTITION BY user_id) AS hi FROM s)
SELECT user_id, idx, round(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END, 6) AS norm FROM m""",
)
def win02(spark: SparkSession, d: str) -> DataFrame:
    s = sequence.moving_average(curve(spark, d), ["user_id"], "idx", "value", 5, "s")
    return sequence.min_max(s, ["user_id"], "s", "n").select("user_id", "idx", F.round("n", 6).alias("norm"))


@query(
    "win03_local_maxima",
    f"""WITH m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM {CURVE_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, idx, value FROM m WHERE value > a AND value > b AND value >= 70""",
)
def win03(spark: SparkSession, d: str) -> DataFrame:
    return sequence.local_maxima(curve(spark, d), ["user_id"], "idx", "value", 70.0).select("user_id", "idx", "value")


@query(
    "win05_phase_runs",
    f"""WITH p AS (SELECT user_id, idx, CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'mid' ELSE 'high' END AS phase FROM {CURVE_SQL}),
c AS (SELECT *, CASE WHEN phase <> lag(phase) OVER (PARTITION BY user_id ORDER BY idx) THEN 1 ELSE 0 END AS c FROM p),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM c)
SELECT user_id, phase, min(idx) AS first, max(idx) AS last, count(*) AS n FROM r GROUP BY user_id, run, phase""",
)
def win05(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("value") < 50, "low").when(F.col("value") < 150, "mid").otherwise("high")
    return sequence.runs(curve(spark, d).withColumn("phase", phase), ["user_id"], "idx", "phase").select("user_id", "phase", "first", "last", "n")


@query(
    "win06_trend",
    f"""WITH m AS (SELECT user_id, idx, value, avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS past,
  avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS future FROM {CURVE_SQL})
SELECT user_id, idx, round(past, 6) AS past, round(future, 6) AS future, CASE WHEN future > past * 1.2 THEN 'rising' WHEN future < past * 0.8 THEN 'falling' ELSE 'steady' END AS trend FROM m""",
)
def win06(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("idx")
    c = curve(spark, d).withColumn("p", F.avg("value").over(w.rowsBetween(-4, -1))).withColumn("f", F.avg("value").over(w.rowsBetween(1, 4)))
    trend = F.when(F.col("f") > F.col("p") * 1.2, "rising").when(F.col("f") < F.col("p") * 0.8, "falling").otherwise("steady")
    return c.select("user_id", "idx", F.round("p", 6).alias("past"), F.round("f", 6).alias("future"), trend.alias("trend"))


@query(
    "win07_transition_clusters",
    f"""WITH RECURSIVE st AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM {{ev}} GROUP BY user_id),
c AS (SELECT e.user_id, e.us, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.us, e.event_id) AS rn FROM {{ev}} e JOIN st USING (user_id) WHERE e.value > m + 0.5 * s),
f AS (SELECT user_id, rn, us, us AS first_at FROM c WHERE rn = 1
  UNION ALL SELECT c.user_id, c.rn, c.us, CASE WHEN c.us - f.first_at <= {DAY} THEN f.first_at ELSE c.us END FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT user_id, first_at, count(*) AS n FROM f GROUP BY user_id, first_at HAVING count(*) >= 2""",
)
def win07(spark: SparkSession, d: str) -> DataFrame:
    """Values over mean + half a deviation, clustered within a day of the cluster's first; single ones go."""
    w = Window.partitionBy("user_id")
    e = events(spark, d).withColumn("m", F.avg("value").over(w)).withColumn("s", F.stddev_pop("value").over(w))
    out = sequence.anchored_groups(e.where(F.col("value") > F.col("m") + 0.5 * F.col("s")), ["user_id"], "us", "event_id", DAY)
    return out.where("n >= 2").select("user_id", "first_at", "n")


@query(
    "win14_energy_islands",
    f"""WITH m AS (SELECT user_id, idx, value / max(value) OVER (PARTITION BY user_id) AS v FROM {CURVE_SQL}), h AS (SELECT * FROM m WHERE v > 0.7),
c AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) > 5 THEN 1 ELSE 0 END AS c FROM h),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY idx) AS g FROM c)
SELECT user_id, CAST(max_by(idx, v * 1000000 - idx / 1000000.0) AS BIGINT) AS idx, round(max(v), 9) AS peak, count(*) AS n FROM g GROUP BY user_id, g""",
)
def win14(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).withColumn("v", F.col("value") / F.max("value").over(Window.partitionBy("user_id")))
    return sequence.islands(c, ["user_id"], "idx", "v", 0.7, 5).select("user_id", "idx", F.round("peak", 9).alias("peak"), "n")


@query(
    "win08_suppression",
    f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, us, event_id, strength, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, us, event_id) AS rn FROM {{ev}}),
k AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT o.user_id, o.rn, CASE WHEN len(list_filter(kept, lambda x: abs(x - o.us) < {DAY})) = 0 THEN list_append(kept, o.us) ELSE kept END FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1)
SELECT o.user_id, us, event_id, strength FROM o JOIN k ON k.user_id = o.user_id AND k.rn = o.rn JOIN k b ON b.user_id = o.user_id AND b.rn = o.rn - 1 WHERE len(k.kept) > len(b.kept)""",
)
def win08(spark: SparkSession, d: str) -> DataFrame:
    """Strongest events of each user that are a day apart, by greedy suppression."""
    return sequence.suppress(events(spark, d), ["user_id"], "us", "event_id", "strength", DAY)


@query("win17_top_peaks", f"""WITH m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM {CURVE_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
p AS (SELECT user_id, idx, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, idx) AS rk FROM m WHERE value >= a AND value > b)
SELECT user_id, idx, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY idx) AS BIGINT) AS position FROM p WHERE rk <= 10""")
def win17(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("idx")
    m = curve(spark, d).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w)).where("value >= a AND value > b")
    top = m.withColumn("rk", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "idx"))).where("rk <= 10")
    return top.select("user_id", "idx", "value", F.row_number().over(w).cast("long").alias("position"))


@query("win25_round_robin", """WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn, max(value) OVER (PARTITION BY event_type) AS mx FROM events)
SELECT event_id, event_type, row_number() OVER (ORDER BY rn, mx DESC, event_type) AS pick FROM r ORDER BY rn, mx DESC, event_type LIMIT 200""")
def win25(spark: SparkSession, d: str) -> DataFrame:
    return sequence.round_robin(events(spark, d), "event_type", "value", "event_id", 200).select("event_id", "event_type", "pick")


@query("win28_evict_oldest", """WITH s AS (SELECT event_id, event_type, value, sum(value) OVER (PARTITION BY event_type) - coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM {ev})
SELECT event_id FROM s WHERE l > 100000""")
def win28(spark: SparkSession, d: str) -> DataFrame:
    return sequence.evict_oldest(events(spark, d), ["event_type"], "value", ["us", "event_id"], 100000.0).select("event_id")


@query("win29_chapters", f"""WITH c AS (SELECT user_id, us, CAST(floor(idx / 32) AS BIGINT) AS chapter FROM (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {{ev}}))
SELECT user_id, chapter, min(us) AS start_us, lead(min(us)) OVER (PARTITION BY user_id ORDER BY chapter) AS end_us, count(*) AS n FROM c GROUP BY user_id, chapter""")
def win29(spark: SparkSession, d: str) -> DataFrame:
    c = sequence.indexed(events(spark, d), ["user_id"], "us", "event_id").withColumn("chapter", F.floor(F.col("idx") / 32))
    g = c.groupBy("user_id", "chapter").agg(F.min("us").alias("start_us"), F.count("*").alias("n"))
    return g.withColumn("end_us", F.lead("start_us").over(Window.partitionBy("user_id").orderBy("chapter")))


@query("win23_to_intervals", """WITH i AS (SELECT event_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS e FROM {ev}) SELECT event_id, us, e AS end_at FROM i WHERE e > us""")
def win23(spark: SparkSession, d: str) -> DataFrame:
    return sequence.to_intervals(events(spark, d).select("user_id", "event_id", "us"), ["user_id"], "us", "event_id").select("event_id", "us", "end_at")


def _anchors(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'purchase'").groupBy("user_id", F.col("us").alias("anchor_us")).agg(F.max("value").alias("anchor_value"))


ANCHORS_SQL = "(SELECT user_id, us AS anchor_us, max(value) AS anchor_value FROM {ev} WHERE event_type = 'purchase' GROUP BY user_id, us)"


@query("jon15_as_of_forward", f"SELECT e.event_id, a.anchor_us, a.anchor_value FROM {{ev}} e ASOF LEFT JOIN {ANCHORS_SQL} a ON e.user_id = a.user_id AND e.us <= a.anchor_us")
def jon15(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = intervals.as_of(e.select("event_id", "user_id", "us"), _anchors(e), ["user_id"], "us", "anchor_us", ["anchor_value"], "forward")
    return out.select("event_id", "anchor_us", "anchor_value")


@query("jon14_as_of_backward", f"SELECT e.event_id, a.anchor_us, a.anchor_value FROM {{ev}} e ASOF LEFT JOIN {ANCHORS_SQL} a ON e.user_id = a.user_id AND e.us >= a.anchor_us")
def jon14(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = intervals.as_of(e.select("event_id", "user_id", "us"), _anchors(e), ["user_id"], "us", "anchor_us", ["anchor_value"])
    return out.select("event_id", "anchor_us", "anchor_value")


@query("jon22_nearest", f"""WITH p AS (SELECT e.event_id, a.anchor_us, abs(e.us - a.anchor_us) AS distance, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.us - a.anchor_us), a.anchor_us DESC) AS rn
  FROM {{ev}} e JOIN {ANCHORS_SQL} a ON a.user_id = e.user_id)
SELECT e.event_id, p.anchor_us, p.distance FROM {{ev}} e LEFT JOIN p ON p.event_id = e.event_id AND p.rn = 1""")
def jon22(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return intervals.nearest(e.select("event_id", "user_id", "us"), _anchors(e), ["user_id"], "us", "anchor_us", later_wins=True).select("event_id", "anchor_us", "distance")


@query("jon28_band_max", f"""SELECT a.user_id, a.anchor_us, max(e.value) AS strongest FROM {ANCHORS_SQL} a JOIN {{ev}} e ON e.user_id = a.user_id AND abs(e.us - a.anchor_us) <= {6 * HOUR} GROUP BY a.user_id, a.anchor_us""")
def jon28(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = _anchors(e).select("user_id", "anchor_us")
    return intervals.band(a, e.select("user_id", "us", "value"), ["user_id"], "anchor_us", "us", 6 * HOUR, F.max("value").alias("strongest"))


@query("jon26_two_way_agreement", f"""WITH k AS (SELECT user_id, us FROM {{ev}} WHERE event_type = 'click'), a AS (SELECT user_id, anchor_us FROM {ANCHORS_SQL}),
r AS (SELECT k.user_id, k.us, min(abs(k.us - a.anchor_us)) <= {6 * HOUR} AS hit FROM k JOIN a USING (user_id) GROUP BY k.user_id, k.us),
p AS (SELECT a.user_id, a.anchor_us, min(abs(k.us - a.anchor_us)) <= {6 * HOUR} AS hit FROM a JOIN k USING (user_id) GROUP BY a.user_id, a.anchor_us)
SELECT user_id, round(recall, 6) AS recall, round(precision_, 6) AS precision FROM (SELECT user_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS recall FROM r GROUP BY user_id)
JOIN (SELECT user_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS precision_ FROM p GROUP BY user_id) USING (user_id)""")
def jon26(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    kicks = e.where("event_type = 'click'").select("user_id", "us").distinct()
    grid = _anchors(e).select("user_id", "anchor_us")
    hit = F.avg(F.when(F.col("distance") <= 6 * HOUR, 1.0).otherwise(0.0))
    recall = intervals.nearest(kicks, grid, ["user_id"], "us", "anchor_us").where("distance is not null").groupBy("user_id").agg(F.round(hit, 6).alias("recall"))
    precision = intervals.nearest(grid, kicks, ["user_id"], "anchor_us", "us").where("distance is not null").groupBy("user_id").agg(F.round(hit, 6).alias("precision"))
    return recall.join(precision, "user_id")
