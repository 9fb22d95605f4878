"""Scans, joins and set operations as SQL that both engines run, and series, group and score operators beside DuckDB's SQL for them.

The operators are functions of operators/ and functions/; their SQL here is the oracle alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import curves, selection, statistics
from ..sources.tables import EVENTS_SQL, events, read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings", "documents", "conversations")

#: Name: SQL. {ev} are events with us and strength; other tables by name in braces.
SQL = {
    "src01_point_scan": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey = 7",
    "src02_filter_scan": "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_nationkey = 3",
    "src03_first_by_hash": "SELECT min(p_partkey) AS p_partkey, p_brand FROM {part} GROUP BY p_brand",
    "src05_status_scan": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus IN ('O', 'P')",
    "src06_composite_key_scan": "SELECT e.event_id FROM {ev} e WHERE e.event_type = 'click' AND e.user_id = 11 AND EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = e.user_id)",
    "src24_exists_probe": "SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS has_orders FROM {customer} c",
    "src25_exists_probe_video": "SELECT p_partkey, EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 25) AS has_units FROM {part} p",
    "prj03_confidence_case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0E0 WHEN 'P' THEN 0.5E0 ELSE 0.0E0 END AS confidence FROM {orders}",
    "prj10_position_bucket": "SELECT event_id, CASE WHEN strength < 0.25 THEN 'start' WHEN strength >= 0.75 THEN 'end' ELSE 'middle' END AS pos FROM {ev}",
    "prj11_tertiles": "SELECT e.event_id, CASE WHEN e.value < t.a THEN 'low' WHEN e.value < t.b THEN 'medium' ELSE 'high' END AS bucket FROM {ev} e JOIN (SELECT user_id, quantile_cont(value, 0.33) AS a, quantile_cont(value, 0.66) AS b FROM {ev} GROUP BY user_id) t ON t.user_id = e.user_id",
    "prj15_motion_norm": "SELECT event_id, round(least(value / 30, 1.0), 6) AS motion FROM {ev}",
    "prj18_tolerance_band": "SELECT event_id, value FROM {ev} WHERE abs(value - 100) <= 5",
    "prj22_key_compatibility": "SELECT e.event_id, coalesce(k.score, 0.5E0) AS score FROM {ev} e LEFT JOIN (SELECT 'click' AS a, 1.0E0 AS score UNION ALL SELECT 'view', 0.7E0 UNION ALL SELECT 'error', 0.3E0) k ON k.a = e.event_type",
    "prj23_transition_kind": "SELECT event_id, CASE WHEN strength > 0.8 AND event_type = 'click' THEN 'hard_cut' WHEN strength < 0.3 THEN 'fade' ELSE 'crossfade' END AS kind FROM {ev}",
    "prj24_confidence_score": "SELECT event_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN event_type = 'click' THEN 0.3 ELSE 0.0 END + 0.2 * (1 - abs(strength - 0.5) / 0.5))), 6) AS confidence FROM {ev}",
    "prj32_motion_class": "SELECT event_id, CASE WHEN value < 2 THEN 'static' WHEN value < 8 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END AS motion FROM {ev}",
    "prj36_degradation_counts": "SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN strength >= 1 THEN 1 END) AS capped FROM {ev} GROUP BY user_id",
    "prj37_page": "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey LIMIT 20 OFFSET 40",
    "jon01_equi_join": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000",
    "jon02_star_join": "SELECT n.n_name, o.o_orderpriority, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name, o.o_orderpriority",
    "jon03_reason_join": "SELECT c.c_custkey, CASE WHEN o.n IS NULL THEN 'no_orders' WHEN o.n < 5 THEN 'few' END AS reason FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
    "jon06_semi_join": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')",
    "jon08_anti_join": "SELECT p_partkey FROM {part} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)",
    "agg01_total": "SELECT coalesce(sum(value), 0) AS total FROM (SELECT round(sum(value), 4) AS value FROM {ev})",
    "agg02_clicks": "SELECT CAST(round(sum(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END) / 5.0E0) AS BIGINT) AS clicks FROM {ev}",
    "agg04_duplicate_groups": "SELECT user_id, event_type, count(*) AS n FROM {ev} GROUP BY user_id, event_type HAVING count(*) > 15",
    "agg12_statistics": "SELECT event_type, count(*) AS n, count(CASE WHEN strength >= 1 THEN 1 END) AS strong, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM {ev} GROUP BY event_type",
    "agg16_plausible_median": "SELECT user_id, coalesce(median(CASE WHEN value > 30 AND value < 300 THEN value END), 0) AS bpm FROM {ev} GROUP BY user_id",
    "agg18_max_normalised": "SELECT event_id, round(CASE WHEN max(value) OVER (PARTITION BY user_id) > 0 THEN value / max(value) OVER (PARTITION BY user_id) ELSE value END, 6) AS v FROM {ev}",
    "agg19_population_variance": "SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM {ev} GROUP BY event_type",
    "agg22_tumbling_means": "SELECT user_id, CAST(floor(us / 86400000000.0E0) AS BIGINT) AS day, round(avg(value), 6) AS mean FROM {ev} GROUP BY user_id, CAST(floor(us / 86400000000.0E0) AS BIGINT)",
    "agg23_weighted_mean": "SELECT l_partkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS price FROM {lineitem} GROUP BY l_partkey",
    "agg25_motion_statistics": "SELECT user_id, round(avg(value), 6) AS mean, max(value) AS peak, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.95), 6) AS p95, round(100.0E0 * count(CASE WHEN value > 100 THEN 1 END) / count(*), 6) AS coverage FROM {ev} GROUP BY user_id",
    "agg29_split_means": "SELECT user_id, CAST(b AS BIGINT) AS bucket, round(avg(value), 6) AS mean FROM (SELECT user_id, value, ntile(20) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b FROM {ev}) t GROUP BY user_id, b",
    "agg30_energy_share": "SELECT event_type, round(s / sum(s) OVER (), 9) AS share FROM (SELECT event_type, avg(value * value) AS s FROM {ev} GROUP BY event_type) t",
    "agg33_p95_scale": "SELECT event_type, CASE WHEN quantile_cont(value, 0.95) <= 0.000001 THEN 1 ELSE round(quantile_cont(value, 0.95), 6) END AS scale FROM {ev} WHERE value > 0 GROUP BY event_type",
    "agg35_longest_wins": "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best, round(max(o_totalprice), 2) AS price FROM {orders} GROUP BY o_custkey",
    "agg40_fixed_histogram": "SELECT event_type, CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 WHEN value <= 500 THEN 500 ELSE 1000 END AS bucket, count(*) AS n FROM {ev} GROUP BY 1, 2",
    "agg41_conditional_ratio": "SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN 1.0E0 ELSE 0.0E0 END), 6) AS ratio FROM {ev} GROUP BY user_id",
    "agg43_argmax_category": "SELECT user_id, max_by(event_type, (n, event_type)) AS mood FROM (SELECT user_id, event_type, count(*) AS n FROM {ev} GROUP BY user_id, event_type) t GROUP BY user_id",
    "agg44_status_precedence": "SELECT o_custkey, CASE WHEN count(*) = 0 THEN 'unavailable' WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN 'partial' WHEN max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1 THEN 'open' ELSE 'completed' END AS status FROM {orders} GROUP BY o_custkey",
    "agg46_contrast": "SELECT user_id, round(max(m) / avg(m), 6) AS ratio, max_by(phase, m) AS phase FROM (SELECT user_id, CAST(floor(us / 3600000000.0E0) AS BIGINT) % 24 AS phase, avg(value) AS m FROM {ev} GROUP BY user_id, CAST(floor(us / 3600000000.0E0) AS BIGINT) % 24) t GROUP BY user_id",
    "win16_sliding_max_peaks": "SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM {ev}) t WHERE value = m AND value > 0",
    "win24_segments": "SELECT event_id, coalesce(lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS start_us, us AS end_us FROM {ev}",
    "win27_retention": "SELECT event_id FROM (SELECT event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM {ev}) t WHERE (SELECT max(us) FROM {ev}) - us > 2160000000000 OR rn > 40",
    "win33_right_minus_left": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 0 FOLLOWING AND 7 FOLLOWING) - avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS contrast FROM {ev}",
    "win34_abs_change": "SELECT event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id)) AS change FROM {ev}",
    "win36_summed_change": "SELECT user_id, round(sum(c), 4) AS change FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id)) AS c FROM {ev}) t GROUP BY user_id",
    "win37_weighted_fusion": "SELECT event_id, round(0.6 * value / max(value) OVER (PARTITION BY user_id) + 0.4 * strength / max(strength) OVER (PARTITION BY user_id), 6) AS fused FROM {ev}",
    "win39_break_means": "SELECT event_id, CASE WHEN value > 1.5 * avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) THEN 'drop' WHEN value < 0.5 * avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) THEN 'break' ELSE 'none' END AS kind FROM {ev}",
    "win46_cyclic_index": "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) % 7 AS clip FROM {ev}",
    "win48_drop_oldest": "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {ev}) t WHERE rn > floor(n / 4)",
    "top06_near_tie": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value >= m - 0.05 * m AND event_type = 'purchase' THEN 0 ELSE 1 END, value DESC, event_id) AS rn FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM {ev}) a) t WHERE rn = 1",
    "top08_signed_factor": "SELECT event_type, max_by(event_id, s) AS best FROM (SELECT event_type, event_id, CASE WHEN value - 200 >= 0 THEN (value - 200) * (1 + event_id / 1.0E9) ELSE (value - 200) / (1 + event_id / 1.0E9) END AS s FROM {ev}) t GROUP BY event_type",
    "top11_top_by_variance": "SELECT user_id, round(var_pop(value), 4) AS variance FROM {ev} GROUP BY user_id ORDER BY var_pop(value) DESC, user_id LIMIT 10",
    "top13_top_bins": "SELECT event_type, bin, n FROM (SELECT event_type, bin, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) AS rk FROM (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM {ev} GROUP BY event_type, CAST(floor(value / 10) AS BIGINT)) a) t WHERE rk <= 3",
    "top16_priority_order": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS turn FROM {orders}",
    "set01_union": "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O' UNION SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P'",
    "set02_intersect_except": "(SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM {customer}) EXCEPT SELECT c_custkey FROM {customer} WHERE c_nationkey = 1",
    "set03_union_all": "SELECT event_id, 'base' AS origin FROM {ev} WHERE event_type = 'click' UNION ALL SELECT event_id, 'gap' FROM {ev} WHERE value > 300",
    "set05_distinct_ends": "SELECT DISTINCT l_shipdate FROM {lineitem} WHERE l_quantity > 0",
    "set06_unlearned": "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT DISTINCT c_nationkey FROM {customer} WHERE c_acctbal > 9990)",
    "set08_distinct_folded": "SELECT DISTINCT lower(p_brand) AS brand FROM {part}",
    "stm03_window_floor": "SELECT w, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, CAST(floor(us / 90000000000.0E0) AS BIGINT) AS w FROM {ev}) t GROUP BY w",
    "stm09_suffix_scan": "SELECT event_id, event_type FROM {ev} WHERE event_id > 9000 AND event_type IN ('click', 'view')",
    "stm10_typed_gap": "SELECT event_type, max(event_id) > 4000 AS gap FROM {ev} WHERE event_id <= 5000 GROUP BY event_type",
    "stm12_keep_last": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM {ev}) t WHERE rn <= 20",
    "stm16_incomplete_order": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM {orders} WHERE o_orderstatus <> 'F'",
    "stm17_latest_wins": "SELECT user_id, event_type AS state FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM {ev}) t WHERE rn = 1",
    "str14_content_hash": "SELECT p_partkey, sha256(lower(p_name) || '|' || p_brand) AS h FROM {part}",
    "str18_redaction": "SELECT conv_id, turn, CASE WHEN text LIKE '%@%' THEN '[REDACTED]' ELSE text END AS text FROM {conversations}",
    "jsn06_json_score": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), strength) AS score FROM {ev}",
}


#: Queries that Spark runs as this very SQL: scans, joins, set operations and one filter of a journal.
PLAIN = [n for n in SQL if n.split("_")[0][:3] in ("src", "jon", "set")] + ["prj37_page", "stm09_suffix_scan"]


def _duck_sql(sql: str) -> str:
    return sql.format(ev=EVENTS_SQL, **{t: t for t in TABLES})


def _runner(sql: str):
    names = set(re.findall(r"\{(\w+)\}", sql))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(sql, **{n: events(spark, d) if n == "ev" else read(spark, d, n) for n in names})

    return run


ORDER = ["us", "event_id"]
USER = ["user_id"]
TYPE = ["event_type"]
DAY = 86_400_000_000


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _rounded(df: DataFrame, digits: int = 6, **columns: int) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[_r(c, columns.get(c, digits)) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Name: a function of the events.
OVER_EVENTS = {
    "prj10_position_bucket": lambda e: e.select("event_id", scoring.bucket(F.col("strength"), [0.25, 0.75], ["start", "middle", "end"]).alias("pos")),
    "prj11_tertiles": lambda e: statistics.tertiles(e, USER, "value", ("low", "medium", "high"), "bucket").select("event_id", "bucket"),
    "prj15_motion_norm": lambda e: _rounded(e.select("event_id", scoring.share_of_full(F.col("value"), 30).alias("motion"))),
    "prj18_tolerance_band": lambda e: e.where(F.abs(F.col("value") - 100) <= 5).select("event_id", "value"),
    "prj22_key_compatibility": lambda e: e.select("event_id", scoring.confidence_of(F.col("event_type"), {"click": 1.0, "view": 0.7, "error": 0.3}, 0.5).alias("score")),
    "prj23_transition_kind": lambda e: e.select("event_id", scoring.transition_kind(F.col("strength"), F.col("event_type") == "click").alias("kind")),
    "prj24_confidence_score": lambda e: _rounded(e.select("event_id", scoring.cut_confidence(F.col("event_type") == "click", F.col("strength"), 0.5).alias("confidence"))),
    "prj32_motion_class": lambda e: e.select("event_id", scoring.bucket(F.col("value"), [2.0, 8.0, 20.0], ["static", "low", "medium", "high"]).alias("motion")),
    "prj36_degradation_counts": lambda e: e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("strength") >= 1).alias("capped")),
    "agg01_total": lambda e: statistics.total(e, "value", "total", 4),
    "agg02_clicks": lambda e: statistics.rounded_count(e, F.col("event_type").isin("purchase", "click"), 5.0, "clicks"),
    "agg04_duplicate_groups": lambda e: statistics.duplicate_groups(e, ["user_id", "event_type"], 15),
    "agg12_statistics": lambda e: statistics.summary(e, TYPE, "value", F.col("strength") >= 1, "strong").withColumn("mean", F.round("mean", 6)),
    "agg16_plausible_median": lambda e: statistics.plausible_median(e, USER, "value", 30, 300, "bpm"),
    "agg18_max_normalised": lambda e: _rounded(curves.scaled_by_max(e, USER, "value", "v").select("event_id", "v")),
    "agg19_population_variance": lambda e: _rounded(statistics.mean_and_variance(e, TYPE, "value"), variance=4),
    "agg22_tumbling_means": lambda e: _rounded(statistics.tumbling_means(e, USER, "us", DAY, "value", "day")),
    "agg25_motion_statistics": lambda e: statistics.motion_statistics(e, USER, "value", 100).select("user_id", "peak", *map(_r, ("mean", "deviation", "p95", "coverage"))),
    "agg29_split_means": lambda e: _rounded(curves.split_means(e, USER, ORDER, "value", 20)),
    "agg30_energy_share": lambda e: _rounded(statistics.energy_shares(e, "event_type", "value"), 9),
    "agg33_p95_scale": lambda e: _rounded(statistics.percentile_scale(e, TYPE, "value")),
    "agg40_fixed_histogram": lambda e: statistics.fixed_histogram(e, TYPE, "value", [10, 50, 100, 500], 1000),
    "agg41_conditional_ratio": lambda e: _rounded(statistics.ratio(e, USER, F.col("event_type") == "click", "ratio")),
    "agg43_argmax_category": lambda e: statistics.most_common(e, USER, "event_type", "mood"),
    "agg46_contrast": lambda e: _rounded(statistics.phase_contrast(e, USER, "us", DAY // 24, 24, "value")),
    "win16_sliding_max_peaks": lambda e: curves.sliding_peaks(e, USER, ORDER, "value", 3).select("event_id"),
    "win24_segments": lambda e: curves.segments(e, USER, ORDER, "us", "start_us", "end_us", F.lit(0).cast("long")).select("event_id", "start_us", "end_us"),
    "win33_right_minus_left": lambda e: _rounded(curves.side_contrast(e, USER, ORDER, "value", 8, "contrast").select("event_id", "contrast")),
    "win34_abs_change": lambda e: curves.change(e, USER, ORDER, "value", "change").select("event_id", "change"),
    "win36_summed_change": lambda e: _rounded(curves.summed_change(e, USER, "event_type", ORDER, "value", "change"), 4),
    "win37_weighted_fusion": lambda e: _rounded(curves.fused(e, USER, {"value": 0.6, "strength": 0.4}, "fused").select("event_id", "fused")),
    "win39_break_means": lambda e: curves.against_past(e, USER, ORDER, "value", 4, 1.5, 0.5, "kind").select("event_id", "kind"),
    "win46_cyclic_index": lambda e: curves.cyclic(e, USER, ORDER, 7, "clip").select("event_id", "clip"),
    "win48_drop_oldest": lambda e: curves.without_oldest(e, TYPE, ORDER, 0.25).select("event_id"),
    "top11_top_by_variance": lambda e: _rounded(statistics.top_by_variance(e, "user_id", "value", 10), 4),
    "top13_top_bins": lambda e: statistics.top_bins(e, TYPE, "value", 10, 3),
    "stm03_window_floor": lambda e: _rounded(statistics.tumbling_totals(e, "us", 90_000_000_000, "value", "w"), 4),
    "stm10_typed_gap": lambda e: statistics.typed_gap(e, "event_type", "event_id", 5000, 4000),
    "stm12_keep_last": lambda e: curves.latest(e, USER, ORDER, 20).select("event_id", "user_id"),
    "stm17_latest_wins": lambda e: curves.latest(e, USER, ORDER).select("user_id", F.col("event_type").alias("state")),
    "jsn06_json_score": lambda e: e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.col("strength")).alias("score")),
}


def _win27(e: DataFrame) -> DataFrame:
    newest = e.agg((F.max("us") - 25 * DAY).alias("_oldest"))
    return curves.beyond_retention(e.crossJoin(F.broadcast(newest)), USER, ORDER, "us", F.col("_oldest"), 40).select("event_id")  # one row


def _top06(e: DataFrame) -> DataFrame:
    """Within a twentieth of the user's best value a purchase is preferred."""
    best = F.max("value").over(Window.partitionBy("user_id"))
    rows = e.withColumn("themed", ((F.col("value") >= best - 0.05 * best) & (F.col("event_type") == "purchase")).cast("int"))
    return selection.near_tie(rows.withColumn("inf", F.lit(0.0)), USER, "inf", "themed", "event_id", 0.0, then="value").select("user_id", "event_id")


def _top08(e: DataFrame) -> DataFrame:
    s = e.withColumn("s", scoring.signed_factor(F.col("value") - 200, F.col("event_id") / 1e9))
    return statistics.winner(s, TYPE, "event_id", "s").select("event_type", "best")


OVER_EVENTS |= {"win27_retention": _win27, "top06_near_tie": _top06, "top08_signed_factor": _top08}

#: Name: (table, function of it).
OVER_TABLE = {
    "prj03_confidence_case": ("orders", lambda o: o.select("o_orderkey", scoring.confidence_of(F.col("o_orderstatus"), {"F": 1.0, "P": 0.5}).alias("confidence"))),
    "agg23_weighted_mean": ("lineitem", lambda li: _rounded(statistics.weighted_mean(li, ["l_partkey"], "l_extendedprice", "l_quantity", "price"), 4)),
    "agg35_longest_wins": ("orders", lambda o: statistics.winner(o, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "best", F.round("o_totalprice", 2).alias("price"))),
    "agg44_status_precedence": ("orders", lambda o: statistics.precedence(o, ["o_custkey"], "o_orderstatus", [("P", "partial"), ("O", "open")], "completed", "status")),
    "top16_priority_order": ("orders", lambda o: curves.turns(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"], "turn").select("o_orderkey", "turn")),
    "stm16_incomplete_order": ("orders", lambda o: curves.turns(o.where("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "turn").select("o_orderkey", "turn")),
    "str14_content_hash": ("part", lambda p: p.select("p_partkey", F.sha2(F.concat_ws("|", F.lower("p_name"), "p_brand"), 256).alias("h"))),
    "str18_redaction": ("conversations", lambda c: c.select("conv_id", "turn", F.when(F.contains("text", F.lit("@")), "[REDACTED]").otherwise(F.col("text")).alias("text"))),
}

QUERIES = {name: _runner(SQL[name]) for name in PLAIN}
QUERIES |= {name: (lambda f: lambda spark, d: f(events(spark, d)))(f) for name, f in OVER_EVENTS.items()}
QUERIES |= {name: (lambda t, f: lambda spark, d: f(read(spark, d, t)))(t, f) for name, (t, f) in OVER_TABLE.items()}
ORACLES = {name: _duck_sql(sql) for name, sql in SQL.items()}
