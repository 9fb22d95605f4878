"""Queries over blocks of series, cut planners and timeline repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, planners, sequence
from ..sources.tables import EVENTS_SQL, events, read

HOUR = 3_600_000_000
QUERIES: dict = {}
ORACLES: dict = {}
CURVE_SQL = "(SELECT user_id, event_id, us, event_type, value, strength, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM {ev})"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{curve}", CURVE_SQL).replace("{ev}", EVENTS_SQL)
        return f

    return add


def curve(spark: SparkSession, d: str) -> DataFrame:
    return sequence.indexed(events(spark, d), ["user_id"], "us", "event_id")


def mean6(c="value"):
    return F.round(F.avg(c), 6)


@query("agg17_block_means", "SELECT user_id, CAST(floor(idx / 4) AS BIGINT) AS block, round(avg(value), 6) AS mean FROM {curve} WHERE idx < n - n % 4 GROUP BY 1, 2")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    return blocks.by_size(curve(spark, d), "idx", 4, ["user_id"], keep_tail=False).groupBy("user_id", "block").agg(mean6().alias("mean"))


@query("agg38_ceil_bins", "SELECT user_id, CAST(floor(idx / 7) AS BIGINT) AS block, round(avg(value), 6) AS mean FROM {curve} GROUP BY 1, 2")
def agg38(spark: SparkSession, d: str) -> DataFrame:
    return blocks.by_size(curve(spark, d), "idx", 7, ["user_id"]).groupBy("user_id", "block").agg(mean6().alias("mean"))


@query("agg20_bucket_peaks", "SELECT user_id, CAST(floor(idx / (n // 8)) AS BIGINT) AS block, max(abs(value - 100)) AS peak FROM {curve} WHERE n >= 8 AND idx < 8 * (n // 8) GROUP BY 1, 2")
def agg20(spark: SparkSession, d: str) -> DataFrame:
    return blocks.by_count(curve(spark, d), "idx", 8, ["user_id"]).groupBy("user_id", "block").agg(F.max(F.abs(F.col("value") - 100)).alias("peak"))


@query(
    "agg24_representative_points",
    "WITH e AS (SELECT user_id, n, b, (b * least(n, 12)) AS x FROM (SELECT DISTINCT user_id, n, unnest(range(0, least(n, 12))) AS b FROM {curve})) SELECT c.user_id, CAST(e.b AS BIGINT) AS block, count(*) AS n, round(avg(value), 6) AS mean FROM e JOIN {curve} c ON c.user_id = e.user_id AND c.idx >= (e.b * e.n) // least(e.n, 12) AND c.idx < ((e.b + 1) * e.n) // least(e.n, 12) GROUP BY 1, 2",
)
def agg24(spark: SparkSession, d: str) -> DataFrame:
    return blocks.by_edges(curve(spark, d), "idx", 12, ["user_id"]).groupBy("user_id", "block").agg(F.count("*").alias("n"), mean6().alias("mean"))


@query(
    "agg26_stride_motion",
    "WITH p AS (SELECT user_id, abs(lead(value) OVER (PARTITION BY user_id ORDER BY idx) - value) AS change FROM {curve} WHERE idx % 3 = 0) SELECT user_id, count(*) AS n, round(avg(change), 6) AS mean, max(change) AS peak FROM p WHERE change IS NOT NULL GROUP BY user_id",
)
def agg26(spark: SparkSession, d: str) -> DataFrame:
    p = blocks.stride_pairs(curve(spark, d), ["user_id"], "idx", "value", 3)
    return p.groupBy("user_id").agg(F.count("*").alias("n"), mean6("change").alias("mean"), F.max("change").alias("peak"))


@query(
    "agg27_palette",
    """WITH c AS (SELECT p_brand, p_size AS w, substr(sha256(p_name), 1, 6) AS h FROM part), v AS (SELECT p_brand, w, CAST('0x' || substr(h, 1, 2) AS INTEGER) AS r, CAST('0x' || substr(h, 3, 2) AS INTEGER) AS g, CAST('0x' || substr(h, 5, 2) AS INTEGER) AS b FROM c)
SELECT p_brand, round(sum(w * CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) ELSE 0 END) / sum(w), 6) AS saturation, round(sum(w * greatest(r, g, b) / 255.0E0) / sum(w), 6) AS brightness, round(sum(w * (r - b) / 255.0E0) / sum(w), 6) AS warmth FROM v GROUP BY p_brand""",
)
def agg27(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_brand", F.col("p_size").alias("w"), blocks.hsv(F.substring(F.sha2("p_name", 256), 1, 6)).alias("c")).where("c is not null")
    return p.groupBy("p_brand").agg(*[F.round(F.sum(F.col("w") * F.col("c")[x]) / F.sum("w"), 6).alias(x) for x in ("saturation", "brightness", "warmth")])


def _key_sql() -> str:
    rows = []
    for i, note in enumerate(blocks.NOTES):
        for mode, profile, prior in (("major", blocks.MAJOR, 0.0), ("minor", blocks.MINOR, blocks.MINOR_PRIOR)):
            rows += [f"({len(rows) // 12}, '{note} {mode}', {prior}, {j}, {profile[(j - i) % 12]})" for j in range(12)]
    return f"""WITH p(t, key, prior, j, y) AS (VALUES {", ".join(rows)}),
x AS (SELECT vec_id, unnest(range(0, 12)) AS j, unnest(CAST(embedding[1:12] AS DOUBLE[])) AS x FROM embeddings),
r AS (SELECT vec_id, t, key, corr(abs(x), CAST(y AS DOUBLE)) + any_value(CAST(prior AS DOUBLE)) AS r FROM x JOIN p USING (j) GROUP BY vec_id, t, key)
SELECT vec_id, arg_max(key, r) AS key, round(max(r), 6) AS correlation FROM r GROUP BY vec_id"""


@query("agg31_best_key", _key_sql())
def agg31(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve components of each vector as pitch classes."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))
    k = e.withColumn("k", blocks.best_key(F.col("chroma")))
    return k.select("vec_id", "k.key", F.round("k.correlation", 6).alias("correlation"))


@query(
    "agg32_consensus_tempo",
    """WITH m AS (SELECT user_id, median(value) AS m FROM {ev} GROUP BY user_id),
f AS (SELECT e.user_id, e.event_id, strength + 0.1 AS w, round(CASE WHEN abs(value / 0.5 - m) <= abs(value - m) AND abs(value / 0.5 - m) <= abs(value / 2.0 - m) THEN value / 0.5 WHEN abs(value - m) <= abs(value / 2.0 - m) THEN value ELSE value / 2.0 END, 6) AS v FROM {ev} e JOIN m USING (user_id)),
c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY v, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY user_id) AS total FROM f)
SELECT user_id, min(v) AS median FROM c WHERE run >= total / 2 GROUP BY user_id""",
)
def agg32(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    m = e.groupBy("user_id").agg(F.median("value").alias("m"))
    f = e.join(m, "user_id").select("user_id", "event_id", (F.col("strength") + 0.1).alias("w"), F.round(blocks.octave_folded(F.col("value"), F.col("m")), 6).alias("v"))
    return blocks.weighted_median(f, ["user_id"], "v", "w", "event_id")


@query("agg34_scaled_by_p95", "SELECT event_id, round(least(1.0, value / quantile_cont(value, 0.95) OVER (PARTITION BY user_id)), 6) AS x FROM {ev}")
def agg34(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).groupBy("user_id").agg(F.percentile("value", F.lit(0.95)).alias("p")).where("p > 0")
    return events(spark, d).join(p, "user_id").select("event_id", F.round(F.least(F.lit(1.0), F.col("value") / F.col("p")), 6).alias("x"))


@query("agg36_segment_features", "SELECT user_id, CAST(floor(idx / 10) AS BIGINT) AS segment, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM {curve} GROUP BY 1, 2")
def agg36(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).withColumn("segment", F.floor(F.col("idx") / 10))
    return c.groupBy("user_id", "segment").agg(mean6().alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@query("agg37_block_tempo", "SELECT user_id, CAST(floor(idx / 10) AS BIGINT) AS block, round(avg(strength), 6) AS activity, coalesce(median(CASE WHEN value > 100 THEN value END), 0) AS tempo FROM {curve} GROUP BY 1, 2")
def agg37(spark: SparkSession, d: str) -> DataFrame:
    c = blocks.by_size(curve(spark, d), "idx", 10, ["user_id"])
    return c.groupBy("user_id", "block").agg(mean6("strength").alias("activity"), F.coalesce(F.median(F.when(F.col("value") > 100, F.col("value"))), F.lit(0.0)).alias("tempo"))


@query(
    "agg39_cut_contrast",
    """WITH v AS (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.label, avg(CASE WHEN a.s = 0 AND b.s = 0 THEN list_dot_product(a.v, b.v) END) AS aa, avg(CASE WHEN a.s = 1 AND b.s = 1 THEN list_dot_product(a.v, b.v) END) AS bb, avg(CASE WHEN a.s = 0 AND b.s = 1 THEN list_dot_product(a.v, b.v) END) AS ab FROM v a JOIN v b ON a.label = b.label GROUP BY a.label)
SELECT label, round(0.5 * (aa + bb) - ab, 6) AS contrast FROM p""",
)
def agg39(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("side", F.col("vec_id") % 2)
    return blocks.within_minus_between(e, ["label"], "side", "embedding").withColumn("contrast", F.round("contrast", 6))


@query("agg21_summed_bands", "SELECT label, CAST(i AS INTEGER) AS i, round(sum(x), 5) AS total FROM (SELECT label, vec_id, unnest(range(0, 64 - label)) AS i, unnest(CAST(embedding[1:64 - label] AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, i")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise sums, cut to the length that the vectors of a label have in common: 64 less the label."""
    e = read(spark, d, "embeddings").select("label", F.posexplode(F.slice("embedding", F.lit(1), 64 - F.col("label"))).alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("total"))


@query("agg42_mean_or_zero", "SELECT c_custkey, round(coalesce(avg(o_totalprice), 0), 4) AS mean FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY c_custkey")
def agg42(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    return read(spark, d, "customer").select("c_custkey").join(m, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("m", F.lit(0.0)), 4).alias("mean"))


@query("agg13_unit_statistics", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(avg(strength), 6) AS strength, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM {ev} GROUP BY user_id")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), mean6().alias("mean"), mean6("strength").alias("strength"), F.collect_set("event_type").alias("t"))
    return g.select("user_id", "n", "mean", "strength", F.array_join(F.array_sort("t"), ",").alias("tags"))


@query(
    "agg15_ranked_tags",
    "WITH w AS (SELECT user_id, event_type, count(*) AS n, min(idx) AS f FROM {curve} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rk FROM w) SELECT user_id, event_type, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 3",
)
def agg15(spark: SparkSession, d: str) -> DataFrame:
    g = curve(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("idx").alias("f"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "f"))).where("rank <= 3").select("user_id", "event_type", "rank")


@query("agg45_channel_means", "SELECT label, round(avg(embedding[1]), 6) AS r, round(avg(embedding[2]), 6) AS g, round(avg(embedding[3]), 6) AS b, round(avg(greatest(embedding[1], embedding[2], embedding[3])), 6) AS brightness FROM embeddings GROUP BY label")
def agg45(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col("embedding")[i].cast("double") for i in range(3)]
    return read(spark, d, "embeddings").groupBy("label").agg(*[mean6(x).alias(n) for x, n in zip(c, "rgb", strict=True)], mean6(F.greatest(*c)).alias("brightness"))


@query("agg48_drop_counters", "SELECT user_id, count(*) AS dropped FROM {curve} WHERE n - idx > 40 GROUP BY user_id")
def agg48(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a queue of the last 40 has dropped, by client."""
    n = events(spark, d).groupBy("user_id").count()
    return n.where("count > 40").select("user_id", (F.col("count") - 40).alias("dropped"))


# --- planners ---

_BEATS = "(SELECT DISTINCT user_id, us FROM {ev})"


@query(
    "win41_beat_plan",
    f"""WITH RECURSIVE b AS MATERIALIZED {_BEATS}, ok AS (SELECT a.user_id, a.us, min(b.us) AS nx FROM b a JOIN b ON b.user_id = a.user_id AND b.us BETWEEN a.us + {4 * HOUR} AND a.us + {9 * HOUR} GROUP BY 1, 2),
n AS MATERIALIZED (SELECT b.user_id, b.us, coalesce(ok.nx, lead(b.us) OVER (PARTITION BY b.user_id ORDER BY b.us)) AS nx FROM b LEFT JOIN ok ON ok.user_id = b.user_id AND ok.us = b.us),
f AS (SELECT user_id, min(us) AS us FROM b GROUP BY user_id UNION ALL SELECT n.user_id, n.nx FROM f JOIN n ON n.user_id = f.user_id AND n.us = f.us WHERE n.nx IS NOT NULL)
SELECT f.user_id, f.us AS start, n.nx AS "end" FROM f JOIN n ON n.user_id = f.user_id AND n.us = f.us WHERE n.nx IS NOT NULL""",
)
def win41(spark: SparkSession, d: str) -> DataFrame:
    return planners.beat_plan(events(spark, d), ["user_id"], "us", 4 * HOUR, 9 * HOUR)


_T0 = 1_704_067_200_000_000


@query(
    "win42_peak_plan",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT user_id, (us - {_T0}) / 3600000000.0E0 AS t FROM {{ev}} WHERE value > 150), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM p),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 0.0E0 AS now, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS l FROM p GROUP BY user_id
 UNION ALL SELECT o.user_id, o.rn, CASE WHEN t - now > 0 AND t - now >= 6 THEN now + least(t - now, 30.0E0) ELSE now END, CASE WHEN t - now > 0 AND t - now >= 6 THEN now END, CASE WHEN t - now > 0 AND t - now >= 6 THEN least(t - now, 30.0E0) END FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, round(s, 6) AS start, round(l, 6) AS length FROM f WHERE s IS NOT NULL""",
)
def win42(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).where("value > 150").select("user_id", ((F.col("us") - _T0) / HOUR).alias("t"))
    return planners.peak_plan(p, ["user_id"], "t", 6.0, 30.0).select("user_id", F.round("start", 6).alias("start"), F.round("length", 6).alias("length"))


_TOTALS = "(SELECT user_id, CAST(count(*) AS DOUBLE) AS total FROM {ev} GROUP BY user_id)"


def totals(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.count("*").cast("double").alias("total"))


@query("win44_time_grid", f"SELECT user_id, CAST(n AS INTEGER) AS n, n * 5.0E0 AS start, least(5.0E0, total - n * 5.0E0) AS length FROM (SELECT *, unnest(range(0, CAST(ceil(total / 5) AS BIGINT))) AS n FROM {_TOTALS})")
def win44(spark: SparkSession, d: str) -> DataFrame:
    return planners.grid(totals(spark, d), "total", F.lit(5.0)).select("user_id", "n", "start", "length")


@query(
    "win43_phrases",
    f"SELECT user_id, CAST(n AS INTEGER) AS n, n * s AS start, least(s, total - n * s) AS length FROM (SELECT *, unnest(range(0, CAST(ceil(total / s) AS BIGINT))) AS n FROM (SELECT user_id, total, greatest(2.0E0, least(20.0E0, CASE WHEN user_id % 5 >= 4 THEN 4 WHEN user_id % 5 >= 3 THEN 8 ELSE 16 END * 4 * 60.0E0 / 120)) AS s FROM {_TOTALS}))",
)
def win43(spark: SparkSession, d: str) -> DataFrame:
    step = planners.phrase_length(F.lit(120.0), F.col("user_id") % 5, 2.0, 20.0)
    return planners.grid(totals(spark, d), "total", step).select("user_id", "n", "start", "length")


@query(
    "win45_grid_with_tail",
    f"""WITH c AS (SELECT *, floor(total / 8) AS whole, total - floor(total / 8) * 8 AS tail FROM {_TOTALS}), k AS (SELECT *, CAST(whole + CASE WHEN tail > 0 AND (tail >= 3 OR whole = 0) THEN 1 ELSE 0 END AS BIGINT) AS k FROM c)
SELECT user_id, CAST(n AS INTEGER) AS n, n * 8.0E0 AS start, CASE WHEN n = k - 1 THEN total - n * 8.0E0 ELSE 8.0E0 END AS length, CAST(n % 3 AS INTEGER) AS clip FROM (SELECT *, unnest(range(0, k)) AS n FROM k)""",
)
def win45(spark: SparkSession, d: str) -> DataFrame:
    g = planners.grid(totals(spark, d), "total", F.lit(8.0), 3.0)
    return g.select("user_id", "n", "start", "length", (F.col("n") % 3).alias("clip"))


@query("win47_even_indices", f"SELECT DISTINCT user_id, CAST(round_even(i * (total - 1) / 9, 0) AS BIGINT) AS idx FROM (SELECT *, unnest(range(0, 10)) AS i FROM {_TOTALS} WHERE total > 1)")
def win47(spark: SparkSession, d: str) -> DataFrame:
    return totals(spark, d).where("total > 1").select("user_id", F.explode(planners.evenly_spaced(F.col("total"), 10)).alias("idx"))


_CLIPS = "(SELECT user_id, us AS s, us + CAST(floor(value) AS BIGINT) * 60000000 AS e FROM {ev})"


@query(
    "win38_gaps",
    f"""WITH c AS {_CLIPS}, g AS (SELECT user_id, CAST(coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS a, CAST(s AS DOUBLE) AS b FROM c
UNION ALL SELECT user_id, CAST(max(e) AS DOUBLE), CAST({_T0 + 30 * 24 * HOUR} AS DOUBLE) FROM c GROUP BY user_id) SELECT user_id, a AS gap_start, b AS gap_end FROM g WHERE b - a > {6 * HOUR}""",
)
def win38(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).select("user_id", F.col("us").alias("s"), (F.col("us") + F.floor("value") * 60_000_000).alias("e"))
    return planners.gaps(c, ["user_id"], "s", "e", F.lit(_T0 + 30 * 24 * HOUR), 6 * HOUR)


@query(
    "win22_repeated_sources",
    "SELECT event_id, CAST(p AS INTEGER) AS part, CASE WHEN n = 1 THEN value ELSE least(60.0E0, round(value - p * 60.0E0, 6)) END AS part_length FROM (SELECT *, unnest(range(0, n)) AS p FROM (SELECT event_id, value, greatest(1, CAST(ceil(value / 60) AS BIGINT)) AS n FROM {ev}))",
)
def win22(spark: SparkSession, d: str) -> DataFrame:
    out = planners.repeated_sources(events(spark, d).withColumn("source", F.lit(60.0)), "value", "source")
    return out.select("event_id", "part", F.round("part_length", 6).alias("part_length"))


@query(
    "win18_chained_windows",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, value, idx FROM {curve}),
f AS (SELECT user_id, idx, value AS v, idx AS s FROM o WHERE idx = 0 UNION ALL SELECT o.user_id, o.idx, CASE WHEN abs(o.value - f.v) <= 60 THEN f.v ELSE o.value END, CASE WHEN abs(o.value - f.v) <= 60 THEN f.s ELSE o.idx END FROM f JOIN o ON o.user_id = f.user_id AND o.idx = f.idx + 1)
SELECT user_id, s AS idx, any_value(v) AS value, count(*) AS n FROM f GROUP BY user_id, s""",
)
def win18(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d).select("user_id", "idx", "event_id", "value")
    return planners.chained(c, ["user_id"], "idx", "event_id", lambda a, b: abs(b["value"] - a["value"]) <= 60).select("user_id", "idx", "value", "n")


_LEVELS = """(SELECT user_id, idx, CASE WHEN v > p * 1.5 AND p < 0.4 THEN 'drop' WHEN v < p * 0.4 AND p > 0.5 THEN 'breakdown' END AS kind, abs(v - p) AS intensity FROM
(SELECT user_id, idx, n, v, avg(v) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM (SELECT user_id, idx, n, value / max(value) OVER (PARTITION BY user_id) AS v FROM {curve})) WHERE idx >= 5 AND idx < n - 5)"""


@query(
    "win04_level_events",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS rn FROM {_LEVELS} WHERE kind IS NOT NULL),
f AS (SELECT user_id, rn, idx AS k, kind AS kk, true AS keep FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.idx - f.k > 2 OR e.kind <> f.kk THEN e.idx ELSE f.k END, CASE WHEN e.idx - f.k > 2 OR e.kind <> f.kk THEN e.kind ELSE f.kk END, e.idx - f.k > 2 OR e.kind <> f.kk FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT e.user_id, e.idx, e.kind, round(e.intensity, 6) AS intensity FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn WHERE keep""",
)
def win04(spark: SparkSession, d: str) -> DataFrame:
    found = planners.level_events(curve(spark, d).select("user_id", "idx", "event_id", "value"), ["user_id"], "idx", "value", 5)
    out = planners.collapsed(found.drop("value"), ["user_id"], "idx", "event_id", "kind", 2)
    return out.select("user_id", "idx", "kind", F.round("intensity", 6).alias("intensity"))


@query(
    "jon23_boosted_triggers",
    f"""WITH b AS (SELECT user_id, us, min(event_id) AS event_id, any_value(strength ORDER BY event_id) AS s FROM {{ev}} WHERE event_type = 'click' GROUP BY user_id, us), st AS (SELECT user_id, us, event_id, strength FROM {{ev}} WHERE event_type = 'view'),
d AS (SELECT st.event_id, st.user_id, st.strength, arg_min(b.us, abs(b.us - st.us) * 2 + CASE WHEN b.us > st.us THEN 1 ELSE 0 END) AS near, min(abs(b.us - st.us)) AS dist FROM st JOIN b USING (user_id) GROUP BY 1, 2, 3),
l AS (SELECT user_id, near AS us, sum(strength) AS lent FROM d WHERE dist <= {2 * HOUR} GROUP BY 1, 2)
SELECT e.event_id, round(least(2 * strength, strength + CASE WHEN e.event_id = b.event_id THEN coalesce(lent, 0) * 0.25 ELSE 0 END), 6) AS boosted FROM {{ev}} e LEFT JOIN b ON b.user_id = e.user_id AND b.us = e.us LEFT JOIN l ON l.user_id = e.user_id AND l.us = e.us WHERE event_type = 'click'""",
)
def jon23(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "us", "event_id", "strength", "event_type")
    base, _ = planners.boosted(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "us", "event_id", "strength", 4 * HOUR)
    return base.select("event_id", F.round("boosted", 6).alias("boosted"))


@query(
    "jon23_gap_triggers",
    f"""WITH b AS (SELECT user_id, us FROM {{ev}} WHERE event_type = 'click'), st AS (SELECT user_id, us, event_id FROM {{ev}} WHERE event_type = 'view')
SELECT event_id FROM st WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = st.user_id AND abs(b.us - st.us) < {4 * HOUR})""",
)
def jon23_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "us", "event_id", "strength", "event_type")
    _, left = planners.boosted(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "us", "event_id", "strength", 4 * HOUR)
    return left.select("event_id")


@query("jon35_generated_grid", f"SELECT user_id, CAST(i AS INTEGER) AS i, i * s AS at FROM (SELECT user_id, s, unnest(range(0, greatest(1, CAST(ceil(total / s) AS BIGINT)))) AS i FROM (SELECT user_id, total, 2.0E0 + user_id % 3 AS s FROM {_TOTALS}))")
def jon35(spark: SparkSession, d: str) -> DataFrame:
    t = totals(spark, d).select("user_id", F.posexplode(planners.spaced_grid(F.col("total"), 2.0 + F.col("user_id") % 3)).alias("i", "at"))
    return t
