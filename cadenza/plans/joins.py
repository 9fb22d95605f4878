"""Queries over points, intervals, curves and feature series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, signals
from ..operators.vectors import query_vector, top_k
from ..sources.tables import EVENTS_SQL, events, read
from .blocks import CURVE_SQL, curve
from .library import WEIGHTS_SQL, weight_table
from .timeline import DAY, HOUR, SECTIONS_SQL, sections

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{curve}", CURVE_SQL).replace("{sections}", SECTIONS_SQL).replace("{ev}", EVENTS_SQL)
        return f

    return add


def in_section(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return intervals.containing(e, sections(e), ["user_id"], "us", "start_us", "end_us", DAY)


@query("jon10_label_at", "SELECT e.event_id, coalesce(CAST(s.section_id AS VARCHAR), 'transition') AS label FROM {ev} e LEFT JOIN {sections} s ON s.user_id = e.user_id AND e.us >= s.start_us AND e.us < s.end_us")
def jon10(spark: SparkSession, d: str) -> DataFrame:
    return in_section(spark, d).select("event_id", F.coalesce(F.col("section_id").cast("string"), F.lit("transition")).alias("label"))


@query(
    "jon11_enclosing_or_first",
    "WITH s AS {sections}, f AS (SELECT user_id, arg_min(section_id, start_us) AS first_id FROM s GROUP BY user_id) SELECT e.event_id, coalesce(s.section_id, f.first_id) AS section_id FROM {ev} e LEFT JOIN s ON s.user_id = e.user_id AND e.us >= s.start_us AND e.us < s.end_us LEFT JOIN f ON f.user_id = e.user_id",
)
def jon11(spark: SparkSession, d: str) -> DataFrame:
    first = sections(events(spark, d)).groupBy("user_id").agg(F.min_by("section_id", "start_us").alias("first_id"))
    return in_section(spark, d).join(first, "user_id", "left").select("event_id", F.coalesce("section_id", "first_id").alias("section_id"))


@query("jon12_cut_chapters", "SELECT s.section_id, count(*) AS n FROM {ev} e JOIN {sections} s ON s.user_id = e.user_id AND e.us >= s.start_us AND e.us < s.end_us WHERE event_type = 'click' GROUP BY 1")
def jon12(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    hit = intervals.containing(e.where("event_type = 'click'"), sections(e), ["user_id"], "us", "start_us", "end_us", DAY, "inner")
    return hit.groupBy("section_id").agg(F.count("*").alias("n"))


@query("jon13_anchor_override", "SELECT e.event_id, coalesce(-s.section_id, e.event_id % 50) AS clip FROM {ev} e LEFT JOIN {sections} s ON s.user_id = e.user_id AND e.us >= s.start_us AND e.us < s.end_us")
def jon13(spark: SparkSession, d: str) -> DataFrame:
    return in_section(spark, d).select("event_id", F.coalesce(-F.col("section_id"), F.col("event_id") % 50).alias("clip"))


_ANCHORS = "(SELECT user_id, us, min(value) AS v FROM {ev} WHERE event_type = 'purchase' GROUP BY 1, 2)"


@query(
    "jon21_interpolated_anchors",
    f"""WITH a AS {_ANCHORS}, e AS (SELECT event_id, user_id, us FROM {{ev}} WHERE event_type = 'click'),
b AS (SELECT e.event_id, max(a.us) AS t0, arg_max(a.v, a.us) AS v0 FROM e JOIN a ON a.user_id = e.user_id AND a.us <= e.us GROUP BY 1), n AS (SELECT e.event_id, min(a.us) AS t1, arg_min(a.v, a.us) AS v1 FROM e JOIN a ON a.user_id = e.user_id AND a.us >= e.us GROUP BY 1)
SELECT e.event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (e.us - t0) / (t1 - t0) END, 6) AS v FROM e LEFT JOIN b USING (event_id) LEFT JOIN n USING (event_id)""",
)
def jon21(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = e.where("event_type = 'purchase'").groupBy("user_id", F.col("us").alias("at")).agg(F.min("value").alias("v"))
    out = intervals.interpolated(e.where("event_type = 'click'").select("user_id", "event_id", "us"), a, ["user_id"], "us", "at", "v")
    return out.select("event_id", F.round("interpolated", 6).alias("v"))


@query(
    "jon24_alignment",
    f"""WITH c AS (SELECT user_id, us, event_id FROM {{ev}} WHERE event_type = 'click'), v AS (SELECT DISTINCT user_id, us FROM {{ev}} WHERE event_type = 'view'),
p AS (SELECT c.user_id, c.event_id, arg_min(v.us, abs(v.us - c.us) * 2 + CASE WHEN v.us > c.us THEN 1 ELSE 0 END) AS near, min(abs(v.us - c.us)) AS d FROM c LEFT JOIN v USING (user_id) GROUP BY 1, 2)
SELECT user_id, count(*) AS n, count(*) FILTER (d <= {6 * HOUR}) AS matched, count(DISTINCT CASE WHEN d <= {6 * HOUR} THEN near END) = count(*) FILTER (d <= {6 * HOUR}) AND count(*) FILTER (d <= {6 * HOUR}) >= 0.5 * count(*) AS aligned FROM p GROUP BY user_id""",
)
def jon24(spark: SparkSession, d: str) -> DataFrame:
    """All or nothing: enough of a series' events have a neighbour within reach, and no two share one."""
    e = events(spark, d)
    v = e.where("event_type = 'view'").select("user_id", F.col("us").alias("near")).distinct()
    p = intervals.nearest(e.where("event_type = 'click'").select("user_id", "us", "event_id"), v, ["user_id"], "us", "near")
    ok = F.col("distance") <= 6 * HOUR
    g = p.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("matched"), F.count_distinct(F.when(ok, F.col("near"))).alias("u"))
    return g.select("user_id", "n", "matched", ((F.col("u") == F.col("matched")) & (F.col("matched") >= 0.5 * F.col("n"))).alias("aligned"))


@query(
    "jon25_validated_series",
    "WITH g AS (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p, value FROM {ev}) SELECT user_id, bool_and(p IS NULL OR us > p) AS monotone, bool_and(isfinite(value)) AS finite, round(60 / (median(us - p) / 3600000000.0E0), 6) AS rate FROM g GROUP BY user_id",
)
def jon25(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).withColumn("p", F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    finite = ~(F.isnan("value") | (F.abs("value") == float("inf")))
    return g.groupBy("user_id").agg(
        F.bool_and(F.col("p").isNull() | (F.col("us") > F.col("p"))).alias("monotone"), F.bool_and(finite).alias("finite"), F.round(60 / (F.median(F.col("us") - F.col("p")) / HOUR), 6).alias("rate")
    )


@query(
    "jon27_regularity",
    "WITH g AS (SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 3600000000.0E0 AS g FROM {ev}), m AS (SELECT user_id, median(g) AS m FROM g GROUP BY user_id) SELECT g.user_id, round(any_value(m), 6) AS median_gap, round(median(abs(g - m)), 6) AS spread FROM g JOIN m USING (user_id) GROUP BY g.user_id",
)
def jon27(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).select("user_id", ((F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))) / HOUR).alias("g"))
    m = g.groupBy("user_id").agg(F.median("g").alias("m"))
    return g.join(m, "user_id").groupBy("user_id").agg(F.round(F.first("m"), 6).alias("median_gap"), F.round(F.median(F.abs(F.col("g") - F.col("m"))), 6).alias("spread"))


@query("jon29_boundary_distance", "SELECT e.event_id, coalesce(min(abs(e.us - p.us)) / 3600000000.0E0, 1.0E0) AS hours FROM {ev} e LEFT JOIN (SELECT user_id, us FROM {ev} WHERE event_type = 'purchase' AND value > 200) p ON p.user_id = e.user_id GROUP BY e.event_id")
def jon29(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    b = e.where("event_type = 'purchase' and value > 200").select("user_id", F.col("us").alias("at")).distinct()
    return intervals.nearest(e, b, ["user_id"], "us", "at").select("event_id", F.coalesce(F.col("distance") / HOUR, F.lit(1.0)).alias("hours"))


@query("jon37_forward_or_last", f"WITH a AS {_ANCHORS} SELECT e.event_id, coalesce(arg_min(a.v, a.us) FILTER (a.us >= e.us), arg_max(a.v, a.us)) AS v FROM {{ev}} e LEFT JOIN a ON a.user_id = e.user_id GROUP BY e.event_id")
def jon37(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = e.where("event_type = 'purchase'").groupBy("user_id", F.col("us").alias("at")).agg(F.min("value").alias("v"))
    last = a.groupBy("user_id").agg(F.max_by("v", "at").alias("last"))
    out = intervals.as_of(e, a, ["user_id"], "us", "at", ["v"], "forward").join(last, "user_id", "left")
    return out.select("event_id", F.coalesce("v", "last").alias("v"))


@query("jon07_uncorrelated_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def jon07(spark: SparkSession, d: str) -> DataFrame:
    hit = read(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").join(hit, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("jon30_live_lookup", "SELECT e.event_id, v.vec_id FROM events e JOIN embeddings v ON v.vec_id = e.user_id WHERE v.label <> 9")
def jon30(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").where("label <> 9").select("vec_id", F.col("vec_id").alias("user_id"))
    return events(spark, d).join(v, "user_id").select("event_id", "vec_id")


@query("jon31_similar_clips", "SELECT vec_id FROM (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 5) AS DOUBLE[])) AS s FROM embeddings WHERE vec_id <> 5) ORDER BY s DESC, vec_id LIMIT 10")
def jon31(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return top_k(e, "embedding", query_vector(e, "embedding", F.col("vec_id") == 5), 10, "vec_id", F.col("vec_id") != 5).select("vec_id")


@query("jon32_score_matrix", "SELECT r_name, p_partkey, round(1 - abs(p_size / 50.0E0 - r_regionkey / 5.0E0), 6) AS score FROM region, part")
def jon32(spark: SparkSession, d: str) -> DataFrame:
    """Every mood against every clip: the moods, five regions by the table's definition, travel and the clips stay."""
    moods = F.broadcast(read(spark, d, "region").select("r_name", "r_regionkey"))
    p = read(spark, d, "part").select("p_partkey", "p_size").crossJoin(moods)
    return p.select("r_name", "p_partkey", F.round(1 - F.abs(F.col("p_size") / 50 - F.col("r_regionkey") / 5), 6).alias("score"))


@query("jon33_on_downbeat", f"SELECT event_id FROM {{ev}} e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM {{ev}} b WHERE b.event_type = 'click' AND b.user_id = e.user_id AND abs(b.us - e.us) < {2 * HOUR})")
def jon33(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    b = e.where("event_type = 'click'").select("user_id", F.col("us").alias("at")).distinct()
    near = intervals.nearest(e.where("event_type = 'view'").select("user_id", "us", "event_id"), b, ["user_id"], "us", "at")
    return near.where(F.col("distance") < 2 * HOUR).select("event_id")


@query(
    "jon20_accepted_anchors",
    f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {{ev}}),
k AS (SELECT user_id, rn, event_id, us + {10 * HOUR} AS stop, true AS taken FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN o.us >= stop THEN o.us + {10 * HOUR} ELSE stop END, o.us >= stop FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1)
SELECT event_id FROM k WHERE taken""",
)
def jon20(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of ten hours each, taken in order of time unless they overlap one that was taken."""
    e = events(spark, d).select("user_id", "us", "event_id", (F.col("us") + 10 * HOUR).alias("end_us"))
    return intervals.accepted(e, ["user_id"], "us", "event_id", "end_us").select("event_id")


# --- feedback ---


@query("agg03_extreme_axes", f"WITH w AS (SELECT axis, round(sum(positive) - sum(negative), 4) AS diff, sum(positive) + sum(negative) AS n FROM {WEIGHTS_SQL} WHERE level = 0 GROUP BY axis), k AS (SELECT axis, diff FROM w WHERE n >= 10) (SELECT 'top' AS side, axis, diff FROM k ORDER BY diff DESC, axis LIMIT 5) UNION ALL (SELECT 'bottom', axis, diff FROM k ORDER BY diff, axis LIMIT 5)")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    w = weight_table(spark, d).where("level = 0").groupBy("axis").agg(F.round(F.sum("positive") - F.sum("negative"), 4).alias("diff"), (F.sum("positive") + F.sum("negative")).alias("n")).where("n >= 10")
    top = w.orderBy(F.desc("diff"), "axis").limit(5).select(F.lit("top").alias("side"), "axis", "diff")
    return top.unionByName(w.orderBy("diff", "axis").limit(5).select(F.lit("bottom").alias("side"), "axis", "diff"))


@query("agg05_unique_receipts", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) = count(*) AS ok FROM {ev} GROUP BY event_type")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), (F.count_distinct("event_id") == F.count("*")).alias("ok"))


@query("agg09_weighted_score", f"WITH p AS (SELECT axis, level, (sum(positive) + 1) / (sum(positive) + sum(negative) + 2) AS m FROM {WEIGHTS_SQL} GROUP BY axis, level) SELECT axis, round(coalesce(avg(m * (level + 1)), 0), 6) AS score FROM p WHERE level < 3 GROUP BY axis")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    p = weight_table(spark, d).where("level < 3").groupBy("axis", "level").agg(((F.sum("positive") + 1) / (F.sum("positive") + F.sum("negative") + 2)).alias("m"))
    return p.groupBy("axis").agg(F.round(F.coalesce(F.avg(F.col("m") * (F.col("level") + 1)), F.lit(0.0)), 6).alias("score"))


@query("win26_summed_variance", f"WITH v AS (SELECT axis, level, key, (positive + 1) * (negative + 1) / ((positive + negative + 2) * (positive + negative + 2) * (positive + negative + 3)) AS v FROM {WEIGHTS_SQL}) SELECT level, count(*) AS n, round(sum(v), 6) AS total FROM v GROUP BY level")
def win26(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("positive") + 1, F.col("negative") + 1
    v = weight_table(spark, d).withColumn("v", a * b / ((a + b) * (a + b) * (a + b + 1)))
    return v.groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


# --- feature series ---


@query(
    "win09_novelty",
    """WITH u AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, vec_id, unnest(range(0, 64)) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM u),
d AS (SELECT label, vec_id, i, avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - avg(x) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS d FROM x)
SELECT label, vec_id, round(coalesce(sum(d * d), 0), 6) AS novelty FROM d GROUP BY label, vec_id""",
)
def win09(spark: SparkSession, d: str) -> DataFrame:
    """Each label's vectors in order of id as a feature series."""
    n = signals.novelty(read(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 4)
    return n.select("label", "vec_id", F.round("novelty", 6).alias("novelty"))


@query("win10_boundaries", None)
def win10(spark: SparkSession, d: str) -> DataFrame:
    """Novelty, its peaks, and no two of them within eight rows."""
    e = read(spark, d, "embeddings").withColumn("idx", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    n = signals.novelty(e, ["label"], "idx", "embedding", 4)
    return signals.picked_peaks(n.withColumn("novelty", F.round("novelty", 9)), ["label"], "idx", "novelty", 8).select("label", "idx")


@query(
    "win30_picked_peaks",
    """WITH RECURSIVE c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {ev}),
l AS (SELECT user_id, median(value) + stddev_pop(value) AS level FROM c GROUP BY user_id),
m AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM c WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
o AS MATERIALIZED (SELECT m.user_id, idx, row_number() OVER (PARTITION BY m.user_id ORDER BY value DESC, idx) AS rn FROM m JOIN l USING (user_id) WHERE value > a AND value > b AND value >= level),
k AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT o.user_id, o.rn, CASE WHEN len(list_filter(kept, lambda x: abs(x - o.idx) < 4)) = 0 THEN list_append(kept, o.idx) ELSE kept END FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1)
SELECT user_id, unnest(max_by(kept, rn)) AS idx FROM k GROUP BY user_id""",
)
def win30(spark: SparkSession, d: str) -> DataFrame:
    return signals.picked_peaks(curve(spark, d), ["user_id"], "idx", "value", 4).select("user_id", "idx")


@query("win32_segmentation", None)
def win32(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("idx", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    return signals.segment_starts(e, ["label"], "idx", "embedding", 3, 30, 0.5)


@query("win19_absorbed_segments", None)
def win19(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("next", F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).where("next > us")
    return signals.without_short(e.select("user_id", "us", "next", "value"), ["user_id"], "us", "next", "value", float(4 * HOUR))


@query("mth08_best_phase", "WITH p AS (SELECT user_id, least(63, CAST(floor((us % 86400000000) / 86400000000.0E0 * 64) AS INTEGER)) AS p, sum(value) AS s FROM {ev} GROUP BY 1, 2) SELECT user_id, arg_max(p, round(s, 9) * 1000 - p / 1000.0E0) AS phase, round(max(s) * 64 / sum(s), 6) AS contrast FROM p GROUP BY user_id")
def mth08(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("t", F.col("us").cast("double"))
    return signals.best_phase(e, ["user_id"], "t", "value", 24.0 * HOUR).select("user_id", "phase", F.round("contrast", 6).alias("contrast"))


@query("mth14_standardised", "WITH x AS (SELECT label, vec_id, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), z AS (SELECT label, vec_id, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM x WINDOW w AS (PARTITION BY label, i)) SELECT vec_id, round(sum(z), 5) AS total FROM z GROUP BY vec_id HAVING sum(z) IS NOT NULL")
def mth14(spark: SparkSession, d: str) -> DataFrame:
    z = signals.standardised(read(spark, d, "embeddings"), ["label"], "embedding", "z")
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
