"""Queries over axis values, labels, predicates and shares: no shuffle but where a group is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs, scoring
from ..sources.tables import EVENTS_SQL, events, read

QUERIES: dict = {}
ORACLES: dict = {}

#: Event types as trigger kinds and as mood tags.
KINDS = {"click": "beat", "view": "onset", "purchase": "kick", "signup": "snare", "error": "hihat"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL).replace("{kind}", KIND_SQL)
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("prj01_current_model", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_type LIKE 'P%' AND p_type = (SELECT min(p_type) FROM part WHERE p_type LIKE 'P%')")
def prj01(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    version = p.where("p_type like 'P%'").agg(F.min("p_type")).first()[0] or ""  # one value
    return p.where(scoring.current_model(F.col("p_brand"), F.col("p_type"), "Brand#11", version)).select("p_partkey")


@query("prj02_stage_completed", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL")
def prj02(spark: SparkSession, d: str) -> DataFrame:
    stages = F.create_map(F.lit("scan"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed"))
    return read(spark, d, "orders").where((F.try_element_at(stages, F.lit("scan")) == "completed") & F.col("o_totalprice").isNotNull()).select("o_orderkey")


@query(
    "prj04_first_parseable",
    "SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), try_cast(json_extract_string(props, '$.k') AS DOUBLE), value) AS value, CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL THEN 'props' ELSE 'column' END AS source FROM events",
)
def prj04(spark: SparkSession, d: str) -> DataFrame:
    f = scoring.first_parseable({"type": F.col("event_type"), "props": F.get_json_object("props", "$.k"), "column": F.col("value")})
    return events(spark, d).select("event_id", f["value"].alias("value"), f["source"].alias("source"))


@query(
    "prj05_axis_availability",
    "SELECT event_id, CASE WHEN value > 300 THEN 'too_loud' ELSE 'available' END AS energy, CASE WHEN event_type = 'error' THEN 'no_beats' ELSE 'available' END AS beat FROM {ev}",
)
def prj05(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.availability({"energy": F.when(F.col("value") > 300, "too_loud"), "beat": F.when(F.col("event_type") == "error", "no_beats")})
    return events(spark, d).select("event_id", m["energy"].alias("energy"), m["beat"].alias("beat"))


@query("prj06_canonical_label", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'drop' WHEN 'view' THEN 'verse' WHEN 'click' THEN 'click' ELSE 'transition' END AS segment FROM {ev}")
def prj06(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit(" "), F.upper("event_type"))
    return events(spark, d).select("event_id", scoring.canonical(label, {"purchase": "drop", "view": "verse"}, ["drop", "verse", "click"], "transition").alias("segment"))


@query(
    "prj07_audio_axes",
    """SELECT event_id, round(CASE WHEN {kind} = 'beat' THEN strength ELSE 0 END, 6) AS beat_weight, round(CASE WHEN {kind} = 'onset' THEN strength ELSE 0 END, 6) AS onset_weight,
round(CASE WHEN {kind} = 'kick' THEN strength ELSE 0 END, 6) AS kick_weight, round(CASE WHEN {kind} = 'snare' THEN strength ELSE 0 END, 6) AS snare_weight, round(CASE WHEN {kind} = 'hihat' THEN strength ELSE 0 END, 6) AS hihat_weight,
CAST(0 AS DOUBLE) AS energy_weight, round(greatest(0.0, 1 - least(1.0, value / 40 / 4)), 9) AS min_clip_length, round(least(1.0, value / 40 / 8), 9) AS max_clip_length FROM {ev}""",
)
def prj07(spark: SparkSession, d: str) -> DataFrame:
    a = scoring.trigger_axes(scoring.lookup(F.col("event_type"), KINDS, "none"), F.col("strength"))
    b = scoring.length_axes(F.col("value") / 40)
    return events(spark, d).select("event_id", *[r6(a[x]).alias(x) for x in scoring.TRIGGER_AXES.values()], *[F.round(b[x], 9).alias(x) for x in ("min_clip_length", "max_clip_length")])


_TAGS = "[CASE event_id % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'warm' ELSE 'calm' END, CASE event_id % 5 WHEN 0 THEN 'moody' WHEN 1 THEN 'happy' ELSE 'wide' END]"


def tags():
    i = F.col("event_id")
    return F.array(F.when(i % 3 == 0, "dark").when(i % 3 == 1, "warm").otherwise("calm"), F.when(i % 5 == 0, "moody").when(i % 5 == 1, "happy").otherwise("wide"))


@query(
    "prj08_video_axes",
    f"""WITH t AS (SELECT event_id, strength, value, {_TAGS} AS tags FROM {{ev}}), w AS (SELECT *, len(list_filter(tags, lambda x: x IN ('dark', 'moody'))) AS cold, len(list_filter(tags, lambda x: x IN ('warm', 'happy'))) AS warm FROM t)
SELECT event_id, round(1 - abs(strength - least(value / 490, 1.0)), 6) AS motion, round(exp(-(value / 490) / 0.5), 6) AS scene,
  round(1 - 0.5 * abs(CASE WHEN cold + warm > 0 THEN (warm - cold) / CAST(cold + warm AS DOUBLE) ELSE 0 END - strength), 6) AS color_temp,
  round(len(list_intersect(tags, ['dark', 'happy'])) / CAST(len(list_distinct(list_concat(tags, ['dark', 'happy']))) AS DOUBLE), 6) AS mood FROM w""",
)
def prj08(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("dark"), F.lit("happy"))
    return events(spark, d).select(
        "event_id", r6(scoring.closeness(F.col("strength"), F.col("value") / 490)).alias("motion"), r6(scoring.decay(F.col("value") / 490)).alias("scene"),
        r6(1 - 0.5 * F.abs(scoring.mood_warmth(tags()) - F.col("strength"))).alias("color_temp"), r6(scoring.mood_match(tags(), wanted)).alias("mood"),
    )


@query("prj09_clip", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0E0 ELSE least(1.0, greatest(0.0, (value - 50) / 100)) END AS x FROM {ev}")
def prj09(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise((F.col("value") - 50) / 100)
    return events(spark, d).select("event_id", exprs.clip01(x).alias("x"))


@query("prj12_mood_label", f"SELECT event_id, CASE WHEN list_has_any({_TAGS}, ['dark', 'moody']) THEN 'dark' WHEN list_has_any({_TAGS}, ['happy']) THEN 'uplifting' ELSE 'neutral' END AS mood FROM {{ev}}")
def prj12(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", scoring.mood_label(tags(), ["dark", "moody"], ["happy"]).alias("mood"))


@query("prj13_pace_label", "SELECT event_id, CASE WHEN strength < 0.33 THEN 'slow' WHEN strength < 0.66 THEN 'medium' ELSE 'fast' END AS pace FROM {ev}")
def prj13(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", scoring.bucket(F.col("strength"), [0.33, 0.66], ["slow", "medium", "fast"]).alias("pace"))


@query("prj16_curve_fit", "SELECT user_id, round(1 - abs(least(1.0, greatest(0.0, avg(value) / 300)) - 0.4), 6) AS score FROM {ev} GROUP BY user_id")
def prj16(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("curve"))
    return c.select("user_id", r6(scoring.curve_fit(F.col("curve"), 300.0, F.lit(0.4))).alias("score"))


@query("prj17_near_strength", "SELECT event_id FROM {ev} WHERE abs(strength - 0.5) < 0.1 ORDER BY strength DESC, event_id LIMIT 25")
def prj17(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(F.abs(F.col("strength") - 0.5) < 0.1).orderBy(F.desc("strength"), "event_id").limit(25).select("event_id")


@query("prj19_tag_predicate", f"SELECT event_id, list_has_all({_TAGS}, ['dark', 'moody']) AS has_all, list_has_any({_TAGS}, ['dark', 'moody']) AS has_any FROM {{ev}}")
def prj19(spark: SparkSession, d: str) -> DataFrame:
    want = ["dark", "moody"]
    return events(spark, d).select("event_id", scoring.has_tags(tags(), want, False).alias("has_all"), scoring.has_tags(tags(), want, True).alias("has_any"))


@query("prj20_theme", "SELECT p_partkey FROM part WHERE p_size IN (3, 7) OR contains(lower(p_name || ' ' || p_type), 'brass')")
def prj20(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(scoring.in_theme(F.col("p_size"), F.concat_ws(" ", "p_name", "p_type"), [3, 7], ["Brass"])).select("p_partkey")


@query(
    "prj21_blacklist_size",
    "SELECT user_id, n, CASE WHEN n <= 1 THEN 0 ELSE CAST(greatest(0, least(20, floor(n * CASE WHEN n <= 8 THEN 0.5E0 ELSE 0.6E0 END), n - 2)) AS INTEGER) END AS kept_back FROM (SELECT user_id, count(*) AS n FROM {ev} WHERE event_type = 'click' GROUP BY user_id)",
)
def prj21(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d).where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.withColumn("kept_back", scoring.blacklist_size(F.col("n"), 0.6, 2))


@query("prj25_sensitivity", "SELECT event_id, round(0.2 + strength * (0.02 - 0.2), 6) AS delta FROM {ev}")
def prj25(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(scoring.remapped(F.col("strength"), 0.2, 0.02)).alias("delta"))


@query("prj26_interval_bounds", "SELECT user_id, greatest(min(value), 0.5E0, 2.0E0) AS low, least(max(value) + 10, 400.0E0) AS high FROM {ev} GROUP BY user_id")
def prj26(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    s = scoring.interval_bounds([F.col("a"), F.lit(0.5), F.lit(2.0)], [F.col("b") + 10, F.lit(400.0)])
    return g.select("user_id", s["low"].alias("low"), s["high"].alias("high"))


@query(
    "prj27_strong_or_all",
    "SELECT event_id FROM (SELECT event_id, strength, max(CASE WHEN strength >= 1 AND event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS special, event_type FROM {ev}) t WHERE special = 0 OR (strength >= 1 AND event_type = 'signup')",
)
def prj27(spark: SparkSession, d: str) -> DataFrame:
    """Strong events of a series only; a series without any keeps all of its events."""
    strong = (F.col("strength") >= 1) & (F.col("event_type") == "signup")
    e = events(spark, d).withColumn("any", F.max(strong).over(Window.partitionBy("user_id")))
    return e.where(strong | ~F.col("any")).select("event_id")


@query(
    "prj28_downbeats",
    "WITH r AS (SELECT event_id, user_id, event_id % 4 AS bar, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {ev}), g AS (SELECT user_id, bool_or(rn <= 10 AND bar = 0) AS has FROM r GROUP BY user_id) SELECT event_id FROM r JOIN g USING (user_id) WHERE has AND bar = 0",
)
def prj28(spark: SparkSession, d: str) -> DataFrame:
    """Events of bar position 0, only where one of the first ten shows it."""
    w = Window.partitionBy("user_id")
    e = events(spark, d).withColumn("bar", F.col("event_id") % 4).withColumn("rn", F.row_number().over(w.orderBy("us", "event_id")))
    return e.withColumn("has", F.max((F.col("rn") <= 10) & (F.col("bar") == 0)).over(w)).where("has and bar = 0").select("event_id")


@query("prj29_intensity", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.2E0 WHEN 'view' THEN 0.6E0 ELSE 0.8E0 END AS m FROM {ev}")
def prj29(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", scoring.lookup(F.col("event_type"), {"purchase": 1.2, "view": 0.6}, 0.8).alias("m"))


@query("prj31_cap", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT least((SELECT CAST(count(*) AS INTEGER) FROM customer), 50)")
def prj31(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").orderBy("c_custkey").limit(50).select("c_custkey")


@query(
    "prj33_overall_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'completed' WHEN o_orderstatus = 'F' OR o_orderkey % 2 = 0 THEN 'partial' ELSE 'failed' END AS status FROM orders""",
)
def prj33(spark: SparkSession, d: str) -> DataFrame:
    done = lambda c: F.when(c, "completed").otherwise("failed")
    m = F.create_map(F.lit("scan"), done(F.col("o_orderstatus") == "F"), F.lit("beats"), done(F.col("o_orderkey") % 2 == 0), F.lit("key"), F.lit("unavailable"))
    return read(spark, d, "orders").select("o_orderkey", scoring.overall_status(m, ["key"]).alias("status"))


@query(
    "prj34_clamped_source",
    """WITH j AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_quantity / 2 AS n, p_size AS a FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a IS NULL THEN s ELSE least(s, greatest(a - 0.1, 0)) END, 6) AS start, round(CASE WHEN a IS NULL THEN n ELSE least(n, greatest(a - 0.1, 0) - least(s, greatest(a - 0.1, 0))) END, 6) AS length FROM j""",
)
def prj34(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("a"))
    j = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(p, "l_partkey", "left")
    c = scoring.clamp_source(F.col("l_quantity"), F.col("l_quantity") / 2, F.col("a"))
    return j.select("l_orderkey", "l_linenumber", r6(c["start"]).alias("start"), r6(c["length"]).alias("length"))


@query("prj35_missing_stages", "SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'signup', 'view'], lambda x: NOT list_contains(d, x))), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS d FROM {ev} WHERE value > 250 GROUP BY user_id)")
def prj35(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).where("value > 250").groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    return g.select("user_id", F.array_join(F.array_sort(scoring.missing_stages(["click", "error", "signup", "view"], F.col("done"))), ",").alias("missing"))


@query("prj38_second_page", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25 OFFSET 25")
def prj38(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").orderBy("p_partkey").offset(25).limit(25).select("p_partkey")


@query("prj39_progress", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 100.0E0 WHEN event_type = 'error' THEN 0.0E0 ELSE least(99.9E0, greatest(0.0E0, value - 20)) END AS p FROM {ev}")
def prj39(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value") - 20)
    return events(spark, d).select("event_id", scoring.progress(v, F.col("event_type") == "purchase").alias("p"))


@query("prj41_manifest_rules", "SELECT p_name AS family, 'family_across_splits' AS rule FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey % 3) > 1")
def prj41(spark: SparkSession, d: str) -> DataFrame:
    """Families that stand in several splits."""
    g = read(spark, d, "part").groupBy(F.col("p_name").alias("family")).agg(F.count_distinct(F.col("p_partkey") % 3).alias("n"))
    return g.where("n > 1").select("family", F.lit("family_across_splits").alias("rule"))


@query("prj42_key_number", "SELECT event_id, event_id AS k FROM {ev} WHERE event_id % 3 <> 2")
def prj42(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("clip_"), i)).when(F.col("event_id") % 3 == 1, i).otherwise(F.concat(F.lit("x"), i))
    return events(spark, d).select("event_id", scoring.key_number(key, "clip_").alias("k")).where("k is not null")


#: Context levels that feedback on an axis touches. Fixed values.
LEVELS = {"click": [0, 1], "view": [0, 1, 2], "purchase": [0, 1, 2, 3]}


@query("prj43_levels", "SELECT event_id, CAST(unnest(CASE event_type WHEN 'click' THEN [0, 1] WHEN 'view' THEN [0, 1, 2] WHEN 'purchase' THEN [0, 1, 2, 3] ELSE [0] END) AS INTEGER) AS level FROM {ev}")
def prj43(spark: SparkSession, d: str) -> DataFrame:
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    m = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), arr(v))])
    return events(spark, d).select("event_id", F.explode(F.coalesce(F.try_element_at(m, F.col("event_type")), arr([0]))).alias("level"))


CURVES = "(SELECT user_id, list(value ORDER BY us, event_id) AS c FROM {ev} GROUP BY user_id)"


def curves(e: DataFrame) -> DataFrame:
    s = F.sort_array(F.collect_list(F.struct("us", "event_id", "value")))
    return e.groupBy("user_id").agg(F.transform(s, lambda x: x["value"]).alias("c"))


@query("jon16_at_share", f"SELECT user_id, CAST(i AS INTEGER) AS i, c[least(len(c) - 1, CAST(floor(i / 10.0E0 * len(c)) AS INTEGER)) + 1] AS v FROM (SELECT *, unnest(range(0, 11)) AS i FROM {CURVES})")
def jon16(spark: SparkSession, d: str) -> DataFrame:
    c = curves(events(spark, d)).select("user_id", "c", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    return c.select("user_id", "i", scoring.at_share(F.col("c"), F.col("i") / 10).alias("v"))


@query("jon17_at_span", f"SELECT user_id, CAST(i AS INTEGER) AS i, 1 + least(1.0, c[CAST(floor(i / 10.0E0 * (len(c) - 1)) AS INTEGER) + 1] / 200) AS v FROM (SELECT *, unnest(range(0, 11)) AS i FROM {CURVES})")
def jon17(spark: SparkSession, d: str) -> DataFrame:
    c = curves(events(spark, d)).select("user_id", "c", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    return c.select("user_id", "i", (1 + exprs.clip01(scoring.at_span(F.col("c"), F.col("i") / 10) / 200)).alias("v"))


@query("jon19_tempo_at", f"SELECT n_nationkey, coalesce(c[CAST(floor(0.25 * (len(c) - 1)) AS INTEGER) + 1], 120) AS tempo FROM nation LEFT JOIN {CURVES} ON user_id = n_nationkey * 10")
def jon19(spark: SparkSession, d: str) -> DataFrame:
    c = curves(events(spark, d)).withColumn("n_nationkey", F.col("user_id") / 10).drop("user_id")
    n = read(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left")
    return n.select("n_nationkey", F.coalesce(scoring.at_span(F.col("c"), F.lit(0.25)), F.lit(120.0)).alias("tempo"))


@query("win20_phase_continues", "SELECT event_id, least(x, p - x) <= 0.125 * p AS continues FROM (SELECT event_id, value % p AS x, p FROM (SELECT event_id, value, 7.5E0 + user_id % 5 AS p FROM {ev}))")
def win20(spark: SparkSession, d: str) -> DataFrame:
    p = 7.5 + F.col("user_id") % 5
    return events(spark, d).select("event_id", (scoring.phase_distance(F.lit(0.0), F.col("value"), p) <= 0.125 * p).alias("continues"))


@query(
    "win21_folded_tempo",
    "SELECT event_id, round(CASE WHEN abs(value * f - 120) <= 2.4 THEN value * f ELSE value END, 6) AS bpm FROM (SELECT event_id, value, CASE WHEN abs(value / 2 - 120) < abs(value - 120) AND abs(value / 2 - 120) < abs(value * 2 - 120) THEN 0.5E0 WHEN abs(value * 2 - 120) < abs(value - 120) THEN 2.0E0 ELSE 1.0E0 END AS f FROM {ev})",
)
def win21(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(scoring.folded(F.col("value"), F.lit(120.0))).alias("bpm"))


@query("agg47_chance_rates", "SELECT event_id, round(least(1.0, 2 * 0.05 / (60 / value)), 6) AS rate FROM {ev}")
def agg47(spark: SparkSession, d: str) -> DataFrame:
    # no beat in a minute: the next one is infinitely far
    interval = F.when(F.col("value") == 0, float("inf")).otherwise(60 / F.col("value"))
    return events(spark, d).select("event_id", r6(scoring.chance_rate(0.05, interval)).alias("rate"))


@query("mth15_transform_size", "SELECT event_id, CAST(pow(2, ceil(log2(value * 10 + 1))) AS BIGINT) AS n FROM {ev}")
def mth15(spark: SparkSession, d: str) -> DataFrame:
    """The least power of two that holds a window."""
    return events(spark, d).select("event_id", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("value") * 10 + 1))).cast("long").alias("n"))


@query("mth16_score_ratio", "SELECT user_id, round(least(2.0, quantile_cont(value, 0.95) * (1 + stddev_pop(value) / 10) / 2000), 6) AS ratio FROM {ev} GROUP BY user_id")
def mth16(spark: SparkSession, d: str) -> DataFrame:
    score = F.percentile("value", F.lit(0.95)) * (1 + F.stddev_pop("value") / 10)
    return events(spark, d).groupBy("user_id").agg(r6(F.least(F.lit(2.0), score / 2000)).alias("ratio"))


@query("mth02_plain_cosine", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 1) AS DOUBLE[])), 6) AS c FROM embeddings")
def mth02(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.vectors import query_vector

    e = read(spark, d, "embeddings")
    q = F.array(*[F.lit(x) for x in query_vector(e, "embedding", F.col("vec_id") == 1)])
    return e.select("vec_id", r6(exprs.cosine(F.col("embedding"), q)).alias("c"))


@query("mth17_frame_rms", "SELECT event_id, round(rms / max(rms) OVER (PARTITION BY user_id), 6) AS rms FROM (SELECT event_id, user_id, sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS rms FROM {ev})")
def mth17(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = events(spark, d).withColumn("rms", F.sqrt(F.avg(F.col("value") * F.col("value")).over(w.orderBy("us", "event_id").rowsBetween(0, 15))))
    return e.select("event_id", r6(F.col("rms") / F.max("rms").over(w)).alias("rms"))
