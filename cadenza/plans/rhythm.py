"""Queries over tempo, phases, planners with state, projections, progress lines, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs, ids, scoring
from ..operators import blocks, intervals, planners, rhythm, signals, stores
from ..operators.vectors import query_vector, scored
from ..sources import files
from ..sources.tables import EVENTS_SQL, events, read
from ..streaming import windows

HOUR = 3_600_000_000
DAY = 24 * HOUR
T0 = 1_704_067_200_000_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


def onsets(spark: SparkSession, d: str) -> DataFrame:
    """Events with an hour taken as a second, so that a daily rhythm is 2.5 beats a minute."""
    return events(spark, d).select("user_id", "event_id", ((F.col("us") - T0) / HOUR).alias("t"), "strength")


_REFINED = f"""WITH e AS (SELECT user_id, (us - {T0}) / 3600000000.0E0 AS t, strength AS s FROM {{ev}}),
x AS (SELECT user_id, i, bpm, s, t / (60.0E0 / bpm) AS q FROM e, (SELECT i, 2.5E0 * (1 - 0.05E0 + i * (2 * 0.05E0 / 20)) AS bpm FROM (SELECT unnest(range(0, 21)) AS i))),
p AS (SELECT user_id, i, bpm, least(CAST(floor((q - floor(q)) * 48) AS INTEGER), 47) AS p, round(sum(s), 9) AS s FROM x GROUP BY ALL),
c AS (SELECT user_id, i, bpm, round(max(s) * 48 / sum(s), 9) AS contrast FROM p GROUP BY ALL HAVING sum(s) > 0)
SELECT user_id, round(arg_max(bpm, contrast * 1000000 - i / 1000.0E0), 6) AS bpm, round(max(contrast), 6) AS contrast FROM c GROUP BY user_id"""


@query("mth09_refined_tempo", _REFINED)
def mth09(spark: SparkSession, d: str) -> DataFrame:
    o = onsets(spark, d)
    start = o.select("user_id").distinct().withColumn("bpm", F.lit(2.5))
    return rhythm.refined(o, start, ["user_id"], "t", "strength", 0.05, 21).select("user_id", F.round("bpm", 6).alias("bpm"), F.round("contrast", 6).alias("contrast"))


@query(
    "mth10_resolved_phase",
    """WITH f AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM {ev}), l AS (SELECT user_id, max(i) AS last FROM f GROUP BY user_id),
g AS (SELECT user_id, last, half, half * 2.0E0 + 1.0E0 AS a FROM l, (SELECT unnest([0, 1]) AS half)),
p AS (SELECT user_id, last, half, a + n * 4.0E0 AS t FROM (SELECT *, unnest(range(0, greatest(CAST(floor((last * 0.5E0 - a) / 4.0E0) AS BIGINT), 0) + 1)) AS n FROM g)),
s AS (SELECT user_id, last, half, least(floor(t / 0.5E0), last) AS l, t / 0.5E0 - least(floor(t / 0.5E0), last) AS w FROM p),
m AS (SELECT s.user_id, half, sum((1 - w) * a.v + w * b.v) / count(*) AS m FROM s JOIN f a ON a.user_id = s.user_id AND a.i = s.l JOIN f b ON b.user_id = s.user_id AND b.i = least(s.l + 1, s.last) GROUP BY 1, 2),
o AS (SELECT user_id, last, max(CASE WHEN half = 0 THEN m END) AS a, max(CASE WHEN half = 1 THEN m END) AS b FROM m JOIN l USING (user_id) GROUP BY ALL)
SELECT user_id, last > 16 AND a > 0 AND b > a * 1.2 AS shifted, CASE WHEN last <= 16 THEN 1.0E0 WHEN a > 0 AND b > a * 1.2 THEN 2.5E0 ELSE 0.5E0 END AS anchor FROM o""",
)
def mth10(spark: SparkSession, d: str) -> DataFrame:
    """Frames half a second apart, a beat every four seconds from second one on."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, d).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    grids = e.select("user_id").distinct().withColumns({"bpm": F.lit(15.0), "anchor": F.lit(1.0)})
    return rhythm.resolved_phase(e, grids, ["user_id"], "idx", "value", 0.5, 1.2).select("user_id", "shifted", F.round("anchor", 9).alias("anchor"))


@query("mth11_estimated_tempo", None)
def mth11(spark: SparkSession, d: str) -> DataFrame:
    o = onsets(spark, d)
    kicks = events(spark, d).where("event_type = 'click'").select("user_id", ((F.col("us") - T0) / HOUR).alias("k"))
    out = rhythm.estimated(o, kicks, ["user_id"], "t", "strength", "k", [2.0, 2.5, 3.0, 5.0], 1.0, 8.0, 1.0, 0.02, 9)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("bpm", "anchor", "contrast", "recall", "precision", "factor")])


@query(
    "mth12_window_phase",
    f"""WITH p AS (SELECT user_id, CAST(floor((us - {T0}) / {10 * DAY}.0E0) AS BIGINT) AS win, least(47, CAST(floor((us % {DAY}) / {DAY}.0E0 * 48) AS INTEGER)) AS p, round(sum(strength), 9) AS s FROM {{ev}} GROUP BY 1, 2, 3)
SELECT user_id, win, arg_max(p, s * 100000 - p / 1000.0E0) AS phase, round(CASE WHEN sum(s) > 0 THEN max(s) * 48 / sum(s) ELSE 0 END, 6) AS contrast FROM p GROUP BY user_id, win""",
)
def mth12(spark: SparkSession, d: str) -> DataFrame:
    """The best of 48 phases of a day in each window of ten days."""
    e = events(spark, d).withColumn("win", F.floor((F.col("us") - T0) / (10 * DAY))).withColumn("t", F.col("us").cast("double"))
    out = signals.best_phase(e, ["user_id", "win"], "t", "strength", 24.0 * HOUR, 48)
    return out.select("user_id", "win", "phase", F.round("contrast", 6).alias("contrast"))


_MATRIX = [[((i * 7 + j * 3) % 11 - 5) / 5.0 for j in range(8)] for i in range(64)]
_MATRIX_SQL = "list_transform(range(0, 8), lambda j: list_transform(range(0, 64), lambda i: ((i * 7 + j * 3) % 11 - 5) / 5.0E0))"
_PROJECTED = f"""(SELECT vec_id, label, list_transform(o, lambda x: x / sqrt(list_dot_product(o, o))) AS p FROM (SELECT vec_id, label, list_transform({_MATRIX_SQL}, lambda c: list_dot_product(v, c) / sqrt(list_dot_product(v, v))) AS o
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))"""


@query("mth05_projection", f"SELECT vec_id, round(p[1], 6) AS first, round(p[8], 6) AS last FROM {_PROJECTED}")
def mth05(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "embeddings").withColumn("p", exprs.projected(F.col("embedding"), _MATRIX))
    return p.select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[7], 6).alias("last"))


@query("mth04_projected_cosine", f"WITH p AS {_PROJECTED} SELECT a.vec_id, round(greatest(0, least(1, (list_dot_product(a.p, b.p) + 1) / 2)), 6) AS score FROM p a JOIN p b ON b.vec_id = a.vec_id + 1")
def mth04(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next one, both projected."""
    p = read(spark, d, "embeddings").select("vec_id", exprs.projected(F.col("embedding"), _MATRIX).alias("p"))
    after = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return p.join(after, "vec_id").select("vec_id", F.round(exprs.cosine01(F.col("p"), F.col("q")), 6).alias("score"))


@query("mth18_band_pass", None)
def mth18(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values as a sound of a hundred samples a second, and the strength of its middle band."""
    s = F.sort_array(F.collect_list(F.struct("us", "event_id", "value")))
    c = events(spark, d).groupBy("user_id").agg(F.transform(s, lambda x: x["value"]).alias("c")).withColumn("rate", F.lit(100.0))
    out = signals.band_passed(c, "c", "rate", 10.0, 25.0, "y", 2)
    return out.select("user_id", F.round(F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size("y")), 3).alias("level"))


@query("win31_prominence_peaks", None)
def win31(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, d).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    return signals.prominence_peaks(e, ["user_id"], "idx", "value", 4, 50.0)


@query(
    "win40_hybrid_plan",
    f"""WITH RECURSIVE e AS (SELECT user_id, us, event_id, event_type, strength, round((us - {T0}) / 3600000000.0E0, 6) AS t FROM {{ev}}),
o AS MATERIALIZED (SELECT user_id, list(t ORDER BY t) AS beats, coalesce(list(t) FILTER (event_type = 'click'), []) AS downs, list(strength ORDER BY us, event_id) AS curve, max(t) AS total FROM e GROUP BY user_id),
k AS (SELECT user_id, CAST(NULL AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS energy, CAST(0 AS DOUBLE) AS strength FROM o
  UNION ALL SELECT user_id, now, greatest(CASE WHEN x <= now + 0.1::DOUBLE THEN now + 2 ELSE x END, now + 0.5::DOUBLE), level, snap FROM (
    SELECT *, CASE WHEN snap > 0 THEN near ELSE wanted END AS x FROM (
      SELECT *, CASE WHEN abs(near - wanted) < 1.6::DOUBLE AND near > now + 0.1::DOUBLE THEN CASE WHEN list_contains(downs, near) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END ELSE 0 END AS snap FROM (
        SELECT *, list_sort(list_transform(beats, lambda b: {{'d': abs(b - wanted), 'b': b}}))[1].b AS near FROM (
          SELECT *, now + greatest(2, least(16, 2 + 14 * greatest(0, least(1, 0.5::DOUBLE - level * 0.7::DOUBLE * 0.4::DOUBLE)))) AS wanted FROM (
            SELECT o.*, k.stop AS now, curve[least(CAST(floor(k.stop / total * len(curve)) AS BIGINT), len(curve) - 1) + 1] AS level FROM k JOIN o ON o.user_id = k.user_id WHERE k.stop < o.total))))))
SELECT user_id, round(start, 6) AS start, round(stop - start, 6) AS length, round(energy, 6) AS energy, strength > 0 AS aligned, strength,
  CASE WHEN energy < 0.3 THEN 'fade' WHEN energy <= 0.7 THEN 'crossfade' ELSE 'hard_cut' END AS transition,
  round(greatest(0, least(1, 0.5::DOUBLE + CASE WHEN strength > 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * (1 - abs(stop - start - 9) / 9))), 6) AS confidence FROM k WHERE start IS NOT NULL""",
)
def win40(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a timeline in hours: beats at events, downbeats at clicks, the strengths as energy."""
    o = events(spark, d).withColumn("t", F.round((F.col("us") - T0) / HOUR, 6))
    rows = o.groupBy("user_id").agg(
        F.sort_array(F.collect_list("t")).alias("beats"), F.array_sort(F.collect_set(F.when(F.col("event_type") == "click", F.col("t")))).alias("downbeats"),
        F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "strength"))), lambda x: x["strength"]).alias("energy"), F.max("t").alias("total"),
    )
    cuts = planners.hybrid_plan(rows, ["user_id"], "beats", "downbeats", "energy", "total", 2.0, 16.0, 3, 0.8, 0.7)
    return cuts.withColumns({c: F.round(c, 6) for c in ("start", "length", "energy", "confidence")})


@query(
    "jon34_nearest_window",
    "WITH w AS (SELECT user_id, us AS centre, min(value) AS tempo FROM {ev} WHERE event_type = 'click' AND value >= 60 GROUP BY 1, 2) SELECT e.event_id, arg_min(w.tempo, abs(w.centre - e.us) * 2 + CAST(w.centre > e.us AS INTEGER)) AS tempo FROM {ev} e LEFT JOIN w ON w.user_id = e.user_id GROUP BY e.event_id",
)
def jon34(spark: SparkSession, d: str) -> DataFrame:
    """The tempo of the nearest window whose grid is sure (a click of 60 or more); between two the earlier."""
    e = events(spark, d)
    valid = e.where("event_type = 'click' and value >= 60").groupBy("user_id", F.col("us").alias("centre")).agg(F.min("value").alias("tempo"))
    near = intervals.nearest(e.select("user_id", "event_id", "us"), valid.select("user_id", "centre"), ["user_id"], "us", "centre")
    return near.join(valid, ["user_id", "centre"], "left").select("event_id", "tempo")


@query(
    "src26_replacement_frames",
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {ev}),
o AS MATERIALIZED (SELECT t.user_id, t.idx // 5 AS n, coalesce(list(r.idx ORDER BY abs(r.idx - t.idx), r.idx) FILTER (r.idx IS NOT NULL), []) AS c
  FROM e t LEFT JOIN e r ON r.user_id = t.user_id AND r.value >= 50 AND abs(r.idx - t.idx) <= 6 WHERE t.idx % 5 = 0 GROUP BY ALL),
k AS (SELECT user_id, CAST(-1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, n, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
    SELECT o.user_id, o.n, used, list_filter(c, lambda x: NOT list_contains(used, x))[1] AS pick FROM k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1))
SELECT user_id, n, frame FROM k WHERE frame IS NOT NULL""",
)
def src26(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth event as a frame that is wanted; events of 50 and more can be read."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, d).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    wanted = e.where("idx % 5 = 0").select("user_id", (F.col("idx") / 5).cast("long").alias("n"), F.col("idx").alias("at"))
    return planners.replacements(wanted, e.where("value >= 50").select("user_id", F.col("idx").alias("frame")), ["user_id"], "n", "at", "frame", 6)


@query(
    "src15_peak_buckets",
    "SELECT vec_id, round(list_sum(list_transform(range(0, 10), lambda i: (i + 1) * list_max(list_transform(v[i * 6 + 1:i * 6 + 6], lambda x: abs(x))))), 5) AS weighted FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
)
def src15(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a short sound: peaks of ten buckets, summed with their numbers."""
    p = exprs.peak_buckets(F.col("embedding").cast("array<double>"), 10)
    rows = read(spark, d, "embeddings").select("vec_id", F.posexplode(p).alias("i", "x"))
    return rows.groupBy("vec_id").agg(F.round(F.sum((F.col("i") + 1) * F.col("x")), 5).alias("weighted"))


@query("udf05_fitted_pairs", None)
def udf05(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of each label, drawn so that a vector's projection meets the next vector."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, d, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 8).alias("a"), F.slice(F.lead("embedding").over(w), 1, 8).alias("b"))
    out = signals.fitted(e.withColumn("t", F.lit(1.0)), ["label"], "vec_id", "a", "b", "t", 0.05)
    trace = F.aggregate(F.sequence(F.lit(0), F.size("weights") - 1), F.lit(0.0), lambda s, i: s + F.col("weights")[i][i])
    return out.select("label", "steps", F.round(trace, 6).alias("trace"))


@query(
    "stm21_progress_blocks",
    """WITH l AS (SELECT user_id, us, event_id, event_type = 'purchase' AS closed, value FROM {ev}),
b AS (SELECT *, coalesce(sum(CASE WHEN closed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM l)
SELECT user_id, CAST(block AS BIGINT) AS block, bool_or(closed AND value >= 100) AS ended, arg_max(CAST(floor(value) AS BIGINT), event_id_order) FILTER (NOT closed) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS event_id_order FROM b) GROUP BY user_id, block HAVING bool_or(closed)""",
)
def stm21(spark: SparkSession, d: str) -> DataFrame:
    """Events as an encoder's lines: a purchase closes a block, with progress=end from 100 on; the others say frame=n."""
    e = events(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("progress="), F.when(F.col("value") >= 100, "end").otherwise("continue"))).otherwise(F.concat(F.lit(" frame= "), F.floor("value").cast("string")))
    b = windows.progress_blocks(e.select("user_id", "n", line.alias("line")), ["user_id"], "n", "line")
    return b.select("user_id", "block", "ended", F.col("values")["frame"].cast("long").alias("frame"))


@query("snk14_replaced_partition", "SELECT label, count(*) AS n, round(sum(CASE WHEN label = 2 THEN 2 ELSE 1 END * CAST(embedding[1] AS DOUBLE)), 5) AS total FROM embeddings GROUP BY label")
def snk14(spark: SparkSession, d: str) -> DataFrame:
    """A store partitioned by label, of which one partition is then replaced as a whole."""
    path = f"{windows.shared_folder(spark)}/store"
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), "label")
    e.write.partitionBy("label").parquet(path)
    again = e.where("label = 2").withColumn("x", F.col("x") * 2)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label").parquet(path)
    return spark.read.schema("vec_id long, x double, label int").parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("x"), 5).alias("total"))


@query("win35_novelty_peaks", None)
def win35(spark: SparkSession, d: str) -> DataFrame:
    """Novelty of each label's vectors, and its prominent peaks."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, d, "embeddings").withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    n = signals.novelty(e, ["label"], "idx", "embedding", 4).withColumn("novelty", F.round("novelty", 9))
    return signals.prominence_peaks(n, ["label"], "idx", "novelty", 4, 0.05)


# --- files in the shared folder, written and read again ---


@query("src20_content_hashes", "SELECT p_size, sha256(string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10)) AS h FROM part GROUP BY p_size")
def src20(spark: SparkSession, d: str) -> DataFrame:
    """One text file of names per size, and the digest of each file."""
    path = f"{windows.shared_folder(spark)}/names"
    p = read(spark, d, "part").select("p_partkey", "p_size", F.col("p_name").alias("value"))
    p.repartition("p_size").sortWithinPartitions("p_size", "p_partkey").select("p_size", "value").write.partitionBy("p_size").text(path)
    h = files.content_hashes(spark, path)
    return h.select(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("p_size"), F.col("sha256").alias("h"))


@query("snk13_published_snapshot", "SELECT p_partkey, p_size + 1 AS p_size FROM part")
def snk13(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots, of which readers see the later."""
    path = f"{windows.shared_folder(spark)}/snapshots"
    p = read(spark, d, "part").select("p_partkey", "p_size")
    files.publish(p, path)
    files.publish(p.withColumn("p_size", F.col("p_size") + 1), path)
    return files.latest(spark, path)


@query("snk21_concat_script", r"SELECT unnest(['file ''' || replace(c_name, '#', '''\''''') || '''', 'duration ' || printf('%.3f', c_custkey / 8.0E0)]) AS line FROM customer")
def snk21(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a player's script over customers as clips, whose names get a quote."""
    path = f"{windows.shared_folder(spark)}/script"
    c = read(spark, d, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("'")).alias("file"), (F.col("c_custkey") / 8).alias("length"))
    files.concat_script(c, "c_custkey", "file", "length", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("jsn02_packed_above_threshold", "SELECT p_partkey, p_name || '|' || p_type AS t, length(p_name || '|' || p_type) > 20 AS packed FROM part")
def jsn02(spark: SparkSession, d: str) -> DataFrame:
    """Texts of over twenty characters travel as gzip and base64; all come back."""
    t = F.concat_ws("|", "p_name", "p_type")
    p = read(spark, d, "part").select("p_partkey", files.encoded(t, 20).alias("stored"))
    return p.select("p_partkey", files.decoded(F.col("stored")).alias("t"), F.startswith("stored", F.lit("gz:")).alias("packed"))


# --- twins of audio operators over other series, and small keyed writes ---


@query(
    "jon05_video_units_with_metadata",
    "WITH t AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 8) AS DOUBLE[])) AS s FROM embeddings WHERE label <> 1 ORDER BY s DESC, vec_id LIMIT 30) SELECT t.vec_id, p.p_name, round(s, 6) AS score FROM t JOIN part p ON p.p_partkey = t.vec_id",
)
def jon05(spark: SparkSession, d: str) -> DataFrame:
    """The nearest units of the wanted kind with their names: the filter acts before the top k."""
    e = read(spark, d, "embeddings")
    top = scored(e.where("label <> 1"), "embedding", query_vector(e, "embedding", F.col("vec_id") == 8)).orderBy(F.desc("score"), "vec_id").limit(30)
    p = read(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), "p_name")
    return top.join(p, "vec_id").select("vec_id", "p_name", F.round("score", 6).alias("score"))


@query(
    "jon18_bass_at_span",
    "SELECT user_id, CAST(i AS INTEGER) AS i, 1 + least(1.0, c[CAST(floor(i / 10.0E0 * (len(c) - 1)) AS INTEGER) + 1]) AS v FROM (SELECT *, unnest(range(0, 11)) AS i FROM (SELECT user_id, list(strength ORDER BY us, event_id) AS c FROM {ev} WHERE event_type = 'view' GROUP BY user_id))",
)
def jon18(spark: SparkSession, d: str) -> DataFrame:
    """Positional lookup in the curve of one band."""
    s = F.sort_array(F.collect_list(F.struct("us", "event_id", "strength")))
    c = events(spark, d).where("event_type = 'view'").groupBy("user_id").agg(F.transform(s, lambda x: x["strength"]).alias("c"))
    c = c.select("user_id", "c", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    return c.select("user_id", "i", (1 + exprs.clip01(scoring.at_span(F.col("c"), F.col("i") / 10))).alias("v"))


@query("snk08_audio_units_appended", "SELECT label, count(*) AS n FROM (SELECT label FROM embeddings WHERE label < 5 UNION ALL SELECT label FROM embeddings WHERE label >= 5) GROUP BY label")
def snk08(spark: SparkSession, d: str) -> DataFrame:
    """A store and a batch of new units in one write, all of the store's dimension."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return stores.appended_vectors(v.where("label < 5"), v.where("label >= 5"), "embedding").groupBy("label").agg(F.count("*").alias("n"))


@query("snk10_linked_or_tombstoned", "SELECT vec_id, p_partkey IS NULL AS tombstoned FROM embeddings LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 25) ON p_partkey = vec_id")
def snk10(spark: SparkSession, d: str) -> DataFrame:
    links = read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("vec_id"))
    return stores.linked(read(spark, d, "embeddings").select("vec_id"), links, "vec_id")


@query("str20_sampled_digest", "SELECT vec_id, sha256(array_to_string(list_transform(range(0, 64, 8), lambda i: CAST(CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 256) AS BIGINT) AS VARCHAR)), ',')) AS h FROM embeddings")
def str20(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", ids.sampled_digest(F.col("embedding"), 8).alias("h"))


@query("stm23_tumbling_counts", "SELECT user_id, CAST(i // 32 AS BIGINT) AS block, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM {ev}) GROUP BY ALL")
def stm23(spark: SparkSession, d: str) -> DataFrame:
    """Windows of thirty-two events, the last one as long as it is."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = blocks.by_size(events(spark, d).withColumn("idx", F.row_number().over(w) - 1), "idx", 32, ["user_id"])
    return e.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
