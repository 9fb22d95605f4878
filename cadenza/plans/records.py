"""Queries over records: packed and nested texts, edit lists, settings, units with metadata, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, ids, scoring, text
from ..operators import learning, signals, stores
from ..operators.vectors import query_vector, scored
from ..sources import files
from ..sources.tables import EVENTS_SQL, events, read
from ..streaming.windows import shared_folder
from .library import CREDIT_SQL, FEEDBACK_SQL, WEIGHTS_SQL, feedback, weight_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


@query("src17_probed_columns", "SELECT p_partkey, p_brand, CAST(NULL AS VARCHAR) IS NULL AS missing FROM part")
def src17(spark: SparkSession, d: str) -> DataFrame:
    p = files.existing_columns(read(spark, d, "part"), {"p_partkey": "long", "p_brand": "string", "p_owner": "string"})
    return p.select("p_partkey", "p_brand", F.col("p_owner").isNull().alias("missing"))


@query("src18_paths_below_keys", "SELECT p_partkey, '/m/' || replace(lower(p_brand), '#', '') || '|/m/x' || p_size || '|/n/' || p_partkey AS paths FROM part")
def src18(spark: SparkSession, d: str) -> DataFrame:
    """A nested record per part: paths below a path key at any depth, of which relative ones and those of other keys don't count."""
    doc = F.format_string(
        '{"clip":{"File_PATH":{"deep":["/m/%s",{"more":"/n//%d"}]},"other":"/o"},"paths":["rel/x","/m/./x%d"],"n":1}', F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), "p_partkey", "p_size"
    )
    return read(spark, d, "part").select("p_partkey", F.array_join(text.paths_below(doc, "path"), "|").alias("paths"))


@query("src19_packed_json", "SELECT event_id, '{\"type\":\"' || event_type || '\"}' AS j FROM events")
def src19(spark: SparkSession, d: str) -> DataFrame:
    """Packed and unpacked again: short texts stay plain, the others travel as gzip and base64."""
    j = F.format_string('{"type":"%s"}', "event_type")
    e = events(spark, d).select("event_id", files.encoded(j, 15).alias("j"))
    return e.select("event_id", files.decoded(F.col("j")).alias("j"))


@query("src21_unexpired", "SELECT event_id FROM {ev} WHERE (SELECT max(us) FROM {ev}) - us < 86400000000")
def src21(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    newest = e.agg(F.max("us").alias("now"))  # one row
    return files.unexpired(e.crossJoin(F.broadcast(newest)), "us", F.col("now"), 86_400_000_000).select("event_id")


@query("snk06_normalised_append", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, 1 AS unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < 2)")
def snk06(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").where("label < 2").withColumn("u", exprs.l2_normalised(F.col("embedding")))
    return v.select("vec_id", F.round(exprs.norm("embedding"), 6).alias("length"), F.round(exprs.norm("u")).cast("int").alias("unit"))


@query("snk16_scored_rows", """SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS metadata_json FROM {ev}""")
def snk16(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("metadata_json"))


@query("snk20_edit_list", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_type) AS INTEGER) AS n, event_type, round((us - 1704067200000000) / 1000000.0E0, 3) AS start, round((us - 1704067200000000) / 1000000.0E0 + 5, 3) AS \"end\" FROM {ev}")
def snk20(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).select("user_id", "event_type", ((F.col("us") - 1_704_067_200_000_000) / 1e6).alias("s"))
    return files.edit_list(c.withColumn("e", F.col("s") + 5), "user_id", "s", "e", "event_type").drop("length")


_NEW_CREDIT = CREDIT_SQL.replace(FEEDBACK_SQL, f"(SELECT * FROM {FEEDBACK_SQL} WHERE event_id < 500)")


@query("snk29_additive_upsert", f"SELECT axis, level, key, round(sum(positive), 4) AS positive FROM (SELECT axis, level, key, positive FROM {WEIGHTS_SQL} UNION ALL SELECT axis, level, key, positive FROM {_NEW_CREDIT}) GROUP BY axis, level, key")
def snk29(spark: SparkSession, d: str) -> DataFrame:
    """Stored sums plus those of new events: rows of both are added, none is read back and written."""
    new = learning.credit(feedback(spark, d).where("event_id < 500"), "axis", "keys", "pos", "neg")
    both = weight_table(spark, d).unionByName(new.select("axis", "level", "key", "positive", "negative"))
    return learning.weights(both, "axis").select("axis", "level", "key", F.round("positive", 4).alias("positive"))


@query(
    "snk30_reset",
    f"""WITH w AS (SELECT count(*) AS n, sum(positive) AS p FROM {WEIGHTS_SQL}), c AS (SELECT count(*) AS n FROM {FEEDBACK_SQL})
SELECT 'before' AS seen, w.n AS weights, round(p, 4) AS positive, c.n AS counter FROM w, c UNION ALL SELECT 'during', w.n, round(p, 4), c.n FROM w, c UNION ALL SELECT 'after', 0, 0, 0""",
)
def snk30(spark: SparkSession, d: str) -> DataFrame:
    """Weights and their counter, published together and emptied together; a reader that began before the reset keeps both old tables."""
    path = f"{shared_folder(spark)}/weights"
    counter = feedback(spark, d).agg(F.count("*").alias("n"))
    files.publish_tables({"weights": weight_table(spark, d), "counter": counter}, path)
    before, during = files.published(spark, path), files.published(spark, path)
    files.publish_tables({"weights": before["weights"].where("false"), "counter": before["counter"].select(F.lit(0).cast("long").alias("n"))}, path)
    out = None
    for seen, tables in (("before", before), ("during", during), ("after", files.published(spark, path))):
        w = tables["weights"].agg(F.count("*").alias("weights"), F.round(F.coalesce(F.sum("positive"), F.lit(0.0)), 4).alias("positive"))
        row = w.join(tables["counter"].select(F.col("n").alias("counter")), F.lit(True)).select(F.lit(seen).alias("seen"), "weights", "positive", "counter")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "agg08_posterior_level",
    f"""WITH w AS {WEIGHTS_SQL}, c AS (SELECT *, unnest(range(0, 4)) AS level FROM {FEEDBACK_SQL}),
j AS (SELECT c.event_id, c.level, w.positive + w.negative AS n FROM c LEFT JOIN w ON w.axis = c.axis AND w.level = c.level AND w.key = c.keys[c.level + 1])
SELECT event_id, CAST(coalesce(max(CASE WHEN n >= 10 THEN level END), -1) AS INTEGER) AS level, max(CASE WHEN n >= 10 THEN level END) IS NULL AS cold FROM j GROUP BY event_id""",
)
def agg08(spark: SparkSession, d: str) -> DataFrame:
    out = learning.posterior(feedback(spark, d).select("event_id", "axis", "keys"), weight_table(spark, d), "axis", "keys")
    return out.select("event_id", F.col("mean_level").alias("level"), (F.col("mean_level") == -1).alias("cold"))


@query(
    "jon04_units_with_metadata",
    "WITH t AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])) AS s FROM embeddings WHERE label <> 4 ORDER BY s DESC, vec_id LIMIT 30) SELECT t.vec_id, c.c_name, round(s, 6) AS score FROM t JOIN customer c ON c.c_custkey = t.vec_id",
)
def jon04(spark: SparkSession, d: str) -> DataFrame:
    """The nearest units of the wanted kind, with what is known of them: the filter acts before the top k."""
    e = read(spark, d, "embeddings")
    q = query_vector(e, "embedding", F.col("vec_id") == 3)
    top = scored(e.where("label <> 4"), "embedding", q).orderBy(F.desc("score"), "vec_id").limit(30)
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("vec_id"), "c_name")
    return top.join(c, "vec_id").select("vec_id", "c_name", F.round("score", 6).alias("score"))


@query("jon36_clips_with_defaults", "SELECT p_partkey, coalesce(v.label, -1) AS label, v.label IS NULL AS filled FROM part LEFT JOIN embeddings v ON v.vec_id = p_partkey WHERE p_size IN (1, 5, 9)")
def jon36(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), "label")
    p = read(spark, d, "part").where(F.col("p_size").isin(1, 5, 9)).select("p_partkey").join(v, "p_partkey", "left")
    return p.select("p_partkey", F.coalesce("label", F.lit(-1)).alias("label"), F.col("label").isNull().alias("filled"))


@query("mth06_checked_vectors", "SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 3 <> 0)")
def mth06(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the right size as unit vectors; those of another size are null and go."""
    e = read(spark, d, "embeddings").withColumn("e", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return e.withColumn("u", exprs.checked_unit(F.col("e"), 64)).where("u is not null").select("vec_id", F.round(F.col("u")[0], 6).alias("first"))


@query("prj30_theme", "SELECT event_id, CASE WHEN strength >= 0.58 THEN 'high' ELSE 'low' END || CAST(event_id % 3 AS VARCHAR) AS theme FROM {ev}")
def prj30(spark: SparkSession, d: str) -> DataFrame:
    """A theme of the energy's side; the draw among three is by a hash of the id, here the id itself."""
    return events(spark, d).select("event_id", F.concat(scoring.bucket(F.col("strength"), [0.58], ["low", "high"]), (F.col("event_id") % 3).cast("string")).alias("theme"))


@query("udf12_scenes_or_whole", "SELECT user_id, us AS start_us, 'scene' AS kind FROM {ev} WHERE event_type = 'signup' AND value > 400 UNION ALL SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'whole' FROM {ev} WHERE user_id NOT IN (SELECT user_id FROM {ev} WHERE event_type = 'signup' AND value > 400)")
def udf12(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of each series; one without any is a single scene."""
    e = events(spark, d)
    s = e.where("event_type = 'signup' and value > 400").select("user_id", F.col("us").alias("start_us"), F.lit("scene").alias("kind"))
    whole = e.select("user_id").distinct().join(s.select("user_id"), "user_id", "left_anti")
    return s.unionByName(whole.select("user_id", F.lit(0).cast("long").alias("start_us"), F.lit("whole").alias("kind")))


@query("udf14_ward_clusters", None)
def udf14(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each label's vectors by Ward's criterion."""
    return signals.ward_clusters(read(spark, d, "embeddings"), ["label"], "vec_id", "embedding").select("vec_id", "label", "cluster")


@query("jsn03_decoded_by_kind", "SELECT event_id, CASE WHEN event_type = 'view' THEN coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) ELSE -1 END AS k FROM {ev}")
def jsn03(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_type") == "view", F.from_json("props", "k int"))
    return events(spark, d).select("event_id", F.when(F.col("event_type") == "view", F.coalesce(p["k"], F.lit(0))).otherwise(-1).alias("k"))


@query("stm14_recovered", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'replay' ELSE 'done' END AS action FROM orders WHERE o_orderstatus <> 'F'")
def stm14(spark: SparkSession, d: str) -> DataFrame:
    """Pending operations: one whose effect stands is done, the others are run again."""
    o = read(spark, d, "orders").where("o_orderstatus <> 'F'")
    effect = o.where("o_orderkey % 2 = 1").select("o_orderkey", F.lit("done").alias("seen"))
    return o.select("o_orderkey").join(effect, "o_orderkey", "left").select("o_orderkey", F.coalesce("seen", F.lit("replay")).alias("action"))


@query("str15_path_job_hash", "SELECT p_partkey, sha256(p_brand || '|/x/' || lower(p_type) || '|' || p_size) AS h FROM part")
def str15(spark: SparkSession, d: str) -> DataFrame:
    h = ids.job_hash(F.col("p_brand"), F.concat(F.lit("/X//"), F.col("p_type")), F.col("p_size"), path=1)
    return read(spark, d, "part").select("p_partkey", h.alias("h"))


@query("snk07_all_or_nothing", "SELECT count(*) AS n FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings WHERE label = 2)")
def snk07(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return stores.appended_vectors(v, v.where("label = 2"), "embedding").agg(F.count("*").alias("n"))
