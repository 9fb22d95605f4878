"""Queries over feedback, vectors, catalogues, texts and generated grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs, text
from ..operators import catalog, learning, vectors
from ..sources.tables import EVENTS_SQL, events, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


# --- feedback learning: purchases and clicks count for, views and errors against ---

FEEDBACK_SQL = """(SELECT event_id, user_id, 'axis' || (event_id % 17) AS axis, ['', 'section=' || event_type, 'section=' || event_type || '|mood=' || CAST(user_id % 3 AS VARCHAR),
  'section=' || event_type || '|mood=' || CAST(user_id % 3 AS VARCHAR) || '|motion=' || CAST(user_id % 7 AS VARCHAR)] AS keys,
  CASE event_type WHEN 'purchase' THEN 1.0E0 WHEN 'click' THEN 0.5E0 ELSE 0.0E0 END AS pos, CASE event_type WHEN 'view' THEN 0.5E0 WHEN 'error' THEN 1.0E0 ELSE 0.0E0 END AS neg FROM {ev})"""
CREDIT_SQL = f"""(SELECT axis, CAST(level AS INTEGER) AS level, keys[level + 1] AS key, round(pos * w[level + 1], 6) AS positive, round(neg * w[level + 1], 6) AS negative
  FROM (SELECT *, unnest(range(0, 4)) AS level, [1.0E0, 0.8E0, 0.6E0, 0.4E0] AS w FROM {FEEDBACK_SQL}))"""
WEIGHTS_SQL = f"(SELECT axis, level, key, sum(positive) AS positive, sum(negative) AS negative FROM {CREDIT_SQL} GROUP BY axis, level, key)"


def feedback(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    keys = learning.context_keys({"section": F.col("event_type"), "mood": F.col("user_id") % 3, "motion": F.col("user_id") % 7})
    kind = F.col("event_type")
    return e.select(
        "event_id", "user_id", F.concat(F.lit("axis"), F.col("event_id") % 17).alias("axis"), keys.alias("keys"),
        F.when(kind == "purchase", 1.0).when(kind == "click", 0.5).otherwise(0.0).alias("pos"), F.when(kind == "view", 0.5).when(kind == "error", 1.0).otherwise(0.0).alias("neg"),
    )


def weight_table(spark: SparkSession, d: str) -> DataFrame:
    return learning.weights(learning.credit(feedback(spark, d), "axis", "keys", "pos", "neg"), "axis")


@query("prj14_context_keys", f"SELECT event_id, array_to_string(keys, ';') AS keys FROM {FEEDBACK_SQL}")
def prj14(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).select("event_id", F.array_join("keys", ";").alias("keys"))


@query("agg10_credit", f"SELECT axis, level, key, count(*) AS n FROM {CREDIT_SQL} WHERE positive + negative > 0 GROUP BY axis, level, key")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    c = learning.credit(feedback(spark, d), "axis", "keys", "pos", "neg")
    return c.where("positive + negative > 0").groupBy("axis", "level", "key").agg(F.count("*").alias("n"))


@query("agg11_weights", f"SELECT axis, level, key, round(positive, 4) AS positive, round(negative, 4) AS negative FROM {WEIGHTS_SQL}")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    return weight_table(spark, d).select("axis", "level", "key", F.round("positive", 4).alias("positive"), F.round("negative", 4).alias("negative"))


@query(
    "agg06_posterior",
    f"""WITH w AS {WEIGHTS_SQL}, c AS (SELECT *, unnest(range(0, 4)) AS level FROM {FEEDBACK_SQL}),
j AS (SELECT c.event_id, c.level, w.positive AS a, w.negative AS b FROM c LEFT JOIN w ON w.axis = c.axis AND w.level = c.level AND w.key = c.keys[c.level + 1])
SELECT event_id, round(coalesce(max_by((a + 1) / (a + b + 2), CASE WHEN a + b >= 10 THEN level END), 0.5), 6) AS mean,
  CAST(coalesce(max(CASE WHEN a + b >= 10 THEN level END), -1) AS INTEGER) AS mean_level,
  round(coalesce(max_by((a + 1) * (b + 1) / ((a + b + 2) * (a + b + 2) * (a + b + 3)), CASE WHEN a IS NOT NULL THEN level END), 1.0E0 / 12), 6) AS variance
FROM j GROUP BY event_id""",
)
def agg06(spark: SparkSession, d: str) -> DataFrame:
    out = learning.posterior(feedback(spark, d).select("event_id", "axis", "keys"), weight_table(spark, d), "axis", "keys")
    return out.select("event_id", F.round("mean", 6).alias("mean"), "mean_level", F.round("variance", 6).alias("variance"))


@query(
    "win25_most_uncertain",
    f"""WITH w AS {WEIGHTS_SQL}, v AS (SELECT axis, level, key, (positive + 1) * (negative + 1) / ((positive + negative + 2) * (positive + negative + 2) * (positive + negative + 3)) AS v FROM w),
r AS (SELECT axis, level, key, round(v, 9) AS variance FROM v)
SELECT axis, level, key, variance FROM r ORDER BY variance DESC, axis, level, key LIMIT 20""",
)
def uncertain(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("positive") + 1, F.col("negative") + 1
    v = weight_table(spark, d).select("axis", "level", "key", F.round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9).alias("variance"))
    return v.orderBy(F.desc("variance"), "axis", "level", "key").limit(20)


# --- vectors ---

DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"


@query("top01_inner_product", f"SELECT vec_id, round({DOT}, 6) AS score FROM embeddings WHERE label <> 3 AND vec_id <> 0 ORDER BY {DOT} DESC, vec_id LIMIT 10")
def top01(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = vectors.query_vector(e, "embedding", F.col("vec_id") == 0)
    return vectors.top_k(e, "embedding", q, 10, "vec_id", (F.col("label") != 3) & (F.col("vec_id") != 0)).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "top02_l2_post_filter",
    """WITH t AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS d FROM embeddings ORDER BY d, vec_id LIMIT 40)
SELECT vec_id, round(d, 6) AS distance FROM t WHERE label = 1""",
)
def top02(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = vectors.query_vector(e, "embedding", F.col("vec_id") == 0)
    return vectors.nearest_l2(e, "embedding", q, 40, "vec_id", F.col("label") == 1).select("vec_id", F.round("distance", 6).alias("distance"))


@query("top04_hybrid", f"SELECT vec_id, round(0.5 * {DOT} + 0.3 * (1 - abs(label - 4) / 10.0E0) + 0.2 * ((vec_id % 7) / 7.0E0), 6) AS score FROM embeddings ORDER BY 0.5 * {DOT} + 0.3 * (1 - abs(label - 4) / 10.0E0) + 0.2 * ((vec_id % 7) / 7.0E0) DESC, vec_id LIMIT 15")
def top04(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    s = vectors.scored(e, "embedding", vectors.query_vector(e, "embedding", F.col("vec_id") == 0), "cos")
    score = 0.5 * F.col("cos") + 0.3 * (1 - F.abs(F.col("label") - 4) / 10) + 0.2 * ((F.col("vec_id") % 7) / 7)
    return s.withColumn("s", score).orderBy(F.desc("s"), "vec_id").limit(15).select("vec_id", F.round("s", 6).alias("score"))


@query("top12_softmax", f"WITH s AS (SELECT vec_id, label, {DOT} AS s FROM embeddings), m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM s) SELECT vec_id, round(e / sum(e) OVER (PARTITION BY label), 9) AS p FROM m")
def top12(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    s = vectors.scored(e, "embedding", vectors.query_vector(e, "embedding", F.col("vec_id") == 0))
    return vectors.softmax(s, ["label"], "score").select("vec_id", F.round("p", 9).alias("p"))


@query("mth01_cosine01", "SELECT vec_id, round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) + 1) / 2, 6) AS c FROM embeddings")
def mth01(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = F.array(*[F.lit(x) for x in vectors.query_vector(e, "embedding", F.col("vec_id") == 0)])
    return e.select("vec_id", F.round(exprs.cosine01(F.col("embedding"), q), 6).alias("c"))


@query("mth03_unit_vectors", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM v")
def mth03(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("u", exprs.l2_normalised(F.col("embedding")))
    return e.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("mth07_interpolation", "SELECT vec_id, round(v[i + 1] + (v[least(i + 1, 63) + 1] - v[i + 1]) * (p - i), 6) AS y FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (vec_id % 130) / 2.0E0 AS p0, least((vec_id % 130) / 2.0E0, 63.0E0) AS p, CAST(floor(least((vec_id % 130) / 2.0E0, 63.0E0)) AS INTEGER) AS i FROM embeddings)")
def mth07(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", F.round(exprs.interpolated(F.col("v"), (F.col("vec_id") % 130) / 2), 6).alias("y"))


@query("mth19_fitted", "SELECT vec_id, CAST(80 AS INTEGER) AS size, round(CAST(embedding[64] AS DOUBLE), 6) AS at64, 0.0E0 AS at70 FROM embeddings")
def mth19(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("f", exprs.fitted(F.col("embedding"), 80))
    return e.select("vec_id", F.size("f").alias("size"), F.round(F.col("f")[63], 6).alias("at64"), F.col("f")[69].alias("at70"))


@query("agg22_centroids", "SELECT label, CAST(i AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, i")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("agg28_kmeans", None)
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Five clusters of the vectors, fitted on all of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = read(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=5, seed=42, maxIter=10).fit(v)
    return model.transform(v).groupBy("prediction").agg(F.count("*").alias("n"))


# --- catalogue ---


@query(
    "snk01_upsert_media",
    """WITH old AS (SELECT p_partkey AS id, p_brand AS hash, p_type AS ai, 'done' AS status FROM part WHERE p_partkey <= 1500),
new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE p_brand END AS hash FROM part WHERE p_partkey > 1000)
SELECT id, hash, ai, status FROM old WHERE id NOT IN (SELECT id FROM new)
UNION ALL SELECT n.id, n.hash, CASE WHEN n.hash = o.hash THEN o.ai END, CASE WHEN n.hash = o.hash THEN o.status ELSE 'new' END FROM new n LEFT JOIN old o ON o.id = n.id""",
)
def snk01(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    old = p.where("p_partkey <= 1500").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("hash"), F.col("p_type").alias("ai"), F.lit("done").alias("status"))
    new = p.where("p_partkey > 1000").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "changed").otherwise(F.col("p_brand")).alias("hash"))
    return catalog.upsert_media(old, new, ["id"], "hash", ["ai"], "status", "new")


@query(
    "snk02_keyed_upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS rev FROM customer""",
)
def snk02(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("rev"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("rev"))
    once = catalog.upsert(c, new, ["c_custkey"], "rev")
    return catalog.upsert(once, new, ["c_custkey"], "rev")  # again, to no effect


@query(
    "snk05_delete_cascade",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)",
)
def snk05(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "stm15_outcome",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'after' WHEN o_orderkey % 3 = 1 THEN 'before' ELSE 'conflict' END AS outcome FROM orders""",
)
def stm15(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    before, after = o, o.withColumn("v", F.col("v") + 1)
    current = o.withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 0).otherwise(7))
    return catalog.classify(current, before, after, ["o_orderkey"], "v")


@query(
    "prj40_violations",
    """SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, 'discount' AS rule FROM lineitem WHERE NOT coalesce(l_discount <= 0.09, false)
UNION ALL SELECT l_orderkey, l_linenumber, 'quantity' FROM lineitem WHERE NOT coalesce(l_quantity < 50, false))""",
)
def prj40(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    out = catalog.violations(li, "k", {"discount": F.col("l_discount") <= 0.09, "quantity": F.col("l_quantity") < 50})
    return out.select("k.*", "rule")


# --- text, tags, JSON, time ---

WORDS = {"greeting": ["hello", "hi "], "question": ["?"], "article": ["the ", "der ", "la "]}


@query(
    "str05_keyword_tags",
    """SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'hello') OR contains(lower(text), 'hi ') THEN 'greeting' END, CASE WHEN contains(lower(text), '?') THEN 'question' END,
CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), 'der ') OR contains(lower(text), 'la ') THEN 'article' END) AS tags FROM conversations""",
)
def str05(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.keyword_tags(F.col("text"), WORDS), ",").alias("tags"))


TOKENS_SQL = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@query("str06_stems", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter({TOKENS_SQL.format('p_name')}, lambda x: len(x) > 2), lambda x: x[1:5]))), ' ') AS stems FROM part")
def str06(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.array_join(text.stems(F.col("p_name")), " ").alias("stems"))


@query("str08_token_removal", f"SELECT p_partkey, array_to_string(list_filter({TOKENS_SQL.format('p_type')}, lambda x: x NOT IN ('standard', 'small')), ' ') AS kept FROM part")
def str08(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.without(F.col("p_type"), ["standard", "small"]).alias("kept"))


@query("str03_word_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents")
def str03(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\t\n\f\r ]+")).cast("long").alias("n"))


@query("str12_label_shares", "WITH s AS (SELECT user_id, event_type, round(100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 0) AS p FROM {ev} GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS rn FROM s) SELECT user_id, string_agg(event_type || ' (' || CAST(CAST(p AS INTEGER) AS VARCHAR) || '%)', ', ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY user_id")
def str12(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).groupBy("user_id", "event_type").count()
    c = c.withColumn("p", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("user_id")), 0))
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("p"), "event_type"))).where("rn <= 3")
    part = F.struct("rn", F.format_string("%s (%d%%)", "event_type", F.col("p").cast("int")).alias("s"))
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), ", ").alias("label"))


@query("agg14_frequent_tags", "WITH t AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM {ev} GROUP BY user_id, event_type) SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS tags FROM t WHERE n >= greatest(1, floor(total * 0.2)) GROUP BY user_id")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).groupBy("user_id", "event_type").count().withColumn("total", F.sum("count").over(Window.partitionBy("user_id")))
    c = c.where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("total") * 0.2)))
    return c.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("tags"))


@query("dat03_minutes_seconds", "SELECT event_id, printf('%02d:%02d', CAST(floor(value * 10 / 60) AS BIGINT), CAST(floor(value * 10) % 60 AS BIGINT)) AS at FROM events")
def dat03(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", exprs.mmss(F.col("value") * 10).alias("at"))


@query("dat06_progression", "SELECT event_id, unnest(range(0, CAST(ceil(value / 50) AS BIGINT))) AS step FROM events")
def dat06(spark: SparkSession, d: str) -> DataFrame:
    n = F.ceil(F.col("value") / 50)
    # a sequence down to -1 would hold two steps
    return events(spark, d).where(n > 0).select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("step"))


@query("src14_time_points", "SELECT event_id, CAST(i AS INTEGER) AS i, round(value * (i + 0.5) / 4, 6) AS at FROM (SELECT event_id, value, unnest(range(0, 4)) AS i FROM events)")
def src14(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "value", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return e.select("event_id", "i", F.round(F.col("value") * (F.col("i") + 0.5) / 4, 6).alias("at"))


@query("jsn01_blob_defaults", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.kind'), 'none') AS kind FROM events")
def jsn01(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k int, kind string")
    return events(spark, d).select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.coalesce(p["kind"], F.lit("none")).alias("kind"))


@query("stm04_aligned_windows", """WITH s AS (SELECT unnest(range(0, 720)) AS h), c AS (SELECT CAST(floor((us - 1704067200000000) / 3600000000.0E0) AS BIGINT) AS h, count(*) AS n, sum(value) AS v FROM {ev} WHERE event_type = 'error' GROUP BY 1)
SELECT s.h, coalesce(n, 0) AS n, round(coalesce(v, 0), 4) AS v FROM s LEFT JOIN c ON c.h = s.h""")
def stm04(spark: SparkSession, d: str) -> DataFrame:
    h = F.floor((F.col("us") - 1704067200000000) / 3_600_000_000)
    c = events(spark, d).where("event_type = 'error'").groupBy(h.alias("h")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return spark.range(720).withColumnRenamed("id", "h").join(c, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("v"))
