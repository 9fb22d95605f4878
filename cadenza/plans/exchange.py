"""Queries over files that Spark writes and reads again: arrays, canvases, progress lines; and exact rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fractions
from ..sources import arrays, canvas, progress
from ..sources.tables import EVENTS_SQL, events, read
from ..streaming import windows

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


@query("src07_array_files", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS total FROM embeddings")
def src07(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as array files of a thousand ids, and read again by ranges of 300 rows."""
    e = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 1000).alias("file"), "vec_id", F.array_insert(F.col("embedding").cast("array<double>"), 1, F.col("vec_id").cast("double")).alias("v"))
    made = arrays.write_npy(e, "file", "vec_id", "v", f"{windows.shared_folder(spark)}/arrays", "float64")
    arrays.register(spark)
    back = spark.read.format("npy").option("rows", 300).load(",".join(r.path for r in made.select("path").collect()))  # one path a file
    v = F.slice("values", 2, F.size("values") - 1)
    total = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("values")[0].cast("long").alias("vec_id"), F.size(v).cast("long").alias("n"), F.round(total, 4).alias("total"))


#: Customers of a canvas.
CANVAS = 100

_CANVAS_SQL = f"""c AS (SELECT c_custkey // {CANVAS} AS canvas, c_custkey % {CANVAS} AS pos, c_custkey AS k, floor(c_acctbal) AS bal FROM customer),
t AS (SELECT canvas, pos, pos * 10.0 - pos % 3 * 10 AS x, pos * 7 AS s FROM c WHERE pos % 10 = 0 AND pos % 40 <> 30),
a AS (SELECT canvas, x, min_by(s, pos)::DOUBLE AS here, max_by(s, pos)::DOUBLE AS on_ FROM t GROUP BY ALL),
u AS (SELECT canvas, min(x) AS low, max(x) AS high FROM t GROUP BY canvas HAVING count(*) >= 2),
p AS (SELECT p_partkey AS clip, lower('/media/' || p_brand || '/clip_' || p_partkey || '.mp4') AS path, 'clip_' || p_partkey AS stem, CASE WHEN p_size % 7 = 0 THEN 5.0 ELSE p_size % 7 END AS len FROM part),
f AS (SELECT canvas, pos, pos * 10.0 + bal % 5 - 20 AS x, CASE k % 3 WHEN 0 THEN 'clip_' || (k % 61) WHEN 1 THEN 'brand#' || (k % 30) || '/clip_' ELSE 'ip_' || (k % 47) || '.m' END AS name FROM c WHERE pos % 10 <> 0 AND bal % 11 <> 3),
n AS (SELECT DISTINCT name, CASE WHEN contains(name, '/') THEN 'clip_' WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE name END AS stem FROM f),
m AS (SELECT n.name, coalesce((SELECT max(clip) FROM p WHERE p.stem = n.stem), (SELECT min(clip) FROM p WHERE contains(p.path, n.stem))) AS clip FROM n),
g AS (SELECT f.canvas, f.pos, f.x, m.clip, p.len, u.low, u.high FROM f JOIN u USING (canvas) JOIN m USING (name) JOIN p ON p.clip = m.clip),
b AS (SELECT g.canvas, g.pos, any_value(g.clip) AS clip, any_value(len) AS len, any_value(g.x) AS x, any_value(low) AS low, any_value(high) AS high,
  max(a.x) FILTER (a.x <= g.x) AS ax, arg_max(a.on_, a.x) FILTER (a.x <= g.x) AS a_on, arg_max(a.here, a.x) FILTER (a.x <= g.x) AS a_here, min(a.x) FILTER (a.x >= g.x) AS bx, arg_min(a.here, a.x) FILTER (a.x >= g.x) AS b_here
  FROM g JOIN a ON a.canvas = g.canvas GROUP BY g.canvas, g.pos),
i AS (SELECT canvas, clip, pos, len, CASE WHEN x <= low THEN b_here WHEN x >= high THEN a_on WHEN ax = x THEN a_here ELSE a_on + (b_here - a_on) * (x - ax) / (bx - ax) END AS spot FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY canvas ORDER BY spot, pos) AS rn FROM i)"""


@query(
    "src16_canvas_clips",
    f"""WITH RECURSIVE {_CANVAS_SQL},
r AS (SELECT canvas, rn, pos, clip, spot::DOUBLE AS start, (spot + len)::DOUBLE AS stop FROM o WHERE rn = 1
  UNION ALL SELECT o.canvas, o.rn, o.pos, o.clip, greatest(o.spot, r.stop), greatest(o.spot, r.stop) + o.len FROM r JOIN o ON o.canvas = r.canvas AND o.rn = r.rn + 1)
SELECT 'c' || canvas AS canvas, CAST(pos AS INTEGER) AS pos, clip, round(start, 6) AS start, round(stop, 6) AS "end" FROM r""",
)
def src16(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nodes of canvases, written as JSON, read again, and laid on a timeline of parts as clips."""
    pos, k, bal = F.col("c_custkey") % CANVAS, F.col("c_custkey"), F.floor("c_acctbal")
    timed = pos % 10 == 0
    s = pos * 7
    # every fourth anchor has no valid seconds
    text = F.when(pos % 40 == 30, F.concat(F.lit("take @"), F.floor(s / 60), F.lit(":75"))).otherwise(F.format_string("scene @%d:%02d in", F.floor(s / 60), (s % 60).cast("int")))
    file = (
        F.when(k % 3 == 0, F.concat(F.lit("Lib/CLIP_"), k % 61, F.lit(".mov")))
        .when(k % 3 == 1, F.concat(F.lit("brand#"), k % 30, F.lit("/clip_.mp4")))
        .otherwise(F.concat(F.lit("x\\ip_"), k % 47, F.lit(".mp4")))
    )
    node = F.struct(
        k.cast("string").alias("id"), F.when(timed, "text").otherwise("file").alias("type"), F.when(timed, text).alias("text"), F.when(~timed, file).alias("file"),
        F.when(timed, pos * 10.0 - pos % 3 * 10).otherwise(pos * 10.0 + bal % 5 - 20).alias("x"), F.when(~timed & (bal % 11 == 3), 520.0).otherwise(0.0).alias("y"),
    )
    rows = read(spark, d, "customer").select(F.concat(F.lit("c"), F.floor(k / CANVAS)).alias("canvas"), pos.alias("pos"), node.alias("n"))
    # a canvas holds CANVAS nodes
    lines = rows.groupBy("canvas").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("l")).select(F.to_json(F.struct("canvas", F.transform("l", lambda x: x["n"]).alias("nodes"))).alias("value"))
    path = f"{windows.shared_folder(spark)}/canvases"
    lines.write.text(path)
    clips = read(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("clip"), F.concat(F.lit("/media/"), "p_brand", F.lit("/clip_"), "p_partkey", F.lit(".MP4")).alias("path"), (F.col("p_size") % 7).alias("duration"))
    out = canvas.placed_clips(canvas.nodes(spark, path, multi_line=False), clips, "p_partkey")
    return out.select("canvas", "pos", "clip", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "dat05_price_rates",
    """WITH RECURSIVE v AS (SELECT DISTINCT CAST(round(l_extendedprice * 100) AS BIGINT) AS n, CAST(round(l_quantity * 100) AS BIGINT) * 7 AS d FROM lineitem),
g AS (SELECT n, d, 0::BIGINT AS p0, 1::BIGINT AS q0, 1::BIGINT AS p1, 0::BIGINT AS q1, n AS x, d AS y, 0 AS i FROM v
  UNION ALL SELECT n, d, p1, q1, p0 + x // y * p1, q0 + x // y * q1, y, x % y, i + 1 FROM g WHERE y > 0 AND q0 + x // y * q1 <= 1000),
l AS (SELECT DISTINCT ON (n, d) * FROM g ORDER BY n, d, i DESC),
r AS (SELECT n, d, p1, q1, p0 + (1000 - q0) // q1 * p1 AS p2, q0 + (1000 - q0) // q1 * q1 AS q2, y FROM l),
b AS (SELECT n, d, CASE WHEN y = 0 OR abs(p1::HUGEINT * d - n::HUGEINT * q1) * q2 <= abs(p2::HUGEINT * d - n::HUGEINT * q2) * q1 THEN p1 ELSE p2 END AS num,
  CASE WHEN y = 0 OR abs(p1::HUGEINT * d - n::HUGEINT * q1) * q2 <= abs(p2::HUGEINT * d - n::HUGEINT * q2) * q1 THEN q1 ELSE q2 END AS den FROM r)
SELECT l_orderkey, l_linenumber, num, den FROM lineitem JOIN b ON b.n = CAST(round(l_extendedprice * 100) AS BIGINT) AND b.d = CAST(round(l_quantity * 100) AS BIGINT) * 7""",
)
def dat05(spark: SparkSession, d: str) -> DataFrame:
    """A seventh of each line's price for a piece as the nearest fraction with a denominator of up to a thousand."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    rate = fractions.nearest_fraction(cents("l_extendedprice"), cents("l_quantity") * 7, 1000)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("r")).select("l_orderkey", "l_linenumber", F.col("r.num").alias("num"), F.col("r.den").alias("den"))


@query(
    "stm22_polled_progress",
    """WITH l AS (SELECT user_id % 16 AS file, us, event_id, event_type = 'purchase' AS closed, value FROM {ev}),
b AS (SELECT *, row_number() OVER w AS n, coalesce(sum(CASE WHEN closed THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM l WINDOW w AS (PARTITION BY file ORDER BY us, event_id))
SELECT file, CAST(block AS BIGINT) AS block, bool_or(closed AND value >= 100) AS ended, arg_max(CAST(floor(value) AS BIGINT), n) FILTER (NOT closed) AS frame FROM b GROUP BY file, block HAVING bool_or(closed)""",
)
def stm22(spark: SparkSession, d: str) -> DataFrame:
    """Progress lines in 16 files, polled as a stream, and their blocks."""
    e = events(spark, d)
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("progress="), F.when(F.col("value") >= 100, "end").otherwise("continue"))).otherwise(F.concat(F.lit(" frame= "), F.floor("value").cast("string")))
    rows = e.select((F.col("user_id") % 16).alias("file"), "us", "event_id", line.alias("value"))
    path = f"{windows.shared_folder(spark)}/lines"
    rows.repartition(16, "file").sortWithinPartitions("file", "us", "event_id").select("file", "value").write.partitionBy("file").text(path)
    progress.register(spark)
    polled = windows.run_available(spark.readStream.format("lines").option("rangeBytes", 1 << 16).load(path), "append")
    polled = polled.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"), "at", "line")
    b = windows.progress_blocks(polled, ["file"], "at", "line")
    return b.select("file", "block", "ended", F.col("values")["frame"].cast("long").alias("frame"))
