"""Queries over long series: sections and novelty of curves, pairs that train two matrices, sound files at another rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boundaries, composer, learning, spans
from ..sources import audio
from ..sources.tables import EVENTS_SQL, events, read
from ..streaming.windows import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{ev}", EVENTS_SQL)
        return f

    return add


def curve(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values in order of time, numbered from 0."""
    return spans.numbered(events(spark, d).select("user_id", "us", "event_id", "value"), ["user_id"], ["us", "event_id"])


CURVE_SQL = "(SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM {ev})"
#: Seconds of a sample of the curves: they are smoothed by 2 samples, compared over 8, and parted by 15 at least.
STEP = 1.0


@query(
    "win08_contrasts",
    f"""WITH c AS (SELECT * FROM {CURVE_SQL}), n AS (SELECT user_id, count(*) AS n, min_by(value, idx) AS first FROM c GROUP BY user_id),
s AS (SELECT user_id, idx, n, (value + coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY idx), first)) / 2 AS s FROM c JOIN n USING (user_id)),
m AS (SELECT *, avg(s) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l, avg(s) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS r FROM s)
SELECT user_id, idx, round(s, 6) AS smoothed, CASE WHEN idx >= 8 AND idx < n - 8 THEN round(l, 6) END AS before, CASE WHEN idx >= 8 AND idx < n - 8 THEN round(r, 6) END AS after FROM m""",
)
def win08_contrasts(spark: SparkSession, d: str) -> DataFrame:
    smooth, context, _ = boundaries.widths(STEP)
    c = boundaries.contrasts(curve(spark, d), ["user_id"], "idx", "value", smooth, context)
    return c.select("user_id", "idx", F.round("smoothed", 6).alias("smoothed"), F.round("left", 6).alias("before"), F.round("right", 6).alias("after"))


_SECTIONS = f"""WITH RECURSIVE c AS (SELECT * FROM {CURVE_SQL}), n AS (SELECT user_id, count(*) AS n, min_by(value, idx) AS first FROM c GROUP BY user_id),
s AS MATERIALIZED (SELECT user_id, idx, n, (value + coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY idx), first)) / 2 AS s FROM c JOIN n USING (user_id)),
t AS (SELECT user_id, any_value(n) AS n, greatest(max(s) - min(s), 1e-8) AS scale, greatest((max(s) - min(s)) * 0.15, stddev_pop(s) * 0.35, 1e-8) AS least, greatest(0.08 * greatest(max(s), 1e-8), avg(s) * 0.25) AS quiet FROM s GROUP BY user_id),
m AS (SELECT user_id, idx, n, avg(s) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l, avg(s) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS r FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
d AS (SELECT user_id, idx, l, r, abs(r - l) AS m FROM m WHERE idx >= 8 AND idx < n - 8),
p AS (SELECT *, lag(m) OVER w AS before, lead(m) OVER w AS after FROM d WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
o AS MATERIALIZED (SELECT p.user_id, idx, l, r, m / scale AS strength, row_number() OVER (PARTITION BY p.user_id ORDER BY m / scale DESC, idx DESC) AS rn FROM p JOIN t USING (user_id) WHERE m >= least AND m >= coalesce(before, 0) AND m >= coalesce(after, 0)),
k AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM t
  UNION ALL SELECT o.user_id, o.rn, CASE WHEN len(list_filter(kept, lambda x: abs(x - o.idx) < 15)) = 0 THEN list_append(kept, o.idx) ELSE kept END FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1),
b AS (SELECT user_id, unnest(list_prepend(0, max_by(kept, rn))) AS a FROM k GROUP BY user_id),
g AS (SELECT b.user_id, a, coalesce(lead(a) OVER (PARTITION BY b.user_id ORDER BY a), n) AS z, row_number() OVER (PARTITION BY b.user_id ORDER BY a) - 1 AS section FROM b JOIN t USING (user_id)),
e AS (SELECT g.user_id, section, a, z, avg(s.s) AS energy FROM g JOIN s ON s.user_id = g.user_id AND s.idx >= a AND s.idx < z GROUP BY ALL),
f AS (SELECT e.*, t.n, least, quiet, x.strength AS own, y.strength AS next, y.l, y.r, lag(energy) OVER (PARTITION BY e.user_id ORDER BY section) AS prior FROM e JOIN t USING (user_id) LEFT JOIN o x ON x.user_id = e.user_id AND x.idx = e.a AND a > 0 LEFT JOIN o y ON y.user_id = e.user_id AND y.idx = e.z)
SELECT user_id, CAST(section AS INTEGER) AS section, a AS "first", z AS "last", CASE WHEN z = n AND energy <= quiet AND prior >= energy + least THEN 'outro' WHEN a = 0 AND l <= quiet AND r >= l + least THEN 'intro' ELSE 'section' END AS label,
  round(energy, 9) AS energy, round(greatest(CASE WHEN own IS NULL THEN 0 ELSE least(own, 1) END, CASE WHEN next IS NULL THEN 0 ELSE least(next, 1) END), 9) AS confidence FROM f"""


def _rounded(name: str):
    """Nine digits as DuckDB rounds them, by the product with 1e9: round() goes by the printed digits, where a mean that ends in a half may lie a last bit below it."""
    c = F.col(name)
    units = F.abs(c) * 1e9
    whole = F.floor(units)
    up = F.when(units - whole >= 0.5, 1).otherwise(0)
    return F.when(F.abs(c) < 1e6, F.signum(c) * (whole + up) / 1e9).otherwise(F.round(c, 9))


@query("win08_sections", _SECTIONS)
def win08_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each user's values, with their labels."""
    s = boundaries.sections(curve(spark, d), ["user_id"], "idx", "value", STEP)
    return s.select("user_id", "section", "first", "last", "label", _rounded("energy").alias("energy"), _rounded("confidence").alias("confidence"))


KERNEL = 16


def _series(spark: SparkSession, d: str) -> DataFrame:
    return spans.numbered(read(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"])


_SERIES_SQL = "(SELECT label, embedding, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM embeddings)"
_UNIT_SQL = f"""e AS (SELECT label, n, idx, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM {_SERIES_SQL}),
u AS MATERIALIZED (SELECT label, n, idx, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label, idx)) AS x FROM e),
k AS (SELECT k, CASE WHEN k < {KERNEL // 2} THEN -1 ELSE 1 END AS side, exp(-power(k - {(KERNEL - 1) / 2}, 2) / {2 * (KERNEL / 4) ** 2}) AS g FROM range({KERNEL}) t(k))"""


@query(
    "win35_tapered_novelty",
    f"""WITH {_UNIT_SQL},
p AS (SELECT label, n, idx, k, side * g AS w, least(greatest(idx + k - {KERNEL // 2}, 0), n - 1) AS at FROM (SELECT DISTINCT label, n, idx FROM u), k),
d AS (SELECT p.label, p.idx, u.dim, sum(p.w * u.x) AS s FROM p JOIN u ON u.label = p.label AND u.idx = p.at GROUP BY ALL)
SELECT label, idx, round(sum(s * s), 6) AS novelty FROM d GROUP BY ALL""",
)
def win35_tapered(spark: SparkSession, d: str) -> DataFrame:
    """Novelty of each label's vectors under a Gaussian checkerboard, with the ends repeated."""
    n = boundaries.kernel_novelty(_series(spark, d), ["label"], "idx", "embedding", boundaries.tapered(KERNEL))
    return n.select("label", "idx", F.round("novelty", 6).alias("novelty"))


@query(
    "win09_checkerboard_novelty",
    f"""WITH {_UNIT_SQL},
p AS (SELECT label, n, idx, k, side, idx + k - {KERNEL // 2} AS at FROM (SELECT DISTINCT label, n, idx FROM u), k WHERE idx >= {KERNEL // 2} AND idx < n - {KERNEL // 2}),
d AS (SELECT p.label, p.idx, u.dim, sum(p.side * u.x) AS s FROM p JOIN u ON u.label = p.label AND u.idx = p.at GROUP BY ALL)
SELECT label, idx, round(coalesce(novelty, 0), 6) AS novelty FROM (SELECT DISTINCT label, idx FROM u) LEFT JOIN (SELECT label, idx, sum(s * s) AS novelty FROM d GROUP BY ALL) USING (label, idx)""",
)
def win09_checkerboard(spark: SparkSession, d: str) -> DataFrame:
    """The same with a flat kernel, which has no value near the ends."""
    flat = [-1.0] * (KERNEL // 2) + [1.0] * (KERNEL // 2)
    n = boundaries.kernel_novelty(_series(spark, d), ["label"], "idx", "embedding", flat, padded=False)
    return n.select("label", "idx", F.round("novelty", 6).alias("novelty"))


@query("udf05_joint_matrices", None)
def udf05_joint(spark: SparkSession, d: str) -> DataFrame:
    """Two matrices of each label, trained in three passes on vectors and their successors."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = read(spark, d, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 8).alias("x"), F.slice(F.lead("embedding").over(w), 9, 6).alias("y"))
    out = learning.pair_passes(e.withColumn("t", (F.col("vec_id") % 5 - 2) / 2), ["label"], ["vec_id"], "x", "y", "t", (8, 6, 4), 0.05, 3)
    trace = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, i: s + F.col(m)[i][i])
    r = lambda c, name: F.round(c, 6).alias(name)
    return out.select("label", "n_pairs", r(F.col("loss_before"), "loss_before"), r(F.col("loss_after"), "loss_after"), r(trace("x_matrix"), "x_trace"), r(trace("y_matrix"), "y_trace"))


#: Events of a sound file; rates of the files and of what is read from them; seconds of a window and of its overlap.
FRAMES = 4000
NATIVE, RATE = 1000, 735
LENGTH, OVERLAP = 1.0, 0.25

_SOUND_SQL = f"""e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS i, strength FROM {{ev}}),
s AS MATERIALIZED (SELECT event_type || '-' || (i // {FRAMES}) AS name, i % {FRAMES} AS n, least(floor(strength * 32768 + 0.5::DOUBLE), 32767) / 32768 AS x FROM e),
f AS (SELECT name, count(*) AS frames FROM s GROUP BY name)"""


def _window_sql(rate: int) -> str:
    size, hop = round(LENGTH * rate), round((LENGTH - OVERLAP) * rate)
    return f"""w AS (SELECT name, unnest(range(0, 1 + CASE WHEN frames > {size} THEN CAST(ceil((frames - {size}) / {hop}.0) AS BIGINT) ELSE 0 END)) AS number FROM o)
SELECT w.name, CAST(number AS INTEGER) AS number, round(number * {hop} / {rate}.0::DOUBLE, 6) AS start_s, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * (y.n - number * {hop} + 1)), 4) AS weighted
FROM w JOIN y ON y.name = w.name AND y.n >= number * {hop} AND y.n < number * {hop} + {size} GROUP BY ALL"""


def sounds(spark: SparkSession, d: str, width: int = 2) -> list[str]:
    """Sound files of the events' strengths, one for each type and each FRAMES of its events; their paths."""
    e = spans.numbered(events(spark, d).select("event_type", "us", "event_id", "strength"), ["event_type"], ["us", "event_id"])
    e = e.select(F.concat_ws("-", "event_type", F.floor(F.col("idx") / FRAMES)).alias("name"), "idx", "strength")
    written = audio.write_pcm(e, "name", "idx", ["strength"], f"{shared_folder(spark)}/sounds", NATIVE, width)
    return [r.path for r in written.select("path").collect()]  # one for each file


def _windows(spark: SparkSession, paths: list[str], rate: int) -> DataFrame:
    audio.register(spark)
    w = spark.read.format("pcm").option("window", LENGTH).option("overlap", OVERLAP).option("rate", rate).load(",".join(paths))
    x = F.transform("samples", lambda v: v.cast("double"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return w.select(
        F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), F.col("window").alias("number"), F.round("start_s", 6).alias("start_s"), F.size("samples").cast("long").alias("n"),
        F.round(add(x), 6).alias("total"), F.round(add(F.transform(x, lambda v, i: v * (i + 1))), 4).alias("weighted"),
    )


@query("src09_sound_windows", f"WITH {_SOUND_SQL}, o AS (SELECT * FROM f), y AS (SELECT * FROM s), {_window_sql(NATIVE)}")
def src09(spark: SparkSession, d: str) -> DataFrame:
    """Windows of sound files as they are written."""
    return _windows(spark, sounds(spark, d), NATIVE)


_HALF = -(-audio.CROSSINGS * 10_000 // round(RATE / NATIVE * audio.ROLL_OFF * 10_000))
_CUT = RATE / NATIVE * audio.ROLL_OFF
_RESAMPLED_SQL = f"""o AS (SELECT name, CAST(ceil(frames * {RATE} / {NATIVE}.0) AS BIGINT) AS frames FROM f),
m AS (SELECT name, unnest(range(0, frames)) AS m FROM o),
t AS (SELECT name, m, m * {NATIVE} // {RATE} + k AS tap, ((m * {NATIVE}) % {RATE}) / {RATE}.0::DOUBLE - k AS t FROM m, range({1 - _HALF}, {_HALF + 1}) r(k)),
h AS (SELECT name, m, tap, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * {_CUT!r}::DOUBLE * t) / (pi() * {_CUT!r}::DOUBLE * t) END * CASE WHEN abs(t) < {_HALF} THEN 0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * t / {_HALF}) ELSE 0 END AS h FROM t),
y AS MATERIALIZED (SELECT h.name, h.m AS n, CAST(CAST(sum(h * coalesce(x, 0)) / sum(h) AS FLOAT) AS DOUBLE) AS x FROM h LEFT JOIN s ON s.name = h.name AND s.n = h.tap GROUP BY ALL)"""


@query("src10_resampled_windows", f"WITH {_SOUND_SQL}, {_RESAMPLED_SQL}, {_window_sql(RATE)}")
def src10(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the same files at another rate."""
    return _windows(spark, sounds(spark, d), RATE)


def timeline_inputs(spark: SparkSession, d: str) -> dict:
    """Each user's events as a song in hours, with moods by type of event, and the parts of one size as its clips."""
    hour = 3_600_000_000.0
    e = events(spark, d).withColumn("at", F.round((F.col("us") - 1_704_067_200_000_000) / hour, 6))
    total = e.groupBy("user_id").agg((F.max("at") + 5).alias("total"), F.count("*").alias("n"))
    timelines = total.select("user_id", "total", F.when(F.col("n") / F.col("total") > 0.1, 4).otherwise(2).alias("every"), (F.col("user_id") % 50 + 1).alias("size"))
    clips = read(spark, d, "part").select(F.col("p_partkey").alias("clip"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 40 + 0.5).alias("length"), (F.col("p_partkey") % 11 / 10).alias("motion"))
    moods = e.groupBy("user_id", "event_type").agg(F.sum("strength").alias("weight")).join(timelines.select("user_id", "size"), "user_id")
    # what each of the five moods wants of a clip
    wants = F.when(F.col("event_type") == "click", F.col("motion") * 0.3).when(F.col("event_type") == "view", (1 - F.col("motion")) * 0.3).otherwise(0.1)
    match = clips.crossJoin(F.broadcast(e.select("event_type").distinct())).select("size", "event_type", "clip", (0.5 + wants).alias("score"))
    kinds = composer.alike(match, ["size", "event_type"], "clip", "score")
    of_kinds = match.join(kinds.select(F.col("kind").alias("clip")).distinct(), "clip")
    scores = composer.mood_scores(moods, of_kinds, ["user_id"], ["size", "event_type"], "weight", "clip", "score")
    points = lambda kind: e.where(kind).select("user_id", "at").distinct()
    curve = e.groupBy("user_id", "at").agg(F.max("strength").alias("value"))
    return {"beats": points(F.lit(True)), "downbeats": points(F.col("event_type") == "purchase"), "energy": curve, "timelines": timelines, "scores": scores, "clips": clips, "kinds": kinds}


@query("udf17_composed_timelines", None)
def udf17(spark: SparkSession, d: str) -> DataFrame:
    """Timelines of all users without gaps: cuts at every second or fourth event, clips by mood in turn, fillers before the first cut and behind the last."""
    i = timeline_inputs(spark, d)
    t = composer.composed(i["beats"], i["downbeats"], i["energy"], i["timelines"], i["scores"], i["clips"], ["user_id"], "clip", ends=False, kinds=i["kinds"])
    rounded = [F.round(c, 6).alias(c) for c in ("start", "end", "source_start", "source_end", "score", "energy_match", "match")]
    return t.select("user_id", "clip", "transition_in", "transition_out", "filler", *rounded)
