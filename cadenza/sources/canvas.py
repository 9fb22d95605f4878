"""Clips that a canvas places on a timeline: time anchors, interpolated places, names found among clips, overlaps pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import _beside

SCHEMA = "canvas string, nodes array<struct<id:string,type:string,text:string,file:string,x:double,y:double>>"
#: A time anchor in a text, files at this height or lower wait in the lobby, length of a clip that has none. Fixed values.
ANCHOR = r"@(\d{1,3}):(\d{2})(?!\d)"
LOBBY = 520.0
LENGTH = 5.0
#: Names up to which they are broadcast (some megabytes).
FEW = 50_000


def nodes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """canvas, pos (place in its list) and the fields of each node of canvas files; a file of one canvas a line isn't multi_line. A canvas without a name has its file's."""
    read = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    return read.select(F.coalesce("canvas", F.input_file_name()).alias("canvas"), F.posexplode("nodes").alias("pos", "n")).select("canvas", "pos", "n.*")


def _stem(path):
    """Lower-cased last part of a path without its extension."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]+$", ""))


def _found(names: DataFrame, clips: DataFrame) -> DataFrame:
    """name and clip for names that no clip bears: the first clip whose path holds the name.

    A path that holds a name holds every gram of it, so the two meet on the name's rarest one and pairs
    are tested only there. Spark takes a list of grams to be as small as its paths, so it would broadcast all of
    them: names go to the paths where a count says that they are few, otherwise both are sorted.
    """
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    paths = clips.select("_order", "clip", F.lower("path").alias("_path"))
    shown = paths.select("*", F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col("_path"), n) for n in (1, 2, 3)))))).alias("_gram"))
    counts = shown.groupBy("_gram").count()
    size = F.least(F.length("name"), F.lit(3))
    own = F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring(F.col("name"), i, size))
    counts = counts.hint("merge")
    mine = names.where("name <> ''").select("name", F.explode(F.array_distinct(own)).alias("_gram"))
    rare = mine.join(counts, "_gram").groupBy("name").agg(F.min_by("_gram", F.struct("count", "_gram")).alias("_gram"))
    few = names.count() <= FEW
    hits = shown.join(F.broadcast(rare), "_gram") if few else shown.hint("merge").join(rare, "_gram")
    hits = hits.where(F.contains("_path", "name"))
    return hits.groupBy("name").agg(F.min_by("clip", "_order").alias("clip"))


def placed_clips(nodes: DataFrame, clips: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """canvas, pos, clip, start and end of the files that nodes place. clips have clip, path and duration, and an order.

    Texts like @1:30 are time anchors; a canvas needs two. A file's time lies on the line between the
    anchors left and right of it, and beyond them at the nearest; of anchors at one x the first holds
    there and to the left, the last to the right. A file names the last clip of its stem, or else the first
    clip whose path holds its stem; files without a name or without such a clip go. Only files above the
    lobby count; a missing y is in the lobby, a missing x is 0, a missing or zero duration is LENGTH.
    A clip that would overlap the one before starts where that one ends; ties in the order of pos.
    """
    part = lambda i: F.regexp_extract(F.coalesce("text", F.lit("")), ANCHOR, i).try_cast("int")
    x = F.coalesce("x", F.lit(0.0))
    anchors = nodes.where(F.col("type") == "text").select("canvas", "pos", x.alias("ax"), part(1).alias("m"), part(2).alias("s")).where("m is not null and s < 60")
    seconds = (F.col("m") * 60 + F.col("s")).cast("double")
    at_x = anchors.groupBy("canvas", "ax").agg(F.min_by(seconds, "pos").alias("here"), F.max_by(seconds, "pos").alias("on"), F.count("*").alias("n"))
    usable = at_x.groupBy("canvas").agg(F.sum("n").alias("n"), F.min("ax").alias("low"), F.max("ax").alias("high")).where("n >= 2")
    files = nodes.where((F.col("type") == "file") & (F.coalesce("y", F.lit(999.0)) < LOBBY)).select("canvas", "pos", x.alias("x"), _stem(F.coalesce("file", F.lit(""))).alias("name"))
    files = files.join(usable.select("canvas", "low", "high"), "canvas")

    known = clips.select("clip", "path", F.coalesce(F.nullif(F.col("duration").cast("double"), F.lit(0.0)), F.lit(LENGTH)).alias("length"), F.col(order).alias("_order"))
    by_name = known.groupBy(_stem(F.col("path")).alias("name")).agg(F.max_by("clip", "_order").alias("clip"))
    asked = files.select("name").distinct()
    named = asked.join(by_name, "name")
    named = named.unionByName(_found(asked.join(named, "name", "left_anti"), known))

    both = _beside(files.join(named, "name"), at_x.select("canvas", "ax", "here", "on"), ["canvas"], "x", "ax", ["here", "on"], rows)
    a, b, place = F.col("_back"), F.col("_next"), F.col("x")
    line = a["on"] + (b["here"] - a["on"]) * (place - a["ax"]) / (b["ax"] - a["ax"])
    # anchors at one x: the first holds there and to the left, but at the right end the last
    at = F.when(place <= F.col("low"), b["here"]).when(place >= F.col("high"), a["on"]).when(a["ax"] == place, a["here"]).otherwise(line)
    timed = both.select("canvas", "pos", "clip", at.alias("at")).join(known.groupBy("clip").agg(F.max_by("length", "_order").alias("length")), "clip")

    # start = max(own place, end before): the running maximum of a place less all lengths before it, with them added again
    w = Window.partitionBy("canvas").orderBy("at", "pos")
    past = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    timed = timed.withColumn("_past", past).withColumn("_free", F.col("at") - F.col("_past"))
    start = F.col("_past") + F.greatest(F.max("_free").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return timed.withColumn("start", start).select("canvas", "pos", "clip", "start", (F.col("start") + F.col("length")).alias("end"))
