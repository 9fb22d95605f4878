"""Benchmark decontamination by winnowing, in DataFrame functions only.

The minimum K-gram hash of every span of 13 words (nine 5-grams) is a fingerprint, on both sides.
Two texts that share 13 words share that minimum, so a join on fingerprints finds every document
that can hold a window of an item. Those documents alone are searched for whole windows, and each
hit is extended over its words and compared word by word. Items under 13 words are one window; as
winnowing promises nothing for spans so short, documents then show all their grams of that size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

WINDOW = 13
GRAM = 5
#: Rows up to which the benchmark's side of a join is broadcast (under 32 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters; null gives none."""
    lowered = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(lowered, _SPLIT), lambda w: w != "")


def _shifted(df: DataFrame, out: str, a: str, b: str, by: int, join) -> DataFrame:
    """out[i] = join(a[i], b[i + by]) for every i that both have."""
    n = F.greatest(F.lit(0), F.least(F.size(a), F.size(b) - by))
    return df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + by), n), join))


def _spread(df: DataFrame, name: str, size: int, join) -> DataFrame:
    """Add name + str(size): join over each run of `size` consecutive elements of name + '1', by doubling."""
    have = 1
    while have * 2 <= size:
        if f"{name}{have * 2}" not in df.columns:
            df = _shifted(df, f"{name}{have * 2}", f"{name}{have}", f"{name}{have}", have, join)
        have *= 2
    part = have
    while part < size:
        step = 1 << ((size - part).bit_length() - 1)
        if f"{name}{part + step}" not in df.columns:
            df = _shifted(df, f"{name}{part + step}", f"{name}{part}", f"{name}{step}", part, join)
        part += step
    return df


def _grams(df: DataFrame, size: int) -> DataFrame:
    """Add g{size}: a hash of each run of `size` words of w."""
    if "g1" not in df.columns:
        df = df.withColumn("g1", F.transform("w", lambda x: F.xxhash64(x)))
    return _spread(df, "g", size, lambda a, b: F.xxhash64(a, b))


def _winnowed(df: DataFrame) -> DataFrame:
    """Add m{WINDOW - GRAM + 1}: the least gram hash of each WINDOW words."""
    df = _grams(df, GRAM).withColumn("m1", F.col(f"g{GRAM}"))
    return _spread(df, "m", WINDOW - GRAM + 1, lambda a, b: F.least(a, b))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of all items: w, n (its length), window (its words joined by spaces), items (their ids as strings)."""
    df = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    df = df.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    df = df.withColumn("at", F.explode(starts)).select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("w"))
    return df.groupBy("n", "w").agg(F.collect_set("item").alias("items")).withColumn("window", F.array_join("w", " "))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_hash: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of a window of an item. Null and empty texts have
    no words; an item without words or without an id takes no part. Repeated rows give a result row
    each. Empty tables give an empty result, or no hits. keep_hash adds th, the hash of the text.
    """
    also = ["th"] if keep_hash else []
    windows = cut(item_windows(items, item_col, item_text), "windows")
    lengths = {r.n: r["count"] for r in windows.groupBy("n").count().collect()}  # at most 13 rows
    n_windows = sum(lengths.values())
    short = sorted(n for n in lengths if n < WINDOW)

    row = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    row = row.withColumn("th", F.xxhash64("text"))
    empty = F.sha2(F.lit(""), 256)
    base = row.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if not lengths:
        return base.select(*also, "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"), F.lit(False).alias("contaminated"))

    # fingerprints of the items' windows: the least gram of GRAM words, or the whole window if that is shorter
    sizes = sorted({min(n, GRAM) for n in short})
    own = windows.select("w", "n")
    for s in {GRAM, *sizes}:
        own = _grams(own, s)
    fp = reduce(lambda e, s: F.when(F.col("n") == s, F.element_at(f"g{s}", 1)).otherwise(e), [s for s in sizes if s < GRAM], F.array_min(f"g{GRAM}"))
    # written first: a filter that Spark infers for a join key would be pushed down as the whole expression
    marks = cut(own.select(fp.alias("fp")).distinct(), "marks")

    # and those of the documents
    seen = _winnowed(row.select("doc_id", "th", words(F.col("text")).alias("w")))
    for s in sizes:
        seen = _grams(seen, s)
    prints = [F.col(f"g{s}") for s in sizes]
    if WINDOW in lengths and GRAM not in sizes:  # all grams of GRAM words hold the least ones
        prints.append(F.col(f"m{WINDOW - GRAM + 1}"))
    shown = seen.select("doc_id", "th", F.explode_outer(F.array_distinct(F.concat(*prints))).alias("fp"))
    suspects = cut(shown.join(_small(marks, n_windows), "fp").select("doc_id", "th").distinct(), "suspect-ids")

    # few documents are suspects: their ids go to the texts, not the texts to them
    near = (row.doc_id.eqNullSafe(suspects.doc_id)) & (row.th == suspects.th)
    suspect = cut(row.join(_small(suspects, suspects.count()), near, "left_semi").dropDuplicates(["doc_id", "th"]).select("doc_id", "th", words(F.col("text")).alias("w")), "suspects")
    found = None
    for n in sorted(lengths):
        key = _grams(windows.where(F.col("n") == n).select("w", "n", "window"), n).select(F.element_at(f"g{n}", 1).alias("g"), "n", "window")
        key = cut(key, "window-keys")
        at = _grams(suspect, n).select("doc_id", "th", F.posexplode_outer(f"g{n}").alias("pos", "g"))
        part = at.join(_small(key, lengths[n]), "g").select("doc_id", "th", F.struct((F.col("pos") + 1).alias("pos"), "n", "window").alias("hit"))
        found = part if found is None else found.unionByName(part)
    hits = found.groupBy("doc_id", "th").agg(F.collect_list("hit").alias("hits")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    hits = suspect.join(hits, suspect.doc_id.eqNullSafe(F.col("d")) & (suspect.th == F.col("t")))
    hits = hits.withColumn("hits", F.filter("hits", lambda x: F.array_join(F.slice("w", x.pos, x.n), " ") == x.window))
    at = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x.pos, x.pos + x.n - 1))))
    hits = cut(hits.select("d", "t", F.size(at).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x.window)).alias("seen")), "window-hits")
    # a window may stand in many items: their ids join the distinct windows of a document, not each of its hits
    named = hits.select("d", "t", F.explode("seen").alias("window")).join(_small(windows.select("window", "items"), n_windows), "window")
    named = named.select("d", "t", F.explode("items").alias("item")).groupBy("d", "t").agg(F.array_sort(F.collect_set("item")).alias("named"))
    named = named.withColumnsRenamed({"d": "nd", "t": "nt"})
    hits = hits.select("d", "t", "n_hit").join(named, F.col("d").eqNullSafe(F.col("nd")) & (F.col("t") == F.col("nt"))).select("d", "t", "n_hit", "named")

    out = base.join(hits, base.doc_id.eqNullSafe(F.col("d")) & (base.th == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        *also, "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("named"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("named", ","), 256), empty).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose words are hit by the contamination rule.

    Rows without an id stay, as do null and empty texts. Repeated rows go or stay together; an id with
    several texts is judged text by text. Empty tables give an empty result, or docs as they are.
    """
    bad = contamination(docs, items, id_col, text_col, keep_hash=True).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_hash")).distinct()
    return docs.join(bad, (F.col(id_col) == F.col("_bad_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_bad_hash")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark; nulls, repeats and empty tables as contamination() says."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS pos FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM bw),
dn AS (SELECT d.doc_id, d.w, n.n, unnest(range(1, len(d.w) - n.n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM win) n WHERE len(d.w) >= n.n),
hit AS (SELECT dn.doc_id, dn.pos, dn.n, win.item FROM dn JOIN win ON win.n = dn.n AND win.win = array_to_string(dn.w[dn.pos:dn.pos + dn.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
