"""Target-distribution importance resampling: hashed n-gram features weigh documents by how much likelier the target's texts make them.

Each task lays the words of its documents end to end as integers and sorts their suffixes to the depth
of the longest n-gram. Where neighbours of that suffix array share n words they form an LCP run, and a
run is one repeated n-gram: it is hashed once, and its bucket is scattered back to every place where
it occurs. One pass sums buckets over all documents and over all target texts (at most BUCKETS rows a
task are shuffled), a second one adds up each document's gains. Long inputs are cut into blocks that
share their last words, so a task's memory doesn't grow with a text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches, table

LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
#: Words of a block; its word ids stay under 2**21, so that three of them fit one key.
BLOCK = 1 << 20
#: Ranges of scores that are ranked side by side.
RANGES = 128

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_LOWERED = bytes(range(256)).lower()
_TO_WORDS = bytes(c if c in _WORD else 32 for c in _LOWERED)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters as UTF-8, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first `depth` words, and the LCP of each with the one before it.

    ids are from 1, left counts the words up to the end of the document; LCPs end there too.
    """
    columns = []
    for k in range(depth):
        column = np.zeros(len(ids), "int64")
        column[: len(ids) - k] = np.where(left[: len(ids) - k] > k, ids[k:], 0)
        columns.append(column)
    bits = int(ids.max(initial=0)).bit_length()
    if bits * depth < 63:
        key = columns[0]
        for column in columns[1:]:
            key = key << bits | column
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    lcp = np.zeros(len(ids), "int64")
    same = np.ones(max(len(ids) - 1, 0), bool)
    for column in columns:
        placed = column[order]
        same &= (placed[1:] == placed[:-1]) & (placed[1:] > 0)
        lcp[1:] += same
    return order, lcp


def block_buckets(tokens: list[bytes], left: np.ndarray, buckets: int = BUCKETS, depth: int = LONGEST) -> list[np.ndarray]:
    """For n = 1 .. depth the bucket of the n-gram at each word, -1 where the document ends before."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = lambda: len(number) + 1
    ids = np.fromiter(map(number.__getitem__, tokens), "int64", len(tokens))
    order, lcp = suffix_array(ids, left, depth)
    spaced = [b"", *(b" " + w for w in number)]
    room = left[order]
    crc = np.zeros(len(ids), "int64")  # of the n - 1 words before, at each place of the order
    out = []
    for n in range(1, depth + 1):
        whole = room >= n
        heads = np.flatnonzero(whole & (lcp < n))
        first = order[heads]
        nth = ids[first + n - 1].tolist()
        texts = [spaced[i][1:] for i in nth] if n == 1 else [spaced[i] for i in nth]
        hashed = np.fromiter(map(zlib.crc32, texts, crc[heads].tolist()), "int64", len(heads))
        run = np.cumsum(whole & (lcp < n)) - 1  # runs of whole n-grams follow each other in the order
        crc = np.where(whole, hashed[run] if len(heads) else 0, 0)
        at = np.full(len(ids), -1, "int64")
        at[order] = np.where(whole, crc % buckets, -1)
        out.append(at)
    return out


def _blocks(texts, block: int, depth: int):
    """Blocks over texts: tokens, words left to the end of each one's part, and the document it counts for; -1 marks words that a later block counts."""
    held: list[bytes] = []
    left: list[np.ndarray] = []
    doc: list[np.ndarray] = []
    size = 0
    for d, text in enumerate(texts):
        tokens = words(text)
        for at in range(0, len(tokens), block):
            part = tokens[at : at + block + depth - 1]
            own = min(block, len(tokens) - at)
            if size and size + own > block:
                yield held, np.concatenate(left), np.concatenate(doc)
                held, left, doc, size = [], [], [], 0
            place = np.arange(len(part))
            held += part
            left.append(len(part) - place)
            doc.append(np.where(place < own, d, -1))
            size += own
    if held:
        yield held, np.concatenate(left), np.concatenate(doc)


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, depth: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """bucket, n: features of all texts by bucket; buckets without a feature are missing."""
    small_batches(rows.sparkSession, 512)

    def run(batches):
        total = np.zeros(buckets, "int64")
        for pdf in batches:
            for tokens, left, doc in _blocks(pdf["text"], block, depth):
                for at in block_buckets(tokens, left, buckets, depth):
                    total += np.bincount(at[(doc >= 0) & (at >= 0)], minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype("int32"), "n": total[some]})

    parts = rows.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: floor(1000 ln) of the smoothed share in the target over that in docs. Both sides are bucket counts."""
    s = docs.select("bucket", F.col("n").alias("s"))
    t = target.select("bucket", F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    x = lambda c, by: F.col(c).cast("double") + by
    ratio = x("t", 1) * (float(all_s) + buckets) / (x("s", 1) * (float(all_t) + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", depth: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row. gains holds one number a bucket."""
    small_batches(docs.sparkSession, 512)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            weight, features, count = np.zeros(n, "int64"), np.zeros(n, "int64"), np.zeros(n, "int64")
            for tokens, left, doc in _blocks(pdf["text"], block, depth):
                own = doc >= 0
                count += np.bincount(doc[own], minlength=n)
                for at in block_buckets(tokens, left, len(gains), depth):
                    some = np.flatnonzero(own & (at >= 0))
                    features += np.bincount(doc[some], minlength=n)
                    np.add.at(weight, doc[some], gains[at[some]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": count, "n_features": features, "weight": weight})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int):
    """floor(-1000 ln(-ln(u))) of a document, u from the hash of seed and id; a null id is hashed as ''."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, share_pct: int, ranges: int = RANGES) -> DataFrame:
    """scored (doc_id, score, able, ...) with rank for the highest share_pct of a hundred of the rows that are `able`, null for all others.

    Scores of about the share asked for are dealt to ranges between quantiles. The sizes of the ranges
    above give each range its first rank, and only ranges that hold drawn rows are sorted, each in a
    task of its own.
    """
    share = min(share_pct * 1.25, 100) / 100
    edges = scored.where("able").approxQuantile("score", [1 - share * i / ranges for i in range(1, ranges + 1)], share / ranges / 4) if share else []
    edges = sorted(set(edges))  # at most `ranges` numbers
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("score"))) if edges else F.lit(0)
    placed = scored.withColumn("part", F.when(F.col("able"), part).otherwise(-1))
    sizes = {r.part: r["count"] for r in placed.where("able").groupBy("part").count().collect()}  # as few
    drawn = sum(sizes.values()) * share_pct // 100
    above, first = 0, {}
    for p in sorted(sizes, reverse=True):
        if above < drawn:
            first[p] = above
        above += sizes[p]
    none = F.lit(None).cast("long")
    if not first:
        return placed.withColumn("rank", none)
    start = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("part"))
    asked = F.col("part").isin(list(first))
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = (F.row_number().over(order) + start).cast("long")
    top = placed.where(asked).withColumn("rank", F.when(rank <= drawn, rank))
    return top.unionByName(placed.where(~asked).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, seed: int = 42, share_pct: int = 5, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of docs.

    Of the N rows with at least least_words words the floor(share_pct * N / 100) highest scores are
    drawn, ties to the smaller id, and among rows of one id in any order; a null id comes last among
    ties. Null and empty texts have no words and no features, so they weigh 0 and are never drawn. Rows
    that repeat count and are drawn one by one. An empty target gives gains against the smoothing
    alone; empty docs give an empty result. Further columns don't matter.
    """
    counts = [cut(bucket_counts(df, c, buckets), "importance-buckets") for df, c in ((docs, text_col), (target, target_text))]
    gains = bucket_gains(*counts, buckets)
    by_bucket = np.zeros(buckets, "int64")
    for r in gains.collect():  # as many rows as buckets
        by_bucket[r.bucket] = r.gain
    scored = weigh(docs, by_bucket, id_col, text_col)
    scored = scored.select("*", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    scored = cut(scored, "importance-scores")
    return ranked(scored, share_pct).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark texts; nulls, repeats and empty tables as resample() says."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


# CRC-32 is linear: of a text's bytes each gives its own share, which depends on the byte and on how many bytes follow.
OP13_SQL = f"""
WITH RECURSIVE
x(b, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM x WHERE k < 8),
crc AS MATERIALIZED (SELECT b, v FROM x WHERE k = 8),
w AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS r, doc_id, {{words}} AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, {{words}} FROM benchmark),
run AS (SELECT side, r, w, n.n AS n, unnest(range(1, len(w) - n.n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) n WHERE len(w) >= n.n),
g AS MATERIALIZED (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS c FROM run GROUP BY ALL),
u AS MATERIALIZED (SELECT gram, hex(encode(gram)) AS h, octet_length(encode(gram)) AS len FROM (SELECT DISTINCT gram FROM g)),
m AS (SELECT max(len) AS most FROM u),
share(b, k, v) AS (SELECT b, 0, v FROM crc UNION ALL
  SELECT s.b, s.k + 1, xor(s.v >> 8, c.v) FROM share s JOIN crc c ON c.b = s.v & 255, m WHERE s.k + 1 < m.most),
start(k, v) AS (SELECT 0, 4294967295 UNION ALL SELECT s.k + 1, xor(s.v >> 8, c.v) FROM start s JOIN crc c ON c.b = s.v & 255, m WHERE s.k < m.most),
y AS (SELECT gram, len, h, unnest(range(len)) AS i FROM u),
z AS (SELECT gram, any_value(len) AS len, bit_xor(share.v) AS v FROM y
  JOIN share ON share.k = len - 1 - i AND share.b = 16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 GROUP BY gram),
bucket AS MATERIALIZED (SELECT gram, xor(xor(z.v, start.v), 4294967295) % {BUCKETS} AS bucket FROM z JOIN start ON start.k = z.len),
f AS MATERIALIZED (SELECT side, r, bucket, sum(c) AS c FROM g JOIN bucket USING (gram) GROUP BY ALL),
s AS (SELECT bucket, sum(c) FILTER (side = 0) AS s, sum(c) FILTER (side = 1) AS t FROM f GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM s),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(s.t, 0) + 1)::DOUBLE * (tot.s + {BUCKETS})::DOUBLE / ((coalesce(s.s, 0) + 1)::DOUBLE * (tot.t + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s, tot),
weight AS (SELECT r, sum(c) AS n_features, sum(c * gain) AS weight FROM f JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT w.doc_id, len(w.w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN weight USING (r) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n >= {LEAST_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN n >= {LEAST_WORDS} AND place <= 5 * able // 100 THEN place END AS BIGINT) AS rank FROM placed
""".replace(
    "{words}",
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')",
)
