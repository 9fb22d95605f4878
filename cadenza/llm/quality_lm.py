"""Text quality by an interpolated modified Kneser-Ney n-gram model over characters.

The model is counted on trusted texts: on one half of them for the other half of the documents, so that
no text helps to count itself. Documents are packed into compressed blocks; each block asks
for the probabilities of its distinct 4-grams only. Those requests meet the counts of all orders in
joins sharded by n-gram, and the answers go back by block, where whole texts are scored. So neither
the model nor a table of n-grams per document ever has to be in one place, and a frequent n-gram is
one row per block. Documents are kept within language-specific quantiles of their perplexity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

ORDER = 4
#: Characters of text in a block (a longer text is a block of its own) and scored at a time.
BLOCK = 1 << 24
SLICE = 1 << 20
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 1 << 20
#: Quantiles of a language's perplexities between which documents are kept.
LOW, HIGH = 0.01, 0.90
#: Trusted ids up to which they are broadcast (8 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def codes(text: str | None) -> np.ndarray:
    """UTF-16-sized character codes, lower case, blanks folded, ORDER - 1 start marks ahead; empty for no text."""
    line = " ".join((text or "").lower().split())
    if not line:
        return np.zeros(0, "uint16")
    points = np.frombuffer(line.encode("utf-32-le", "replace"), "uint32")
    return np.concatenate([np.full(ORDER - 1, 2, "uint16"), np.minimum(points, 0xFFFF).astype("uint16")])


def packed_codes(c: np.ndarray) -> bytes:
    """Codes compressed with their low and high bytes apart, so that copies anywhere in the block are found."""
    options = zstandard.ZstdCompressionParameters.from_level(9, window_log=25, enable_ldm=True)
    planes = (c & 0xFF).astype("uint8").tobytes() + (c >> 8).astype("uint8").tobytes()
    return zstandard.ZstdCompressor(compression_params=options).compress(planes)


def unpacked_codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor(max_window_size=1 << 25).decompress(data), "uint8").reshape(2, -1).astype("uint16")
    return planes[0] | planes[1] << 8


def grams(c: np.ndarray) -> np.ndarray:
    """Each run of four codes as one signed 64-bit key."""
    if len(c) < ORDER:
        return np.zeros(0, "int64")
    w = c.astype("uint64")
    n = len(w) - ORDER + 1
    return ((w[:n] << np.uint64(48)) | (w[1 : n + 1] << np.uint64(32)) | (w[2 : n + 2] << np.uint64(16)) | w[3:]).view("int64")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype("int64")


def _tally(texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys and their counts of code arrays, some SLICE codes at a time."""
    keys, counts, held, size = [], [], [], 0
    for c in [*texts, None]:
        if c is not None:
            held.append(grams(c))
            size += len(c)
        if held and (c is None or size > SLICE):
            k, n = np.unique(np.concatenate(held), return_counts=True)
            keys.append(k)
            counts.append(n)
            held, size = [], 0
    return keys, counts


def count_grams(texts: DataFrame) -> DataFrame:
    """(k, c): 4-grams of all rows of a frame with one column of text, and how often they stand."""

    def run(batches):
        keys, counts = [], []
        for batch in batches:
            k, n = _tally(codes(t) for t in batch.column(0).to_pylist())
            keys, counts = keys + k, counts + n
            if sum(map(len, keys)) > HELD:
                k, n = _merged(keys, counts)
                keys, counts = [k], [n]
                if len(k) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "c"])
                    keys, counts = [], []
        if keys:
            k, n = _merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "c"])

    return texts.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _suffix(k, order: int):
    """The last `order` codes of a key."""
    return k if order == ORDER else k.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _context(k):
    """A key without its last code."""
    return F.shiftrightunsigned(k, 16)


class KneserNey:
    """Counts of every order: raw ones of 4-grams, and of shorter ones how many characters precede them."""

    def __init__(self, counts: DataFrame):
        self.counts = {ORDER: cut(counts, "kn-counts")}
        for n in range(ORDER - 1, 0, -1):
            longer = self.counts[n + 1]
            self.counts[n] = cut(longer.groupBy(_suffix(F.col("k"), n).alias("k")).agg(F.count("*").alias("c")), f"kn-{n}")
        self.discounts, self.contexts = {}, {}
        for n in range(1, ORDER + 1):
            few = {r.c: r["count"] for r in self.counts[n].where("c <= 4").groupBy("c").count().collect()}  # four rows at most
            self.discounts[n] = self._discount([few.get(i, 0) for i in range(1, 5)])
            if n > 1:
                self.contexts[n] = self.counts[n].groupBy(_context(F.col("k")).alias("h")).agg(
                    F.sum("c").alias("total"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("c") >= 3).alias("n3")
                )
        row = self.counts[1].agg(F.sum("c"), F.count("*"), *[F.count_if(F.col("c") == i) for i in (1, 2)], F.count_if(F.col("c") >= 3)).first()
        d = self.discounts[1]
        self.total, self.types = row[0] or 0, row[1]
        self.left = (d[0] * row[2] + d[1] * row[3] + d[2] * row[4]) / self.total if self.total else 1.0

    @staticmethod
    def _discount(n: list[int]) -> tuple[float, float, float]:
        """The three discounts from how many n-grams stand once to four times; none is so small that what wasn't counted would have no share."""
        if not n[0] or not n[1]:
            return 0.5, 0.5, 0.5
        y = n[0] / (n[0] + 2 * n[1])
        d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 for i in (1, 2, 3)]
        return tuple(min(max(x, 0.05), float(i)) for i, x in enumerate(d, 1))

    def log_probabilities(self, keys: DataFrame) -> DataFrame:
        """(k, logp) of each distinct 4-gram key, by joins over the n-grams of every order."""
        base = self.left / (self.types + 1)  # an unseen character has the share of one type
        df, p = keys.select("k"), None
        for n in range(1, ORDER + 1):
            c, d = self.counts[n].select(F.col("k").alias(f"k{n}"), F.col("c").alias(f"c{n}")), self.discounts[n]
            df = df.join(c, _suffix(F.col("k"), n) == F.col(f"k{n}"), "left").drop(f"k{n}")
            count = F.coalesce(F.col(f"c{n}"), F.lit(0))
            less = F.when(count == 0, 0.0).when(count == 1, count - d[0]).when(count == 2, count - d[1]).otherwise(count - d[2])
            if n == 1:
                p = less / F.lit(float(max(self.total, 1))) + F.lit(base)
            else:
                h = self.contexts[n].withColumnsRenamed({x: f"{x}_{n}" for x in ("h", "total", "n1", "n2", "n3")})
                df = df.join(h, _context(_suffix(F.col("k"), n)) == F.col(f"h_{n}"), "left").drop(f"h_{n}")
                total = F.col(f"total_{n}")
                weight = d[0] * F.col(f"n1_{n}") + d[1] * F.col(f"n2_{n}") + d[2] * F.col(f"n3_{n}")
                p = F.when(total.isNull(), F.col("p")).otherwise((less + weight * F.col("p")) / total)
            df = df.withColumn("p", p).select("k", "p")
        return df.select("k", F.log("p").alias("logp"))


def half(text):
    """The half of the corpus that a text belongs to, by its hash; equal texts are in one half."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


def perplexities(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_codes and perplexity per character of every row; null where a text is blank.

    trusted_ids has one column, the ids whose texts are trusted. The corpus has two halves, and a text is
    scored by the model of the other half's trusted texts, so that none helps to count itself. Without any
    trusted text there, all characters are equally likely. Repeated rows are scored each; a null id is
    never trusted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).withColumn("half", half(F.col("text")))
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    scored = [_scored(rows.where(F.col("half") == h).drop("half"), KneserNey(count_grams(trusted.where(F.col("half") != h).select("text")))) for h in (0, 1)]
    return scored[0].unionByName(scored[1])


def _scored(rows: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, lang, n_codes and perplexity of doc_id, lang and text by a model."""

    def block(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            return pa.RecordBatch.from_arrays([
                pa.array([(task << 32) + made]), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([[x for _, x, _ in held]], pa.list_(pa.string())),
                pa.array([[len(c) for _, _, c in held]], pa.list_(pa.int64())), pa.array([packed_codes(np.concatenate([c for _, _, c in held]))], pa.binary()),
            ], names=["block", "ids", "langs", "sizes", "data"])

        for batch in batches:
            for d, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True):
                held.append((d.as_py(), lang.as_py(), codes(text.as_py())))
                size += len(held[-1][2])
                if size > BLOCK:
                    yield packed()
                    made, held, size = made + 1, [], 0
        if held:
            yield packed()

    blocks = cut(rows.mapInArrow(block, "block long, ids array<long>, langs array<string>, sizes array<long>, data binary"), "kn-blocks")

    def texts_of(sizes, data):
        return np.split(unpacked_codes(data), np.cumsum(sizes)[:-1])

    def ask(batches):
        for pdf in batches:
            for b, sizes, data in zip(pdf["block"], pdf["sizes"], pdf["data"], strict=True):
                keys, counts = _tally(texts_of(sizes, data))
                k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, "int64")
                yield pd.DataFrame({"block": np.full(len(k), b), "k": k})

    asked = cut(blocks.select("block", "sizes", "data").mapInPandas(ask, "block long, k long"), "kn-asked")
    answers = asked.join(cut(model.log_probabilities(asked.select("k").distinct()), "kn-answers"), "k").select("block", "k", F.col("logp").cast("float").alias("logp"))

    def score(key, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("k")
        known, logp = found["k"].to_numpy(), found["logp"].to_numpy().astype("float64")
        out = []
        for ids_, langs, sizes, data in zip(pdf["ids"], pdf["langs"], pdf["sizes"], pdf["data"], strict=True):
            for d, lang, c in zip(ids_, langs, texts_of(sizes, data), strict=True):
                k, total = grams(c), 0.0
                for at in range(0, len(k), SLICE):
                    total += float(logp[np.searchsorted(known, k[at : at + SLICE])].sum())
                out.append((d, lang, len(k), np.exp(-total / len(k)) if len(k) else None))
        return pd.DataFrame(out, columns=["doc_id", "lang", "n_codes", "perplexity"]).astype({"doc_id": "Int64", "n_codes": "int64", "perplexity": "float64"})

    pairs = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    scored = pairs.applyInPandas(score, "doc_id long, lang string, n_codes long, perplexity double")
    return scored.withColumn("perplexity", F.when(F.col("n_codes") > 0, F.col("perplexity")))


def keep_by_perplexity(scored: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Add keep: whether the perplexity lies between two quantiles of its language (null is a language); blank texts go."""
    bounds = scored.groupBy("lang").agg(F.percentile_approx("perplexity", F.array(F.lit(low), F.lit(high)), 10000).alias("b"))
    bounds = bounds.select(F.col("lang").alias("_lang"), F.col("b")[0].alias("_low"), F.col("b")[1].alias("_high"))
    out = scored.join(bounds, scored.lang.eqNullSafe(F.col("_lang")), "left")
    return out.withColumn("keep", F.coalesce(F.col("perplexity").between(F.col("_low"), F.col("_high")), F.lit(False))).drop("_lang", "_low", "_high")


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether it is kept; nulls, repeats and empty tables as perplexities() and keep_by_perplexity() say."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = cut(perplexities(table(spark, sf_dir, "documents"), trusted), "perplexities")
    return keep_by_perplexity(scored).select("doc_id", "lang", "n_codes", F.round("perplexity", 4).alias("perplexity"), "keep")
