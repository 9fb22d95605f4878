"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and character 5-grams is trained with numpy from confirmed toxic
texts and unlabelled ones. The risk is prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]):
unlabelled texts count as negative, less the share that the class prior says is toxic, and the
negative part is kept from falling below zero, where the model would only fit its sample. An L1
step keeps noise out of long texts, and no single word counts beyond a bound, so that it takes more
than one chance word to call a text toxic, unless the sample shows surely that the word is toxic by
itself. Scoring runs in tasks over whole texts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bounds of the training sample: confirmed toxic texts and unlabelled texts, those of the least hash.
POSITIVES = 2000
UNLABELLED = 6000
#: Hash buckets of features, and the uses in confirmed texts that one must have: so many, and per text.
BUCKETS = 1 << 20
SEEN_IN = 3
SEEN_SHARE = 0.01
#: Share of a feature's uses that the class prior puts in toxic texts, at least.
TOXIC_SHARE = 0.6
GRAM = 5
STEPS = 200
RATE = 0.1
L1 = 1e-4
#: The most that one word adds to a text's score, on the scale of log odds, and the most of a word with a sure feature.
WORD_MOST, SURE_MOST = 1.4, 5.0
#: A feature is sure if toxic texts are this share of those that show it at least, less an error of one over the root of their number.
SURE_SHARE = 0.85
#: Words whose weight a task remembers.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Distinct lower-cased words of the whole text, in order of first use."""
    return list(dict.fromkeys(_WORD.findall((text or "").lower())))


def features_of(word: str) -> list[int]:
    """Hash buckets of the word and of its character 5-grams, its ends marked."""
    marked = f"^{word}$"
    parts = {marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))}
    return sorted({zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts})


@dataclass
class Model:
    weights: np.ndarray
    sure: np.ndarray
    bias: float

    def scorer(self):
        """A function that scores one text between 0 and 1."""
        known: dict[str, float] = {}
        weights, sure, bias = self.weights, self.sure, self.bias

        def score(text: str | None) -> float:
            z = bias
            for w in words_of(text):
                v = known.get(w)
                if v is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    f = features_of(w)
                    v = known[w] = min(float(weights[f].sum()), SURE_MOST if sure[f].any() else WORD_MOST)
                z += v
            return 1 / (1 + float(np.exp(-min(max(z, -500), 500))))

        return score


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    """Train on texts given as their distinct words joined by spaces. Without a positive or an unlabelled text every score is the prior."""
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS, bool), start)
    n_pos, n_unl = len(positive), len(unlabelled)
    n_docs = n_pos + n_unl
    ids: dict[str, int] = {}
    word, sizes = array("i"), array("i")
    for line in chain(positive, unlabelled):
        words = line.split(" ")
        word.extend(ids.setdefault(w, len(ids)) for w in words)
        sizes.append(len(words))
    n_words = len(ids)
    feature, widths = array("i"), array("i")
    for w in ids:
        found = features_of(w)
        feature.extend(found)
        widths.append(len(found))
    del ids
    word, feature = np.frombuffer(word, "int32"), np.frombuffer(feature, "int32")
    doc = np.repeat(np.arange(n_docs, dtype="int32"), np.frombuffer(sizes, "int32"))
    owner = np.repeat(np.arange(n_words, dtype="int32"), np.frombuffer(widths, "int32"))
    # evidence only adds up: features not clearly more common among the confirmed texts stay at zero
    in_pos = np.bincount(feature, np.bincount(word[doc < n_pos], minlength=n_words)[owner], BUCKETS)
    in_unl = np.bincount(feature, np.bincount(word[doc >= n_pos], minlength=n_words)[owner], BUCKETS)
    allowed = (in_pos >= max(SEEN_IN, SEEN_SHARE * n_pos)) & (prior * in_pos / n_pos >= TOXIC_SHARE * in_unl / n_unl)
    feature, owner = feature[allowed[feature]], owner[allowed[feature]]
    useful = np.bincount(owner, minlength=n_words) > 0
    word, doc = word[useful[word]], doc[useful[word]]
    # texts that show a feature: toxic ones show an ambiguous feature often, so its uses would say too much
    many = np.bincount(owner, minlength=n_words)[word]
    at = np.repeat(np.searchsorted(owner, word) - np.cumsum(many) + many, many) + np.arange(many.sum())
    shown = np.unique(np.repeat(doc.astype("int64"), many) * BUCKETS + feature[at])
    by_pos = shown // BUCKETS < n_pos
    pos_texts, unl_texts = (np.bincount(shown[side] % BUCKETS, minlength=BUCKETS) for side in (by_pos, ~by_pos))
    share = np.minimum(prior * pos_texts / n_pos / np.maximum(unl_texts / n_unl, 1e-12), 1)
    sure = allowed & (share - 1 / np.sqrt(np.maximum(pos_texts, 1)) >= SURE_SHARE)
    most = np.full(n_words, WORD_MOST)
    most[owner[sure[feature]]] = SURE_MOST
    active = np.flatnonzero(allowed)  # the rest stays at zero
    feature = np.searchsorted(active, feature)
    w, b = np.zeros(len(active)), start
    m, v = np.zeros(len(active) + 1), np.zeros(len(active) + 1)
    is_pos = np.arange(n_docs) < n_pos
    for step in range(1, STEPS + 1):
        value = np.bincount(owner, w[feature], n_words)
        z = np.bincount(doc, np.minimum(value, most)[word], n_docs) + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = np.logaddexp(0, z)  # of calling it toxic when it isn't
        negative = loss[~is_pos].mean() - prior * loss[is_pos].mean()
        as_negative = np.where(is_pos, -prior / n_pos * p, p / n_unl)
        # below zero the negative part is pushed back up, without the positive part
        slope = np.where(is_pos, prior / n_pos * (p - 1), 0) + as_negative if negative >= 0 else -as_negative
        by_word = np.bincount(word, slope[doc], n_words) * (value < most)  # beyond its bound a word has no slope
        g = np.concatenate([np.bincount(feature, by_word[owner], len(active)), [slope.sum()]])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        rate = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        move = rate * m / (1 - 0.9**step)
        w = np.maximum(w - move[:-1] - L1 * rate[:-1], 0)
        b -= move[-1]
    weights = np.zeros(BUCKETS, "float32")
    weights[active] = w
    return Model(weights, sure, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit from docs and from labels (id, 1 for confirmed toxic); the prior is the labelled share of toxic rows.

    Labels that are null or of unknown ids are left out; an id with several labels is toxic if one of
    them says so. The sample is bounded by POSITIVES and UNLABELLED; unlabelled texts are drawn from
    all docs, whatever their label. An id that stands more than once brings its least text only, so
    that repeated rows don't fill the driver. Without labels every score is the prior.
    """
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = label.agg(F.count("*"), F.sum("y")).first()
    prior = (counts[1] or 0) / counts[0] if counts[0] else 0.0

    def take(df: DataFrame, n: int, seed: int) -> list[str]:
        ids = df.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
        got = text.join(F.broadcast(ids.distinct()), "id").groupBy("id").agg(F.min("text").alias("text")).select("text")  # at most n texts

        def shorten(batches):
            for pdf in batches:
                yield pd.DataFrame({"words": [" ".join(words_of(t)) for t in pdf["text"]]})

        return sorted(r.words for r in got.mapInPandas(shorten, "words string").collect() if r.words)

    return fit(take(label.where("y = 1"), POSITIVES, 1), take(text, UNLABELLED, 2), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores; null and empty texts get the model's bias. A column named out is replaced."""
    kept = docs.drop(out)
    spread = kept.sparkSession.sparkContext.broadcast(model)  # 5 MB, whatever the data

    small_batches(docs.sparkSession)

    def run(batches):
        of = spread.value.scorer()
        for batch in batches:
            scores = [of(None if t is None else str(t)) for t in batch[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).alias(out)).schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the fifth of ids that no label is learnt from; a null id does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs.where(~held_out()), labels.where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; nulls, repeats and empty tables as train() and score() say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
