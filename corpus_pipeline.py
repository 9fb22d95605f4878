"""Cleaning pipeline over `documents`: five stages, each written as Parquet and read by the next.

Every stage takes whole tables, keeps the columns of documents (the last returns pieces in bins) and
gives defined results for nulls, empty texts, repeated rows, ties and empty tables, as its operator's
docstring says: texts without words pass all filters, of rows that repeat near_dedup keeps one, and
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import cut, table
from cadenza.llm.decontaminate import drop_contaminated
from cadenza.llm.near_copies import keep_one_each
from cadenza.llm.packing import pack
from cadenza.llm.suffix_dedup import remove_repeats
from cadenza.llm.toxicity import fit_on_labels, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; null and empty texts stay. Rows that repeat stay or go together."""
    model = fit_on_labels(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    out = "toxicity"
    while out in docs.columns:
        out += "_"
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return score(docs, model, out=out).where(empty | (F.col(out) < 0.5)).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more, that of the smallest doc_id; rows without an id stay."""
    return keep_one_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that stand more than once; n_chars follows the text, which stays null where it was."""
    out = remove_repeats(docs, as_text=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages; rows without an id and texts without words stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of at most 2,048 tokens over all documents left; null and blank texts are pieces without tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Hash-trained models, connected components and sequential packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, piece, first_token, n_tokens, source, bin_id and bin_offset. Nulls, repeats and empty tables as above."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
