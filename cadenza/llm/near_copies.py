"""SimHash near-duplicates at a similarity: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash links of simhash.py: the fingerprints of the shingle sets meet
through pigeonring chains at four differing bits or fewer. Pairs near 0.8 differ by five to twelve
bits, where a chain's first segment is no longer equal and a ring prunes nothing; SimHash alone would
lose them. So further candidates come from BANDS hashes of ROWS MinHash values each, of which a pair
at 0.8 shares none with a probability of (1 - 0.8 ** 5) ** 24, below 1 in 10,000. Every candidate of
either kind is then compared by its whole sets of shingles.

Documents of one band are compared with one of them, the pivot, and not with each other: the pivot
is the member that shares most bands with others, the original of a family of copies as a rule.
Members that are then linked are done. For a member o that isn't, and any other member x, let Do and
Dx be the symmetric differences of their sets with the pivot's. o and x are similar only if Do and Dx
share over half of Dx (but for their sizes, see `_apart`), so one of the rarest half of Dx must lie in
Do. Edits of independent copies have nothing rare in common and make no pair, however many there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches
from .components import connected
from .simhash import links, majority

SHINGLE = 5
#: Two sets are linked if SHARE[1] * |both| >= SHARE[0] * |either|.
SHARE = (4, 5)
BANDS = 24
ROWS = 5
#: Rows of (id, hash) up to which a side is broadcast (under 32 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 12
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64")


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of each run of `size` words; a shorter text is one run, a blank one has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "uint64")
    width = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), "uint64", len(starts)))


def bands(held: np.ndarray) -> list[int]:
    """BANDS signed hashes of the MinHash values of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(held), _CHUNK):
        least = np.minimum(least, (held[at : at + _CHUNK, None] * _TIMES + _PLUS).min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), "uint64", BANDS).view("int64").tolist()


def _name(held: np.ndarray) -> int:
    """A signed hash that names a set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes())).view("int64")) if len(held) else 0


def _sketches(batches):
    for pdf in batches:
        sets = [shingles(t) for t in pdf["text"]]
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "th": pdf["th"], "fp": [_name(s) for s in sets], "n": [len(s) for s in sets],
            "sim": [majority(s) for s in sets], "bands": [bands(s) if len(s) else [] for s in sets],
        })


def _sets(batches):
    for pdf in batches:
        sets = [shingles(t) for t in pdf["text"]]
        yield pd.DataFrame({"fp": pdf["fp"], "held": [s.view("int64") if _name(s) == fp else None for s, fp in zip(sets, pdf["fp"], strict=True)]})


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with alike, whether their sets are similar enough."""
    one, other = (sets.select(F.col("fp").alias(x), F.col("held").alias(f"held_{x}")) for x in "ab")
    both = F.size(F.array_intersect("held_a", "held_b"))
    either = F.size("held_a") + F.size("held_b") - both
    return cut(pairs.join(one, "a").join(other, "b").select("a", "b", (SHARE[1] * both >= SHARE[0] * either).alias("alike")), "near-links")


def _apart(compared: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of members of one pivot that aren't in one component, at least one of them unlike the pivot.

    Sets of sizes o and x are similar if they differ in (o + x) / 9 elements at most. A member unlike
    the pivot differs from it in more than (o + p) / 9, so it shares more than (Dx + (p - x) / 9) / 2
    elements with Dx, and Do and Dx share (Do + Dx - (o + x) / 9) / 2 at least. Where the first element
    that they share stands, in order of rarity, leaves room for so many in both or rules the pair out.
    """
    groups = compared.groupBy("a").agg(F.count("*").alias("members"), F.count_if(~F.col("alike")).alias("unlike")).where("members > 1 and unlike > 0").select("a")
    one, other = (sets.select(F.col("fp").alias(x), F.col("held").alias(f"held_{x}")) for x in "ab")
    of = compared.join(groups, "a", "left_semi").join(one, "a").join(other, "b")
    differs = F.concat(F.array_except("held_a", "held_b"), F.array_except("held_b", "held_a"))
    of = of.select("a", "b", "alike", differs.alias("d"), F.size("held_b").alias("n"), F.size("held_a").alias("p"))
    of = of.select("a", "b", "alike", "n", "p", F.size("d").alias("size"), F.explode("d").alias("e"))
    of = cut(of, "near-differences")
    # elements that one member alone shows come first in the order of rarity and meet no other
    known = of.groupBy("a", "e").agg(F.count("*").alias("shown")).where("shown > 1")
    of = cut(of.join(known, ["a", "e"]), "near-shared")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("shown", "e"))
    # elements from this one on
    of = of.withColumn("rest", F.count("*").over(Window.partitionBy("a", "b")) - rank + 1)
    share = SHARE[1] + SHARE[0]
    needed = F.floor((share * F.col("size") + F.col("p") - F.col("n")) / F.lit(2 * share)) + 1
    one, other = (of.select("a", "e", *[F.col(c).alias(f"{c}_{x}") for c in ("b", "alike", "n", "size", "rest")], needed.alias(f"needed_{x}")) for x in "ox")
    met = other.where("rest_x >= needed_x").join(one.where("not alike_o"), ["a", "e"]).where("b_x <> b_o")
    room = 2 * share * F.least("rest_o", "rest_x") >= share * (F.col("size_o") + F.col("size_x")) - F.col("n_o") - F.col("n_x")
    met = met.where(room).select(F.least("b_o", "b_x").alias("a"), F.greatest("b_o", "b_x").alias("b")).distinct()
    root_a, root_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    met = met.join(root_a, "a", "left").join(root_b, "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _by_simhash(distinct: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets (fp, sim) whose SimHash fingerprints are equal or linked by the pigeonring."""
    heads = cut(distinct.groupBy("sim").agg(F.min("fp").alias("head")), "near-heads")
    twins = distinct.join(heads, "sim").where("fp > head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    one, other = (heads.select(F.col("sim").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
    linked = links(heads.select(F.col("sim").alias("fp"))).join(one, "a").join(other, "b")
    return twins.unionByName(linked.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, component and component_id of every row.

    th is the hash of its text, component names its group and component_id is the least doc_id in it.

    Blank and null texts are copies of each other. An id may stand more than once, with equal or
    different texts. Empty tables give an empty result; columns of any name may stand beside.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = cut(rows.mapInPandas(_sketches, "doc_id long, th long, fp long, n long, sim long, bands array<long>"), "near-sketches")
    least = cut(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.min("sim").alias("sim"), F.min("n").alias("n")), "near-distinct")
    keys = prints.select("fp", F.explode("bands").alias("key")).distinct()
    keys = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "near-keys")
    central = keys.groupBy("fp").agg(F.sum("size").alias("degree"))
    pivots = keys.join(central, "fp").groupBy("key").agg(F.max(F.struct("degree", "fp")).alias("most")).select("key", F.col("most.fp").alias("pivot"))
    starred = cut(keys.join(pivots, "key").where("fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct(), "near-stars")
    others = cut(_by_simhash(least.where("n > 0").select("fp", "sim")), "near-simhash")

    asked = starred.select("a").union(starred.select("b")).union(others.select("a")).union(others.select("b")).distinct().withColumnRenamed("a", "fp")
    asked = cut(least.join(asked, "fp").select("fp", "at.doc_id", "at.th"), "near-asked")
    texts = rows.join(_small(asked), ["doc_id", "th"]).select("fp", "text")
    sets = cut(texts.mapInPandas(_sets, "fp long, held array<long>").where("held is not null").dropDuplicates(["fp"]), "near-sets")

    compared = _compared(starred, sets)
    similar = compared.where("alike").select("a", "b").unionByName(_compared(others, sets).where("alike").select("a", "b"))
    roots = connected(similar, "a", "b")
    more = _compared(_apart(compared, sets, roots), sets).where("alike").select("a", "b")
    if not more.isEmpty():
        roots = connected(similar.unionByName(more), "a", "b")
    for part in (keys, starred, others, sets, asked, compared):
        drop_cut(part)

    named = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "at.doc_id")
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(names, "root").select("fp", F.col("root").alias("component"), "component_id"), "near-components")
    return prints.select("doc_id", "th", "fp").join(named, "fp").select("doc_id", "th", "component", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, and of two texts of that id the one of lesser hash.

    Rows without an id stay. Of rows that repeat one stays. Blank and null texts are one group. Empty
    tables give an empty result; columns of any name stay as they are.
    """
    named = docs.where(F.col(id_col).isNotNull())
    id_, th = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    found = components(named, id_col, text_col).groupBy("component", "doc_id", "th").agg(F.count("*").alias("copies"))
    found = cut(found.select("component", "copies", F.struct("doc_id", "th").alias("_near")), "near-groups")
    # by id and text, of which each is one row, and not by component, of which one may hold a third of all
    first = cut(found.groupBy("component").agg(F.min("_near").alias("_near")).select("_near"), "near-first")
    gone = found.select("_near").join(first, "_near", "left_anti")
    again = found.where("copies > 1").select("_near").join(first, "_near", "left_semi")
    # rows as structs: their columns may have any name
    whole = named.select(F.struct("*").alias("_row"), F.struct(id_.alias("doc_id"), th.alias("th")).alias("_key"))
    same = F.col("_key") == F.col("_near")
    kept = whole.join(_small(gone.unionByName(again)), same, "left_anti").select("_row.*")
    if not again.isEmpty():
        once = whole.join(_small(again), same, "left_semi").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        kept = kept.unionByName(once.select("_row.*"))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
