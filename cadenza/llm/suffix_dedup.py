"""Removal of repeated byte strings by a distributed, hash-compared suffix sort.

A byte goes if some string of `span` bytes that covers it also starts anywhere else. Sorting all
suffixes of the corpus would ship `span` bytes for each of them, so suffixes are bucketed by content
first: every window of `span` bytes is filed under its anchor, the GRAM bytes of least polynomial
hash in it. Equal windows have equal anchors at equal offsets. The windows of one occurrence of an
anchor form one context.

1. Anchors that occur once hold no repeated window; equal contexts that occur twice hold nothing else.
2. What is left are contexts that share an anchor and differ somewhere. Their window suffixes are
   merge-sorted within each (anchor, offset) bucket. Two suffixes are compared through prefix
   polynomial hashes: binary search finds their common extension in log2(span) steps, and one byte
   decides. Neighbours with a common extension of `span` are repeats once their bytes agree.
3. Anchors with more than CONTEXTS different contexts don't go to one sort: their windows are dealt out
   by a 128-bit hash of the window and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, table

SPAN = 200
GRAM = 64
#: Contexts of one anchor that are sorted together (under 2 MB).
CONTEXTS = 4096
#: Occurrences of an anchor from which its contexts are dealt to salts, and how many.
CROWDED = 4096
SALTS = 64
#: Bytes of a text that are hashed at a time, so that memory doesn't grow with the text.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BYTES_2 = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 4096), base, dtype="uint64")
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype="uint64")
    return have[: n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(data: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """p[i]: polynomial hash of data[:i], from which the hash of any slice follows."""
    out = np.zeros(len(data) + 1, dtype="uint64")
    np.cumsum(values[data] * _power(_BASE, len(data))[:-1], out=out[1:], dtype="uint64")
    return out


def slice_hashes(p: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hash of each slice, the same wherever it stands."""
    return (p[start + length] - p[start]) * _power(_INVERSE, len(p))[start]


def anchors(data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, hash of the context, first window start, last window start) of each anchor of a piece."""
    n = len(data) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in ("int64", "int64", "int64", "int64"))
    p = prefix_hashes(data)
    grams = len(data) - GRAM + 1
    v = _mix((p[GRAM:] - p[:grams]) * _power(_INVERSE, len(p))[:grams])
    hashes, at, width, need = v, np.arange(grams, dtype="int32"), 1, span - GRAM + 1
    while width < need:
        step = min(width, need - width)
        left = v[:-step] <= v[step:]
        at = np.where(left, at[:-step], at[step:])
        v = np.where(left, v[:-step], v[step:])
        width += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    anchor = at[first].astype("int64")
    context = slice_hashes(p, first, last - first + span)
    context = _mix(context + _mix(((anchor - first) * 1024 + (last - first)).astype("uint64")))
    return hashes[anchor].view("int64"), context.view("int64"), first, last


class Suffixes:
    """Suffixes of one byte buffer, compared by the hashes of their prefixes."""

    def __init__(self, buffer: np.ndarray, span: int):
        self.bytes, self.span, self.p = buffer, span, prefix_hashes(buffer)
        self.inverse = _power(_INVERSE, len(self.p))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension from a and from b, up to span, by binary search."""
        low, high = np.zeros(len(a), "int64"), np.full(len(a), self.span, "int64")
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.p[a + mid] - self.p[a]) * self.inverse[a] == (self.p[b + mid] - self.p[b]) * self.inverse[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.minimum(self.common(a, b), self.span - 1)
        return self.bytes[a + n] < self.bytes[b + n]

    def sort(self, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Order of the suffixes by bucket and content: a bottom-up mergesort of all buckets at once."""
        order = np.argsort(bucket, kind="stable")
        sorted_bucket = bucket[order]
        new = np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1]])
        head = np.flatnonzero(new)
        base = np.repeat(head, np.diff(np.concatenate([head, [len(order)]])))
        size = np.repeat(np.diff(np.concatenate([head, [len(order)]])), np.diff(np.concatenate([head, [len(order)]])))
        run, most = 1, int(size.max(initial=0))
        while run < most:
            place = np.arange(len(order)) - base
            mine = place // run
            other = (mine ^ 1) * run
            has = other < size
            i = np.flatnonzero(has)
            low = np.zeros(len(i), "int64")
            high = np.minimum(run, size[i] - other[i])
            right = (mine[i] & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                x = start[order[i[open_]]]
                y = start[order[base[i[open_]] + other[i[open_]] + mid]]
                before = np.where(right[open_], ~self.less(x, y), self.less(y, x))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = place.copy()
            to[i] = (mine[i] // 2) * 2 * run + place[i] - mine[i] * run + low
            merged = np.empty_like(order)
            merged[base + to] = order
            order = merged
            run *= 2
        return order

    def repeated(self, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether another suffix of the bucket begins with the same span of bytes."""
        out = np.zeros(len(start), bool)
        if len(start) < 2:
            return out
        order = self.sort(bucket, start)
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(bucket[a] == bucket[b])
        near = near[self.common(start[a[near]], start[b[near]]) == self.span]
        windows = np.lib.stride_tricks.sliding_window_view(self.bytes, self.span)
        for at in range(0, len(near), 1 << 14):  # collisions of hashes end here
            part = near[at : at + (1 << 14)]
            part = part[(windows[start[a[part]]] == windows[start[b[part]]]).all(1)]
            out[a[part]] = out[b[part]] = True
        return out


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and of the last of each run of consecutive starts of one doc."""
    breaks = (np.diff(start) != 1) | (doc[1:] != doc[:-1])
    first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    return first, np.concatenate([first[1:], [len(start)]]) - 1


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, th, spans) for documents with columns k, th and text: spans are [first, last] window starts that repeat.

    k and th must identify a text (not a row); rows may repeat, which makes all of their windows repeat.
    """
    if span <= GRAM or span > 1023:
        raise ValueError("span must lie between GRAM + 1 and 1023 bytes")
    small_batches(docs.sparkSession)

    def find(batches):
        for batch in batches:
            ks, ths, cols = [], [], []
            for k, th, text in zip(batch["k"], batch["th"], batch["text"], strict=True):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), dtype="uint8")
                for at in range(0, max(0, len(data) - span + 1), PIECE):
                    h, c, lo, hi = anchors(data[at : at + PIECE + span - 1], span)
                    cols.append((h, c, lo + at, hi + at))
                    ks.append(np.full(len(h), k.as_py()))
                    ths.append(np.full(len(h), th.as_py()))
            if ks:
                h, c, lo, hi = (np.concatenate(x) for x in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(ks), np.concatenate(ths), h, c, lo, hi)], names=["k", "th", "h", "c", "lo", "hi"])

    found = cut(docs.mapInArrow(find, "k long, th long, h long, c long, lo long, hi long"), "suffix-anchors")
    # counts are written before they are joined: only a join of two plain reads is split where a key is hot
    often = found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h", (F.col("times") > CROWDED).alias("crowded"))
    shared = cut(found.join(cut(often, "suffix-often"), "h"), "suffix-shared")
    classes = shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "lo", "hi")).alias("rep"), F.first("crowded").alias("crowded"))
    classes = cut(classes, "suffix-classes")
    open_ = classes.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("contexts")).where("least = 1").select("h", "contexts")
    open_ = cut(open_, "suffix-open")
    todo = classes.join(open_, "h").select("rep.*", "h", "n", (F.col("contexts") > CONTEXTS).alias("hot"))
    jobs = todo.groupBy("k", "th").agg(F.collect_list(F.struct("h", "n", "lo", "hi", "hot")).alias("jobs"))
    jobs = jobs.withColumnsRenamed({"k": "jk", "th": "jth"})
    fetch = docs.join(jobs, (docs.k == F.col("jk")) & (docs.th == F.col("jth"))).select("k", "th", "text", "jobs")

    def contexts(batches):
        for pdf in batches:
            rows = []
            for k, th, text, todo_ in zip(pdf["k"], pdf["th"], pdf["text"], pdf["jobs"], strict=True):
                data = (text or "").encode("utf-8", "replace")
                rows += [(k, th, j["h"], j["n"], j["lo"], j["hot"], data[j["lo"] : j["hi"] + span]) for j in todo_]
            yield pd.DataFrame(rows, columns=["k", "th", "h", "n", "lo", "hot", "bytes"])

    # a repeated row would bring its contexts twice: a text is fetched once
    fetched = fetch.dropDuplicates(["k", "th"]).mapInPandas(contexts, "k long, th long, h long, n long, lo long, hot boolean, bytes binary")
    fetched = cut(fetched, "suffix-contexts")

    def laid_out(pdf: pd.DataFrame):
        """Buffer of all contexts, and of each window: its row, its place in the buffer and its offset from the anchor's context start."""
        lengths = np.fromiter(map(len, pdf["bytes"]), "int64", len(pdf))
        buffer = np.frombuffer(b"".join(pdf["bytes"]), dtype="uint8")
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        per = lengths - span + 1
        row = np.repeat(np.arange(len(pdf)), per)
        within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        return buffer, row, begin[row] + within, within

    def sort(batches):
        """Windows of one partition whose span repeats; equal windows share the anchor, so they are in one partition."""
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += sum(map(len, pdf["bytes"]))
            if size > 1 << 20:  # anchors come sorted: all but the last are complete
                both = pd.concat(held)
                whole = both["h"] != both["h"].iloc[-1]
                if whole.any():
                    yield from solve(both[whole])
                held, size = [both[~whole]], 0
        if held and len(both := pd.concat(held)):
            yield from solve(both)

    def solve(pdf):
        buffer, row, start, within = laid_out(pdf)
        s = Suffixes(buffer, span)
        anchor = anchor_offset(s, pdf, row, start, within)
        h = pdf["h"].to_numpy()[row]
        bucket = pd.factorize(h)[0] * 1024 + anchor
        again = s.repeated(bucket, start) & (pdf["n"].to_numpy()[row] == 1)
        at = np.flatnonzero(again)
        if len(at):
            lo = pdf["lo"].to_numpy()[row[at]] + within[at]
            first, last = _runs(row[at], lo)
            src = row[at][first]
            yield pd.DataFrame({"k": pdf["k"].to_numpy()[src], "th": pdf["th"].to_numpy()[src], "lo": lo[first], "hi": lo[last]})

    def anchor_offset(s, pdf, row, start, within):
        """Distance from each window to its anchor: where the anchor's hash stands in the context."""
        grams = len(s.bytes) - GRAM + 1
        v = _mix((s.p[GRAM:] - s.p[:grams]) * s.inverse[:grams]).view("int64")
        lengths = np.fromiter(map(len, pdf["bytes"]), "int64", len(pdf))
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.zeros(len(pdf), "int64")
        for i, (b, n, h) in enumerate(zip(begin.tolist(), lengths.tolist(), pdf["h"].tolist(), strict=True)):
            place[i] = int((v[b : b + n - GRAM + 1] == h).argmax())
        return place[row] - within

    schema = "k long, th long, lo long, hi long"
    usual = fetched.where("not hot").drop("hot")
    sorted_ = usual.repartition("h").sortWithinPartitions("h").mapInPandas(sort, schema)

    def windows(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                buffer, row, start, within = laid_out(part)
                second = prefix_hashes(buffer, _BYTES_2)
                w1 = slice_hashes(prefix_hashes(buffer), start, span).view("int64")
                w2 = _mix(slice_hashes(second, start, span)).view("int64")
                yield pd.DataFrame({"k": part["k"].to_numpy()[row], "th": part["th"].to_numpy()[row], "n": part["n"].to_numpy()[row], "lo": part["lo"].to_numpy()[row] + within, "w1": w1, "w2": w2})

    dealt = cut(fetched.where("hot").mapInPandas(windows, "k long, th long, n long, lo long, w1 long, w2 long"), "suffix-windows")
    twice = dealt.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
    twice = cut(twice, "suffix-twice")
    counted = dealt.where("n = 1").join(twice, ["w1", "w2"]).select("k", "th", "lo", F.col("lo").alias("hi"))

    # the one row of a context that stands very often is copied to each salt, its occurrences are dealt to them
    salt = F.when(F.col("crowded"), F.pmod(F.xxhash64("k", "th", "lo"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.explode(F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    same = shared.withColumn("salt", salt).join(classes.where("n > 1").select("h", "c", salts), ["h", "c", "salt"]).select("k", "th", "lo", "hi")
    spans = same.unionByName(sorted_).unionByName(counted)
    return spans.groupBy("k", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def covered(spans, span: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes under windows that start in [lo, hi]."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + span))
        else:
            out.append((lo, hi + span))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, as_text: bool = False) -> DataFrame:
    """Columns row (the document as it came), kept (binary, or with as_text a string without cut characters), n_bytes, n_removed and n_spans, for each row.

    Texts are judged as UTF-8 bytes on the input, all copies of a repeated string alike; matches never
    cross documents. Null texts count as empty, and texts under `span` bytes stay whole. A row that
    stands twice repeats itself wholly. Columns of any name may stand beside the id and the text.
    """
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(keyed.select("k", "th", "text"), span).withColumnsRenamed({"k": "sk", "th": "sth"})
    both = keyed.join(spans, (keyed.k == F.col("sk")) & (keyed.th == F.col("sth")), "left").select("row", "spans")

    def apply(batches):
        for batch in batches:
            kept, sizes, gone, runs = [], [], [], []
            for text, found in zip(batch["row"].field(text_col).to_pylist(), batch["spans"].to_pylist(), strict=True):
                data = ("" if text is None else str(text)).encode("utf-8", "replace")
                cuts = covered([(x["lo"], x["hi"]) for x in found or ()], span)
                ends = [0, *(x for pair in cuts for x in pair), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                sizes.append(len(data))
                gone.append(len(data) - len(rest))
                runs.append(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))],
                names=["row", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    schema = T.StructType([
        T.StructField("row", docs.schema), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    ])
    return both.mapInArrow(apply, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what repeats; nulls, repeats and empty tables as remove_repeats() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """The same result for a few texts, by looking at every string."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - span + 1):
            w = d[i : i + span]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        cuts = covered([(i, i) for i in range(len(d) - span + 1) if seen[d[i : i + span]] > 1], span)
        ends = [0, *(x for pair in cuts for x in pair), len(d)]
        kept = b"".join(d[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
        out.append((len(d), len(d) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
    return out
