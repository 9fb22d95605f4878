import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from cadenza.llm import importance
from cadenza.llm.importance import block_buckets, resample, suffix_array

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    held = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in held for b in f), Counter(b for _, x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for (doc_id, _), (n, f) in zip(docs, held, strict=True):
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def tables():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)] + ["É", "straße", "Ünï", "A", "日本"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "?!"), (903, "One"), (904, "one TWO"), (None, "w1 " * 30), (905, "w1 W2\x0bw3 " * 3000), (906, "x" * 50_000)]
    docs += docs[:40] + [(2000 + i, docs[7][1]) for i in range(30)]
    return docs, [(i, " ".join(rng.choice(vocab[:9]) for _ in range(30))) for i in range(12)] + [(99, None)]


def got(out):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()), key=repr)


def test_matches_brute_force(spark):
    docs, target = tables()
    out = resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(target, SCHEMA))
    want = brute(docs, target)
    assert sum(r[4] is not None for r in want) > 10
    assert got(out) == want


def test_empty_tables_and_clashing_columns(spark):
    docs, target = tables()
    none = spark.createDataFrame([], SCHEMA)
    assert got(resample(none, spark.createDataFrame(target, SCHEMA))) == []
    assert got(resample(spark.createDataFrame(docs, SCHEMA), none)) == brute(docs, [])
    more = "".join(f", {c} string" for c in ("weight", "score", "able", "part", "n_words", "rank", "bucket"))
    wide = spark.createDataFrame([(*d, *["clash"] * 7) for d in docs], SCHEMA + more)
    assert got(resample(wide, spark.createDataFrame(target, SCHEMA))) == brute(docs, target)


def test_blocks_of_any_size_count_alike():
    docs, _ = tables()
    texts = [t for _, t in docs if t is None or len(t) < 2000]
    want = [Counter(features(t)[1]) for t in texts]
    for block in (1, 2, 7, 100, 1 << 20):
        found = [Counter() for _ in texts]
        for tokens, left, doc in importance._blocks(texts, block, 3):
            for at in block_buckets(tokens, left):
                for d, b in zip(doc.tolist(), at.tolist(), strict=True):
                    if d >= 0 and b >= 0:
                        found[d][b] += 1
        assert found == want


def test_suffix_array_and_runs_by_hand():
    ids, left = np.array([1, 2, 1, 2, 3, 1, 2]), np.array([5, 4, 3, 2, 1, 2, 1])
    order, lcp = suffix_array(ids, left)
    cut = lambda i: ids[i : i + min(3, left[i])].tolist()
    assert [cut(i) for i in order] == sorted(cut(i) for i in range(7))
    assert lcp.tolist() == [0, 2, 2, 0, 1, 1, 0]
    wide = suffix_array(ids + (1 << 40), left)  # ids too wide for one key
    assert wide[0].tolist() == order.tolist() and wide[1].tolist() == lcp.tolist()


def test_ranks_over_ranges_are_those_of_one_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 5, 5, rng.randrange(1000)]), rng.random() < 0.9) for i in range(3000)]
    for share in (0, 1, 5, 50, 100):
        out = importance.ranked(spark.createDataFrame(rows, "doc_id long, score long, able boolean"), share, 16).collect()
        able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
        want = {r[0]: k for k, r in enumerate(able[: share * len(able) // 100], 1)}
        assert len(out) == len(rows)
        assert {r.doc_id: r["rank"] for r in out if r["rank"] is not None} == want
