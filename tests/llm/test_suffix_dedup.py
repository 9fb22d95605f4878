import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import suffix_dedup as sd


def corpus():
    rng = random.Random(11)
    syll = ["the ", "of ", "an", "er", "ñ", "é", "tion ", "\n", "sh"]
    say = lambda n: "".join(rng.choice(syll) for _ in range(n))
    passage = say(160)
    texts = [None, "", "short", "a" * 500, "ab " * 300, say(300)]
    texts += [texts[5]] * 2
    for i in range(24):
        cut_ = rng.randrange(0, 60)
        texts.append(say(rng.randrange(0, 200)) + passage[cut_ : len(passage) - rng.randrange(0, 40)] + say(rng.randrange(0, 200)))
    base = say(400)
    for _ in range(8):
        at = rng.randrange(0, len(base) - 5)
        texts.append(base[:at] + rng.choice(syll) + base[at + 3 :])
    texts.append(base[:300] + base[:300])
    return texts


@pytest.mark.parametrize(("contexts", "crowded"), [(4096, 4096), (2, 2), (4096, 1)])
def test_matches_brute_force(spark, monkeypatch, contexts, crowded):
    monkeypatch.setattr(sd, "CONTEXTS", contexts)
    monkeypatch.setattr(sd, "CROWDED", crowded)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("k", F.lit(1.5))
    out = sd.remove_repeats(df).collect()
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out}
    want = dict(enumerate(sd.brute_force(texts)))
    assert got == want
    assert all(r.row.k == 1.5 and r.row.spans == "clash" for r in out)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "x" * 30 + "unique words only once " * 20), (1, "x" * 30 + "unique words only once " * 20), (None, "".join(map(chr, range(97, 400))))]
    out = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in out) == sorted(x[:3] for x in sd.brute_force([t for _, t in rows]))
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype("uint8")
    data[1000:1400] = data[200:600]
    s = sd.Suffixes(data, 200)
    start = rng.permutation(2800)[:900]
    bucket = rng.integers(0, 5, 900)
    order = s.sort(bucket, start)
    keys = [(int(bucket[i]), bytes(data[start[i] : start[i] + 200])) for i in order]
    assert keys == sorted(keys)
    windows = [(int(b), bytes(data[x : x + 200])) for b, x in zip(bucket, start, strict=True)]
    assert s.repeated(bucket, start).tolist() == [windows.count(w) > 1 for w in windows]
