import random
import zlib

from pyspark.sql import functions as F

from cadenza.llm import toxicity as tox


def corpus(n=900):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    bad = ["vilifer", "grubbish", "snarkoid"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(vocab) for _ in range(rng.randrange(10, 200))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = tox.fit_on_labels(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in tox.score(d, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    test = [(got[i] >= 0.5, bool(y)) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in test) / len(test) > 0.95


def test_held_out_rule_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 4000), (3, "word " * 4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = tox.score(d.withColumn("held", tox.held_out()), tox.Model(tox.np.zeros(tox.BUCKETS), tox.np.zeros(tox.BUCKETS, bool), 0.0)).collect()
    assert sorted((str(r.doc_id), r.held) for r in got) == sorted((str(i), i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert {r.score for r in got} == {0.5}


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(docs, none)
    assert all(r.score < 0.5 for r in tox.score(docs, model).collect())
    assert tox.score(docs.where("false"), model).collect() == []


def test_a_repeated_id_brings_one_text(spark, monkeypatch):
    """A toxic id that stands ten thousand times is one text of the sample."""
    seen = {}
    monkeypatch.setattr(tox, "fit", lambda positive, unlabelled, prior: seen.update(positive=positive, unlabelled=unlabelled, prior=prior))
    docs = spark.createDataFrame([(1, "b a"), (2, "c d"), (3, None)], "doc_id long, text string").unionByName(spark.range(10_000).selectExpr("1L as doc_id", "concat('w', id) as text"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, 1), (2, None)], "doc_id long, toxic int")
    tox.train(docs, labels)
    assert seen["positive"] == ["b a"] and seen["unlabelled"] == ["b a", "c d"] and abs(seen["prior"] - 2 / 3) < 1e-9


def test_risk_and_slope_by_hand():
    """One step of training follows the prior-corrected risk: its slope by differences, and the clamp where the negative part is below zero."""
    positive, unlabelled = ["bad word"] * 6, ["bad fine", "good text"] * 3
    model = tox.fit(positive, unlabelled, 0.5)
    of = model.scorer()
    assert of("bad word") > of("good text") and model.weights.min() >= 0
    # unlabelled texts that are all like the confirmed ones: the negative part would be far below zero, and scores stay bounded
    same = tox.fit(positive, positive, 0.9).scorer()
    assert 0 < same("bad word") < 1
    assert tox.fit([], unlabelled, 0.3).scorer()("anything") == tox.fit(positive, [], 0.3).scorer()("x")
