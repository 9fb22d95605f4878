import random

import corpus_pipeline as pipeline
from cadenza.llm import suffix_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, docs, labels, items):
    row = lambda d, t: (d, t, "en", "hot" if d is None or d % 3 else "s", len(t or ""))
    spark.createDataFrame([row(*x) for x in docs], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = say(rng.randrange(20, 90))
        docs.append((i, f"{text} vilifer grubbish {say(5)}" if toxic else text))
        labels.append((i, 1, int(toxic)))
    item = say(40)
    passage = say(70)
    docs += [(300, docs[1][1]), (301, f"{say(10)} {item} {say(8)}"), (302, f"{say(30)} {passage} {say(30)}"), (303, f"{say(25)} {passage} {say(35)}"), (304, None), (305, ""), (None, "no id"), (1, docs[1][1]), (306, say(6000))]
    return docs, labels, [(1, item), (2, None)], passage


def test_stages_take_effect(spark, tmp_path):
    docs, labels, items, passage = corpus()
    tables(spark, tmp_path, docs, labels, items)
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in pipeline.STAGES:
        before = held
        out = stage(spark, held, str(tmp_path))
        if name != "packing":
            assert out.columns == held.columns
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = held.collect()
    ids = lambda name: [r.doc_id for r in left[name]]
    assert not {i for i in range(0, 300, 6)} & set(ids("toxicity"))
    assert {i for i in range(300) if i % 6} <= set(ids("toxicity"))
    assert 300 not in ids("near_dedup") and ids("near_dedup").count(1) == 1 and None in ids("near_dedup")
    text = {r.doc_id: r.text for r in left["near_dedup"]}
    kept = {r.doc_id: r for r in left["suffix_dedup"]}
    assert passage[60:200] not in kept[302].text and passage[60:200] not in kept[303].text
    assert all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)
    order = sorted(text, key=str)
    removed = [x[1] for x in suffix_dedup.brute_force([text[i] for i in order])]
    assert [len((text[i] or "").encode()) - len((kept[i].text or "").encode()) for i in order] == removed
    assert 301 not in ids("decontaminate") and {302, 306} <= set(ids("decontaminate"))
    tokens = sum(len((r.text or "").split()) for r in left["decontaminate"])
    assert sum(r.n_tokens for r in left["packing"]) == tokens and before.count() == len(left["decontaminate"])


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [(1, "x")], [(1, 1, 0)], [(1, "y")])
    for name in ("documents", "labels", "benchmark"):
        t = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        t.where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").collect() == []
    assert pipeline.run(spark, str(tmp_path)).count() == 1
