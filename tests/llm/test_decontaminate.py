import hashlib
import random
import re

from pyspark.sql import functions as F

from cadenza.llm import decontaminate
from cadenza.llm.decontaminate import contamination

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in SPLIT.split(text) if w]


def brute(docs, items):
    windows = []
    for item, text in items:
        w = brute_words(text)
        if w and item is not None:
            n = min(13, len(w))
            windows += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    out = []
    for d, text in docs:
        w = brute_words(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def corpus(rng, short):
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "ñandú"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(13, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "... !!"), (None, " ".join(say(20)))]
    if short:
        items += [(100 + n, " ".join([f"s{n}x{i}" for i in range(n)])) for n in (1, 2, 4, 5, 7, 12)]
    docs = [(0, None), (1, ""), (2, "!!!"), (3, "one"), (3, "one")]
    for d in range(4, 60):
        w = say(rng.randrange(5, 120))
        for _ in range(rng.randrange(0, 3)):
            src = brute_words(rng.choice(items)[1])
            a = rng.randrange(0, len(src) + 1)
            b = min(len(src), a + rng.randrange(8, 20))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = src[a:b]
        docs.append((d, ", ".join(w).title() if d % 3 else "-".join(w)))
    docs.append((70, " ".join(brute_words(items[0][1])) + " x" * 3000))
    return docs, items


def test_matches_brute_force(spark):
    for short in (False, True):
        docs, items = corpus(random.Random(5 + short), short)
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("g1", F.lit(1)).withColumn("item", F.lit(2))
        b = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash"))
        got = sorted((tuple(r) for r in contamination(d, b).collect()), key=str)
        want = brute(docs, items)
        assert got == want
        assert sum(r[5] for r in want) > 5


def test_short_items_beside_longer_ones(spark):
    long = " ".join(f"l{i}" for i in range(20))
    short = [(n, " ".join(f"s{n}x{i}" for i in range(n))) for n in (1, 2, 3, 4)]
    docs = [*short, *((10 + n, f"a b {t} c") for n, t in short), (20, "five a b c d five"), (21, "nothing here"), (22, long)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for others in ([(90, "a b c d five")], [(91, long)], [(90, "a b c d five"), (91, long)]):
        items = short + others
        got = sorted((tuple(r) for r in contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
        assert got == brute(docs, items)
        assert all(r[5] for r in got if r[0] < 20)


def test_every_length_of_items_by_shuffle(spark, monkeypatch):
    """Items of 1 to 14 words alone and mixed, with both sides of each join shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(n, " ".join(f"i{n}x{i}" for i in range(n))) for n in range(1, 15)]
    docs = [(100 + n, f"before it {t} and after it") for n, t in items] + [(200, None), (201, " ".join(t for _, t in items)), (201, "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for chosen in (items, items[3:6], [items[0], items[5], items[12]]):
        got = sorted((tuple(r) for r in contamination(d, spark.createDataFrame(chosen, "item_id long, text string")).collect()), key=str)
        assert got == brute(docs, chosen)


def test_a_window_of_many_items(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs, items = [(1, f"{text} x {text}"), (2, "none of it")], [(i, text) for i in range(300)]
    got = sorted((tuple(r) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, none).collect()) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), one).collect() == []
