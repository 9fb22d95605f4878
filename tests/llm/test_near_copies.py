import random

from pyspark.sql import functions as F

from cadenza.llm import near_copies


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        n = min(5, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def brute_components(texts):
    """{doc_id: least doc_id reachable} by comparing every pair."""
    sets = brute_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                a_root, b_root = find(i), find(j)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return {i: find(i) for i in range(len(texts))}


def test_every_pair_of_0_8_is_linked_and_none_below(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    texts = [None, "", "one", "One", "one two three", " "]
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    family = [rng.choice(vocab) for _ in range(200)]  # a chain of edits: its ends are less alike than 0.8
    for _ in range(40):
        family[rng.randrange(200)] = rng.choice(vocab)
        texts.append(" ".join(family))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in near_copies.components(df).collect()} == want
    assert sorted(r.doc_id for r in near_copies.keep_one_each(df).collect()) == sorted(set(want.values()))
    sets = brute_sets(texts)
    near = sum(4 * len(a | b) <= 5 * len(a & b) < 5 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert near > 50


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "G h i j k l"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in near_copies.keep_one_each(df).collect()) == [(0, "x"), (1, "a b c d e f"), (1, "g h i j k l")]
    assert near_copies.keep_one_each(df.where("false")).collect() == []


def test_no_text_is_lost_and_none_stays_twice(spark):
    """An id with two texts, one of which another id holds too; repeated rows; columns of clashing names; both kinds of join."""
    rows = [(5, "a " * 9), (5, "b " * 9), (3, "a " * 9), (7, "c d"), (7, "c d"), (8, None), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("th", "fp", "component_id", "_copy", "_near", "n", "key")})
    want = [(3, "a"), (5, "b"), (7, "c d"), (8, "")]
    for limit in (near_copies.BROADCAST_ROWS, 0):
        near_copies.BROADCAST_ROWS, before = limit, near_copies.BROADCAST_ROWS
        out = near_copies.keep_one_each(df)
        near_copies.BROADCAST_ROWS = before
        assert out.columns == df.columns
        assert sorted((r.doc_id, " ".join(dict.fromkeys((r.text or "").split()))) for r in out.collect()) == want


def test_a_family_makes_no_pairs(spark, monkeypatch):
    """Copies of one text with independent edits, some within the similarity of it and many just beyond, and edits of edits among those."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
        if i % 20 == 0:
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts)
    tried, before = [], near_copies._apart
    monkeypatch.setattr(near_copies, "_apart", lambda *a: tried.append(before(*a).count()) or before(*a))
    assert {r.doc_id: r.component_id for r in near_copies.components(df).collect()} == want
    assert 30 < len(set(want.values())) < len(texts)
    assert 0 < tried[0] < len(texts)
