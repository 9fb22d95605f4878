import math
import random
from collections import defaultdict

import xxhash

from cadenza.llm import quality_lm as q


def brute(trusted, text):
    """Perplexity by the textbook formulas, with dictionaries."""
    raw = defaultdict(int)
    for t in trusted:
        c = q.codes(t).tolist()
        for i in range(len(c) - 3):
            raw[tuple(c[i : i + 4])] += 1
    counts = {4: dict(raw)}
    for n in (3, 2, 1):
        counts[n] = defaultdict(int)
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    disc = {n: q.KneserNey._discount([sum(v == i for v in counts[n].values()) for i in (1, 2, 3, 4)]) for n in counts}

    def d(n, c):
        return 0 if c == 0 else disc[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        c = counts[n].get(g, 0)
        follow = [v for k, v in counts[n].items() if k[:-1] == g[:-1]]
        lower = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if not follow:
            return lower
        return (c - d(n, c) + sum(d(n, v) for v in follow) * lower) / sum(follow)

    c = q.codes(text).tolist()
    logs = [math.log(p(tuple(c[i : i + 4]))) for i in range(len(c) - 3)]
    return math.exp(-sum(logs) / len(logs)) if logs else None


def test_matches_textbook(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "and", "tion", "er", "ing", "Straße", "über", "ox"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(3, 25))), "en" if i % 3 else "de") for i in range(30)]
    rows += [(30, None, "en"), (31, " \n", None), (32, "zzqqxx \U0001f600!", None), (None, "the ox", "en"), (33, rows[1][1] * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in range(0, 30, 2)] + [(None,)], "doc_id long")
    got = {(r.doc_id, r.lang): r.perplexity for r in q.perplexities(docs, ids).collect()}
    half = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) & 1
    trusted = [[t for i, t, _ in rows if i is not None and i < 30 and i % 2 == 0 and half(t) != h] for h in (0, 1)]
    assert min(map(len, trusted)) > 3 and len(got) == len(rows)
    for i, t, lang in rows:
        want = brute(trusted[half(t)], t)
        assert (got[i, lang] is None) if want is None else math.isclose(got[i, lang], want, rel_tol=1e-4), (i, t)


def test_quantiles_and_empty(spark):
    rows = [(i, "en", 10, float(i)) for i in range(100)] + [(100 + i, None, 10, float(i)) for i in range(10)] + [(200, "en", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_codes long, perplexity double")
    kept = {r.doc_id for r in q.keep_by_perplexity(df, 0.1, 0.9).collect() if r.keep}
    assert kept == {*range(9, 90), *range(100, 109)}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert q.perplexities(none, none.select("doc_id")).collect() == []
    one = q.perplexities(spark.createDataFrame([(1, "ab", "x")], none.schema), none.select("doc_id")).first()
    assert one.perplexity is not None
