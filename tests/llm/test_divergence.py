import random
import re
from collections import Counter, defaultdict

from cadenza.llm.divergence import audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, top):
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for g, s in groups if g == lang)
        whole = Counter({t: sum(counts[lang, s][t] for s in mine) for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in mine}
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def rows():
    rng = random.Random(3)
    vocab = ["der", "Die", "das", "É", "é", "straße", "x", "日本", "Ñandú", "it's", "a1b", "ſ", "K"]
    out = []
    for i in range(160):
        lang = rng.choice(["en", "en", "en", "de", "fr", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", None, "S1"])
        out.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(30))), lang, source))
    out += [(500, None, "es", "only"), (501, "", "xx", "a"), (502, "12 34", "xx", "b"), (None, "der das", "en", "s1"), (503, "der " * 20_000, "en", "long")]
    return out + out[:5]  # rows that repeat


def got(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit(df, **more).collect())


def test_matches_brute_force(spark):
    data = rows()
    for least, top in ((1, 3), (8, 50)):
        assert got(spark.createDataFrame(data, SCHEMA), least_docs=least, top=top) == brute(data, least, top)


def test_no_kept_term_gives_pairs_of_zero(spark):
    data = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "c", "de", "x")]
    assert got(spark.createDataFrame(data, SCHEMA)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_empty_table_and_clashing_columns(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    data = rows()
    more = "".join(f", {c} string" for c in ("term", "terms", "n", "salt", "p", "item", "rank", "value", "part"))
    wide = spark.createDataFrame([(*r, *["clash"] * 9) for r in data], SCHEMA + more)
    assert got(wide, least_docs=5) == brute(data, 5, 50)
