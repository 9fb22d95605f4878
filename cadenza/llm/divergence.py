"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language.

Terms are counted per (lang, source, term) inside the tasks that read the texts and their sums added, the
groups of a language are crossed with its kept vocabulary so that zeros count, a self-join on language
and term gives each pair of sources once, and windows rank what is summed. Joins that a language alone
would key carry a salt of the term, so a language may hold any share of the terms; no side is broadcast
but by its written size.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches, table

#: Bytes of terms with A-Z lower-cased, and blanks for all others; terms that a task holds.
SPLIT = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
HELD = 200_000
#: Documents of a language that hold a kept term, pseudo-count, scale of shares, and ranks of terms.
LEAST_DOCS = 30
PSEUDO = 5
SCALE = 1_000_000_000
TOP = 50
#: Salts of joins by language.
SALTS = 64


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it).

    Terms are runs of bytes, since all bytes of a character beyond ASCII belong to it. A task adds up
    HELD terms before it hands its sums on.
    """
    row = _row(docs, text_col, lang_col, source_col)
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def sums():
            for (lang, source), (n, d) in held.items():
                if n:
                    terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                    same = lambda x, many=len(n): pa.array([x], pa.string()).take(pa.array([0] * many))
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array((d[t] for t in n), pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for text, lang, source in zip(texts, b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(SPLIT).split()
                size -= len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from sums()
                    size = 0
        yield from sums()

    each = row.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _row(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in named.items()))


def _share(n: str, total: str, kinds: str):
    """1 + floor(SCALE * (n + PSEUDO) / (total + PSEUDO * kinds)), in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {PSEUDO} as decimal(20,0))) div cast({total} + {PSEUDO} * {kinds} as decimal(20,0))")


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance to the language's other sources, and its `top` most over-represented terms.

    Null text, lang and source are read as ''. Every row is a document of its own, so rows that repeat
    count as often as they stand. A language without a kept term has pairs of value 0; a language with
    one source has no pairs. Ties go by the item's bytes. Empty tables give an empty result; further
    columns don't matter.
    """
    groups = cut(_row(docs, text_col, lang_col, source_col).select("lang", "source").distinct(), "audit-groups")
    counts = cut(term_counts(docs, text_col, lang_col, source_col), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "all_n", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")), "audit-kept")
    langs = cut(kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all_n").alias("lang_total")), "audit-langs")

    # counts of kept terms with the language's, and the groups' totals over them
    held = cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").select("lang", "source", "kinds", "lang_total", F.coalesce("total", F.lit(0)).alias("total"))
    totals = cut(totals, "audit-totals")

    dense = kept.join(_salted(totals), ["lang", "salt"]).select("lang", "source", "term", "kinds", "total")
    dense = dense.join(held.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    share = _share("coalesce(n, 0)", "total", "kinds")
    dense = cut(dense.select("lang", "source", "term", share.alias("p")), "audit-dense")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    once = dense.join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))
    once = once.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    bare = groups.join(langs, "lang", "left_anti")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("long"))
    once = once.unionByName(bare)
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = once.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value", F.lit("pair").alias("part"))

    over = held.join(_salted(totals), ["lang", "source", "salt"])
    over = over.select("lang", "source", F.col("term").alias("item"), _share("n", "total", "kinds").alias("p"), _share("all_n", "lang_total", "kinds").alias("q")).where("p > q")
    over = over.select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, over)]
    ranked[1] = ranked[1].where(F.col("rank") <= top)
    out = ranked[0].unionByName(ranked[1])
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language; nulls, repeats and empty tables as audit() says."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS kinds, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.*, 1 + ({SCALE}::HUGEINT * (n + {PSEUDO})) // (sum(n) OVER (PARTITION BY lang, source) + {PSEUDO} * kinds) AS p FROM x JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {PSEUDO})) // (total + {PSEUDO} * kinds) AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= {TOP}
"""
