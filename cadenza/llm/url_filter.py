"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions and Spark's own tree ensembles only. The trees learn from labelled URLs: those
that the caller brings, or else those that a rule decides. They see lengths, depths, ratios, entropy,
parameter counts and statistics of host suffixes. The statistics count every distinct labelled URL;
only the trees are fitted on a bounded sample of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: (verdict, host, path) of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Distinct labelled URLs of each class that the trees learn from at most, those of the least hash.
TRAINING_ROWS = 10_000
#: Suffixes up to which their statistics are broadcast (under 16 MB); beyond, they are joined by a salted shuffle.
BROADCAST_SUFFIXES = 200_000
SALTS = 16
TREES = 20
DEPTH = 4

_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%:"


def parsed(url):
    """(host, path) of a url column; both empty for null and where no :// stands."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are configuration, compiled into the plan."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def choose(value):
        out = F.lit(None).cast("string")
        for verdict, h, p in reversed(ordered):
            fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
            out = F.when(fits, F.lit(value(verdict, h, p))).otherwise(out)
        return out

    return choose(lambda v, h, p: h + p), choose(lambda v, h, p: v)


def _count(text, sign: str):
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def features(urls: DataFrame) -> DataFrame:
    """Add lexical features to rows with url, host and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    low = F.lower(url)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    counts = [_count(low, s) for s in _SIGNS]
    other = F.length(low) - reduce(lambda a, b: a + b, counts)
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    entropy = F.log2(n) - reduce(lambda a, b: a + b, [term(c) for c in [*counts, other]]) / n
    digits = reduce(lambda a, b: a + b, [_count(low, s) for s in "0123456789"])
    return urls.withColumns({
        "f_length": n, "f_host_length": F.length("host").cast("double"), "f_path_length": F.length("path").cast("double"),
        "f_host_depth": _count(F.col("host"), ".").cast("double"), "f_path_depth": _count(F.col("path"), "/").cast("double"),
        "f_digit_ratio": digits / n, "f_hyphens": _count(F.col("host"), "-").cast("double"), "f_entropy": entropy,
        "f_params": (_count(url, "=")).cast("double"), "f_https": F.startswith(low, F.lit("https")).cast("double"),
        "suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2),
    })


LEXICAL = ["f_length", "f_host_length", "f_path_length", "f_host_depth", "f_path_depth", "f_digit_ratio", "f_hyphens", "f_entropy", "f_params", "f_https"]


def _suffix_stats(labelled: DataFrame, name: str) -> DataFrame:
    """Labelled URLs of each suffix, and how many of them are to be blocked."""
    return labelled.groupBy(name).agg(F.count("*").cast("double").alias(f"n_{name}"), F.sum("label").alias(f"b_{name}"))


def _rated(df: DataFrame, stats: dict[str, DataFrame], own: bool) -> DataFrame:
    """Add f_{suffix}_n and f_{suffix}_rate, the share to be blocked, drawn towards a half by four URLs; own: leave out the row's own label."""
    for s, counts in stats.items():
        if counts.count() <= BROADCAST_SUFFIXES:
            df = df.join(F.broadcast(counts), s, "left")
        else:  # a suffix may hold a third of the URLs: its one row is copied to each salt
            salted = counts.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            df = df.withColumn("f_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, [s, "f_salt"], "left").drop("f_salt")
        n, blocked = (F.coalesce(F.col(f"{x}_{s}"), F.lit(0.0)) - (F.lit(float(x == "n")) + F.lit(float(x == "b")) * F.col("label") if own else F.lit(0.0)) for x in "nb")
        df = df.withColumns({f"f_{s}_n": F.log1p(n), f"f_{s}_rate": (blocked + 2) / (n + 4)}).drop(f"n_{s}", f"b_{s}")
    return df


def judge(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """Add p_block, the trees' probability that a url is to be blocked, to rows with url, host and path.

    labels has url, host, path and label (1 block, 0 allow); rows with a null url or label are left out,
    repeated ones count once, a url with both labels counts as both. Where labels hold one class or
    none, p_block is that class or 0. urls may hold nulls, repeats and further columns; empty tables
    give an empty result.
    """
    kept = [c for c in urls.columns if not c.startswith("f_") and c not in ("suffix1", "suffix2", "features")]
    known = labels.select("url", "host", "path", F.col("label").cast("double").alias("label")).where("url is not null and label is not null")
    known = cut(features(known.groupBy("url", "label").agg(F.first("host").alias("host"), F.first("path").alias("path"))), "url-labels")
    classes = {r.label for r in known.select("label").distinct().limit(2).collect()}
    if len(classes) < 2:
        return urls.withColumn("p_block", F.lit(max(classes, default=0.0)))
    names = ("suffix1", "suffix2")
    stats = {s: cut(_suffix_stats(known, s), f"url-{s}") for s in names}

    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("url"), "url").limit(TRAINING_ROWS) for c in (0.0, 1.0)]
    train = cut(parts[0].unionByName(parts[1]), "url-training")
    inputs = [*LEXICAL, *(f"f_{s}_{x}" for s in names for x in ("n", "rate"))]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    ready = cut(assemble.transform(_rated(train, stats, own=True)).select("features", "label").coalesce(2), "url-vectors")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, checkpointInterval=-1).fit(ready)
    out = model.transform(assemble.transform(_rated(features(urls.select(*kept)), stats, own=False)))
    return out.select(*kept, vector_to_array("probability")[1].alias("p_block"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row.

    The longest rule that fits decides; where none does, the trees block at a probability of a half
    and more. Null urls and those without :// have an empty host and path, and no rule. labels (url,
    label 1 block or 0 allow) trains the trees; without it, the urls that a rule decides do. Null ids,
    repeated rows and columns of any name are kept apart; each row gives one result row.
    """
    host, path = parsed(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labels is None:
        labelled = rows.where(F.col("ruled").isNotNull()).select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("label"))
    else:
        labelled = labels.select(F.col("url").cast("string").alias("url"), "label").select("url", *[c.alias(n) for c, n in zip(parsed(F.col("url")), ("host", "path"), strict=True)], "label")
    out = judge(rows, labelled)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged; nulls, repeats and empty tables as filter_urls() says."""
    return filter_urls(table(spark, sf_dir, "pages"))
