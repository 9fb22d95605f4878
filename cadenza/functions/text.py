"""Text, tag and JSON expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def keyword_tags(text: Column, words: dict[str, list[str]]) -> Column:
    """Names of the entries of which a keyword stands in the text, in dictionary order."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def hit(ks: list[str]) -> Column:
        out = F.lit(False)
        for k in ks:
            out = out | F.contains(low, F.lit(k))
        return out

    return F.array_compact(F.array(*[F.when(hit(ks), F.lit(name)) for name, ks in words.items()]))


def stems(text: Column, width: int = 5, longer_than: int = 2) -> Column:
    """Distinct first letters of the longer tokens, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens(text), lambda x: F.length(x) > longer_than), lambda x: F.substring(x, 1, width))))


def without(text: Column, gone: list[str]) -> Column:
    """Tokens but for some, joined by blanks."""
    return F.array_join(F.filter(tokens(text), lambda x: ~x.isin(gone)), " ")


def sentences(text: Column, most: int) -> Column:
    """The first few sentences, ends at . ! or ? before a blank."""
    return F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, most)


def sorted_json(pairs: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def posix_path(path: Column) -> Column:
    """Slashes one way and single, no ./ parts, no slash at the end, case folded."""
    p = F.regexp_replace(F.lower(path), r"\\", "/")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, r"(^|/)(\./)+", "$1")
    return F.regexp_replace(p, "(.)/$", "$1")


def register_functions(spark) -> None:
    """normalize_media_path(path) for SQL texts of this session: posix_path() as a function of SQL, which Catalyst inlines."""
    body = r"regexp_replace(regexp_replace(regexp_replace(replace(lower(path), '\\', '/'), '/+', '/'), '(^|/)(\\./)+', '$1'), '(.)/$', '$1')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_media_path(path STRING) RETURNS STRING RETURN {body}")


def parsed_tags(raw: Column, stop: list[str], most: int, words: int = 4, stem: int = 7, per_stem: int = 2) -> Column:
    """Tags of a comma, semicolon or line list: cleaned, without stop words, of at most some words, at most per_stem of one beginning, the first `most`."""
    parts = F.transform(F.split(F.lower(F.coalesce(raw, F.lit(""))), r"[,;\n]"), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 -]", " "), " +", " ")))
    ok = F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(stop) & (F.size(F.split(t, " ")) <= words))
    ok = F.array_distinct(ok)
    # how many earlier tags share the beginning
    kept = F.filter(ok, lambda t, i: F.size(F.filter(F.slice(ok, F.lit(1), i), lambda o: F.substring(o, 1, stem) == F.substring(t, 1, stem))) < per_stem)
    return F.slice(kept, 1, most)


def generalised_tag(tag: Column) -> Column:
    """Counts become words: 'one person', 'two people', 'group of people'; bare numbers give null."""
    n = F.regexp_extract(tag, r"^(\d+) (?:people|persons|person|men|women)$", 1).try_cast("int")
    return F.when(tag.rlike(r"^\d+$"), None).when(n == 1, "one person").when(n == 2, "two people").when(n > 2, "group of people").otherwise(tag)


def refused(text: Column, phrases: list[str]) -> Column:
    """Whether an answer is empty or holds one of the phrases, white space folded and case ignored."""
    folded = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    out = folded == ""
    for p in phrases:
        out = out | F.contains(folded, F.lit(p))
    return out


def same_meaning(a: Column, b: Column, stem: int = 5) -> Column:
    """Whether two tags have the same distinct word beginnings, or those of one are all in the other's."""
    x, y = stems(a, stem), stems(b, stem)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def in_lexicon(tag: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens(tag), F.array(*[F.lit(w) for w in words]))


def narrative(raw: Column, prefixes: list[str], most: int = 3) -> Column:
    """Text without a leading label and bullets, white space folded, its first sentences."""
    out = F.trim(F.coalesce(raw, F.lit("")))
    for p in prefixes:
        out = F.when(F.startswith(F.lower(out), F.lit(p.lower())), F.trim(F.substring(out, len(p) + 1, 1 << 30))).otherwise(out)
    out = F.regexp_replace(out, r"(?m)^[ \t]*[-*\u2022]+[ \t]+", "")
    return F.array_join(sentences(F.regexp_replace(out, r"\s+", " "), most), " ")


def int_list(raw: Column) -> Column:
    """Whole numbers of '3', '1,2' or '[1, 2]'; other parts are left out."""
    return F.array_compact(F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\[\]\s]", ""), ","), lambda x: x.try_cast("long")))


def paths_below(json: Column, token: str) -> Column:
    """Absolute paths anywhere below keys that hold the token, whatever their case: distinct and sorted; broken JSON has none.

    A nested text has no fixed depth, so it is walked in Arrow batches.
    """
    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _absolute_paths(t, token))

    return walk(json)


def _absolute_paths(text: str | None, token: str) -> list[str]:
    import posixpath
    from json import loads

    try:
        todo = [(loads(text or "null"), False)]
    except (ValueError, RecursionError):
        return []
    found = set()
    while todo:
        node, active = todo.pop()
        if isinstance(node, dict):
            todo += [(child, active or token in key.casefold()) for key, child in node.items()]
        elif isinstance(node, list):
            todo += [(child, active) for child in node]
        elif active and isinstance(node, str) and node.startswith("/"):
            found.add(posixpath.normpath(node))
    return sorted(found)
