"""Catalogue operators: repeatable upserts, compensation, retention, constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with the rows of incoming put over those of equal keys; of several the last by order wins.

    Running it again with the same rows changes nothing.
    """
    cols = current.columns
    both = current.select(*cols, F.lit(0).alias("_side")).unionByName(incoming.select(*cols, F.lit(1).alias("_side")))
    rest = [c for c in cols if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_side", order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*cols)


def upsert_media(current: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str, derived: list[str], status: str, initial: str) -> DataFrame:
    """Keyed upsert in which a changed content hash clears the derived columns and resets the status."""
    old = current.select(*keys, F.col(hash_col).alias("_old"), *[F.col(c).alias(f"_d_{c}") for c in derived], F.col(status).alias("_status"))
    new = incoming.join(old, keys, "left")
    same = F.col(hash_col) == F.col("_old")
    out = new.select(*keys, hash_col, *[F.when(same, F.col(f"_d_{c}")).alias(c) for c in derived], F.when(same, F.col("_status")).otherwise(F.lit(initial)).alias(status))
    kept = current.select(*out.columns).join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(out)


def classify(current: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and outcome: 'after' where the current value is the new one, 'before' where the old, else 'conflict'."""
    j = current.select(*keys, value).join(before.select(*keys, F.col(value).alias("_b")), keys, "full").join(after.select(*keys, F.col(value).alias("_a")), keys, "full")
    return j.select(*keys, F.when(F.col(value).eqNullSafe(F.col("_a")), "after").when(F.col(value).eqNullSafe(F.col("_b")), "before").otherwise("conflict").alias("outcome"))


def expired(df: DataFrame, keys: list[str], age: Column, max_age, by: list[str], cap: int) -> DataFrame:
    """Rows past max_age, and the oldest beyond cap per key; rows whose age is null are protected."""
    w = Window.partitionBy(*keys)
    newest = F.row_number().over(w.orderBy(*[F.desc(c) for c in by]))
    return df.withColumn("_age", age).where(F.col("_age").isNotNull()).withColumn("_rn", newest).where((F.col("_age") > max_age) | (F.col("_rn") > cap)).drop("_age", "_rn")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of each broken rule; a rule that gives null counts as broken."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(key, F.explode(F.array_compact(checks)).alias("rule"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
