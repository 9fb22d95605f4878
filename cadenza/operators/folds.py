"""Folds over ordered series: one pass per partition, linear time, and only a fold's own state in memory.

A fold looks sequential, yet a long enough pause makes what follows independent of what came before.
Series are cut at such pauses first. To find them without sorting a whole series in one task, rows are
dealt to spans of time, each span is summed up by its first and last instant, and only these summaries
are put in order: spans that follow each other without a pause form one piece. Pieces are sorted and
folded side by side, so one long series is shared out among tasks as far as its pauses allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pauses in a span of time, and rows of a batch that goes back to Spark.
SPAN = 64
BATCH = 8192


def pieces(df: DataFrame, keys: list[str], at: str, pause: float, inclusive: bool, out: str = "_piece") -> DataFrame:
    """Add the number of each row's piece: between two pieces of a series lies more than `pause` (inclusive: or as much)."""
    span = F.floor(F.col(at) / F.lit(max(pause, 1) * SPAN))
    rows = df.withColumn("_span", span)
    ends = rows.groupBy(*keys, "_span").agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    w = Window.partitionBy(*keys).orderBy("_span")
    gap = F.col("_low") - F.lag("_high").over(w)
    opens = F.coalesce((gap >= pause if inclusive else gap > pause).cast("int"), F.lit(0))
    numbered = ends.withColumn("_new", opens).withColumn(out, F.sum("_new").over(w))
    numbered = numbered.select(*[F.col(c).alias(f"_r{c}") for c in (*keys, "_span")], out)
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in (*keys, "_span")]
    return rows.join(numbered, same).select(*df.columns, out)


def folded(df: DataFrame, keys: list[str], by: list[str], step: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, piece: str | None = None) -> DataFrame:
    """keys and what step makes of the rows of each key (and piece), in the order of `by`.

    step takes an iterator of tuples, the columns of df but the keys and the piece in their order, and
    yields tuples of `schema`. Rows pass one by one. Nulls come as None; empty tables give an empty result.
    """
    groups = [*keys, *([piece] if piece else [])]
    rest = [c for c in df.columns if c not in groups]
    ordered = df.select(*groups, *rest).repartition(*groups).sortWithinPartitions(*groups, *by) if groups else df.repartition(1).sortWithinPartitions(*by)
    made = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(schema).fields])
    n, k = len(groups), len(keys)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(made)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        held: list[tuple] = []
        for group, members in groupby(rows(), key=lambda r: r[:n]):
            for out in step(r[n:] for r in members):
                held.append((*group[:k], *out))
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return ordered.mapInArrow(run, made)


def stretches_of(rows: Iterator[tuple], pause: float, inclusive: bool) -> Iterator[list[tuple]]:
    """Lists of rows, whose first column is the instant, between pauses."""
    held: list[tuple] = []
    for r in rows:
        if held and (r[0] - held[-1][0] >= pause if inclusive else r[0] - held[-1][0] > pause):
            yield held
            held = []
        held.append(r)
    if held:
        yield held
