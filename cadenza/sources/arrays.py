"""Array files (.npy) as a data source: rows of the first dimension, read by byte range, one partition a range.

    register(spark)
    spark.read.format("npy").option("rows", 65536).load("/arrays/a.npy,hdfs://host/arrays/b.npy")

The header is read once, on the driver; tasks read nothing but their rows.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .paths import file_system

SCHEMA = "path string, row long, values array<double>"


class Rows(InputPartition):
    def __init__(self, path: str, kind: str, width: int, data: int, first: int, count: int):
        self.path, self.kind, self.width, self.data, self.first, self.count = path, kind, width, data, first, count


def header(path: str) -> tuple[str, tuple[int, ...], int]:
    """(kind of number, shape, place of the first byte of data) of a file; arrays in column order and of objects are refused."""
    import numpy as np
    from numpy.lib import format as npy

    where, name = file_system(path)
    with where.open_input_file(name) as f:
        version = npy.read_magic(f)
        shape, by_column, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
        if by_column and len(shape) > 1 or kind.hasobject:
            raise ValueError(f"{path}: only arrays of numbers in row order are read")
        return np.dtype(kind).str, shape, f.tell()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        self.rows = int(options.get("rows", 65_536))

    def partitions(self):
        out = []
        for path in self.paths:
            kind, shape, data = header(path)
            n, width = (shape[0], prod(shape[1:])) if shape else (1, 1)
            out += [Rows(path, kind, width, data, a, min(self.rows, n - a)) for a in range(0, n, self.rows)]
        return out or [Rows("", "", 0, 0, 0, 0)]

    def read(self, part: Rows):
        import numpy as np

        if not part.path:
            return
        kind = np.dtype(part.kind)
        where, name = file_system(part.path)
        with where.open_input_file(name) as f:
            data = f.read_at(part.count * part.width * kind.itemsize, part.data + part.first * part.width * kind.itemsize)
        values = np.frombuffer(data, kind).astype("float64").reshape(part.count, part.width)
        for i, row in enumerate(values.tolist()):
            yield part.path, part.first + i, row


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def write_npy(df: DataFrame, name: str, idx: str, vec: str, path: str, kind: str = "float32") -> DataFrame:
    """Write one array file path/<name>.npy for each name, its rows in the order of idx, and give their names, paths and rows.

    Vectors of a name are of one length. A file is one task's work, so names should part long arrays. It
    is put in its place by one rename, so a task that runs again leaves the same file.
    """

    def run(table):
        import uuid

        import numpy as np
        import pyarrow as pa

        table = table.sort_by(idx)
        x = np.array(table.column(vec).to_pylist(), kind)
        own = table.column(name)[0].as_py()
        where, folder = file_system(path)
        where.create_dir(folder, recursive=True)
        final, staged = f"{folder}/{own}.npy", f"{folder}/.{own}-{uuid.uuid4().hex}"
        with where.open_output_stream(staged) as out:
            np.lib.format.write_array(out, x, allow_pickle=False)
        where.move(staged, final)
        return pa.table({name: [own], "path": [f"{path}/{own}.npy"], "rows": pa.array([len(x)], pa.int64())})

    rows = df.select(F.col(name).cast("string").alias(name), idx, F.col(vec).cast("array<double>").alias(vec))
    return rows.groupBy(name).applyInArrow(run, f"{name} string, path string, rows long")
