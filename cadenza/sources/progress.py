"""A folder of growing text files as a stream of lines: each poll takes what was added since the last one.

    register(spark)
    spark.readStream.format("lines").load("/logs")

The offset of a poll is the number of bytes of whole lines in each file, so a batch that is repeated
after a failure reads the same bytes, and a reader that starts anew needs no memory of its own. A last
line without its line break waits until it is whole. Files are read by ranges of rangeBytes, one a task.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .paths import file_system

SCHEMA = "path string, at long, line string"
#: Bytes of a file that are looked through at a time for a line break.
CHUNK = 1 << 16


class Range(InputPartition):
    """Lines of a file that begin in low..high, of which the batch has first..end."""

    def __init__(self, path: str, first: int, low: int, high: int, end: int):
        self.path, self.first, self.low, self.high, self.end = path, first, low, high, end


def last_break(f, size: int) -> int:
    """The place behind the last line break in the first `size` bytes of an open file."""
    high = size
    while high > 0:
        low = max(0, high - CHUNK)
        found = f.read_at(high - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        high = low
    return 0


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangeBytes", 1 << 26))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        where, folder = file_system(self.path)
        out = {}
        for i in where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")):
                with where.open_input_file(i.path) as f:
                    out[i.path] = last_break(f, i.size)
        return out

    def partitions(self, start: dict, end: dict):
        return [Range(name, start.get(name, 0), low, min(low + self.range, stop), stop) for name, stop in sorted(end.items()) for low in range(start.get(name, 0), stop, self.range)]

    def read(self, part: Range):
        where, _ = file_system(self.path)
        with where.open_input_file(part.path) as f:
            at, high = part.low, part.high
            # a line belongs to the range in which it begins: skip the rest of one, and finish the last one
            data = f.read_at(high - at, at)
            while not data.endswith(b"\n") and high < part.end:
                more = f.read_at(min(CHUNK, part.end - high), high)
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
                high += len(more)
            if at > part.first and f.read_at(1, at - 1) != b"\n":
                skip = data.find(b"\n") + 1
                data, at = data[skip:], at + skip
        for line in data.split(b"\n")[:-1]:
            if at >= part.high:
                break
            yield part.path, at, line.decode("utf-8", "replace").removesuffix("\r")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class LinesSource(DataSource):
    @classmethod
    def name(cls):
        return "lines"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)
