"""PCM sound files as a data source: windows in packs of neighbours, read by range, mixed down to mono, at the rate asked for.

    register(spark)
    spark.read.format("pcm").option("window", 90).option("overlap", 10).option("rate", 22050).load("/music/a.wav,hdfs://host/music/b.wav")

Options offset and duration (seconds) read one range of each file instead of windows; there are `tasks` (64) tasks
at least, if there are as many windows. Paths without a
scheme are local; others go through Arrow's file systems, on the driver for the header and on executors
for the windows. Integer samples of 8, 16, 24 and 32 bits are read, scaled to -1..1.

A resampled sample is a weighted mean of the input around its instant. A window reads as much beside its
range as these means need, so windows join without a seam and equal a file that is resampled in one piece.
"""

from __future__ import annotations

import wave
from functools import lru_cache
from itertools import groupby
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .paths import file_system

SCHEMA = "path string, window int, start_s double, rate int, samples array<float>"
#: Zero crossings of the kernel on each side, and its cut-off as a share of the lower rate's half.
CROSSINGS = 16
ROLL_OFF = 0.95
#: Resampled samples at a time, so that memory doesn't grow with the window.
CHUNK = 1 << 15
#: Resampled samples of the windows of one task, and windows at most: a task costs more than a short window's work.
PACK = 1 << 21
PACKED = 1024


def opened(path: str) -> wave.Wave_read:
    """A sound file wherever it lies; only what is asked for is read."""
    where, name = file_system(path)
    return wave.open(where.open_input_file(name))


class Windows(InputPartition):
    """(path, number, first sample, samples) of windows, those of one file side by side."""

    def __init__(self, windows: list[tuple[str, int, int, int]]):
        self.windows = windows


def packed(windows: list[tuple[str, int, int, int]], least: int) -> list[Windows]:
    """Windows in packs of PACK samples and PACKED windows at most, but in `least` packs where there are as many windows. A window is never parted."""
    total = sum(w[3] for w in windows)
    size, many = max(1, min(PACK, -(-total // least))), max(1, min(PACKED, -(-len(windows) // least)))
    out: list[Windows] = []
    room = 0
    for w in windows:
        if not out or room < w[3] or len(out[-1].windows) == many:
            out.append(Windows([]))
            room = size
        out[-1].windows.append(w)
        room -= w[3]
    return out


def windows(frames: int, rate: int, length: float, overlap: float) -> list[tuple[int, int]]:
    """(first frame, frames) of windows of `length` seconds that start every length - overlap; the last one may be short."""
    if not length > overlap >= 0:
        raise ValueError("the window must be longer than its overlap")
    size, hop = round(length * rate), round((length - overlap) * rate)
    out, start = [], 0
    while start < frames:
        out.append((start, min(size, frames - start)))
        if start + size >= frames:
            break
        start += hop
    return out


def mono(data: bytes, width: int, channels: int):
    """Frames of little-endian integers of `width` bytes as the means of their channels, in -1..1."""
    import numpy as np

    if width == 1:
        x = np.frombuffer(data, "u1").astype("float64") - 128
    elif width == 3:
        parts = np.frombuffer(data, "u1").reshape(-1, 3).astype("int32")
        x = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8).astype("float64")
    else:
        x = np.frombuffer(data, f"<i{width}").astype("float64")
    return x.reshape(-1, channels).mean(1) / 2.0 ** (8 * width - 1)


@lru_cache(8)
def _phases(native: int, rate: int):
    """Half the width of the kernel in input samples, and its values for each of the offsets that a sample can have between two input samples."""
    import numpy as np

    up = rate // gcd(native, rate)
    cutoff = min(1.0, rate / native) * ROLL_OFF
    half = int(np.ceil(CROSSINGS / cutoff))
    t = np.arange(up)[:, None] / up - np.arange(1 - half, half + 1)[None, :]
    kernel = np.sinc(cutoff * t) * np.where(np.abs(t) < half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0.0)
    return half, kernel / kernel.sum(1, keepdims=True)


def needed(native: int, rate: int, first: int, count: int) -> tuple[int, int]:
    """The range of input samples that `count` resampled ones from `first` on are made of; it may reach beyond the file."""
    half = _phases(native, rate)[0]
    return first * native // rate - half + 1, (first + count - 1) * native // rate + half + 1


def resampled(x, at: int, native: int, rate: int, first: int, count: int):
    """`count` samples from `first` on at the new rate; x holds the input from sample `at` on, and what it doesn't hold is 0."""
    import numpy as np

    half, kernel = _phases(native, rate)
    g = gcd(native, rate)
    up, down = rate // g, native // g
    low, high = needed(native, rate, first, count)
    long = np.zeros(high - low)
    a, b = max(low, at), min(high, at + len(x))
    if a < b:
        long[a - low : b - low] = x[a - at : b - at]
    out = np.empty(count)
    taps = np.arange(2 * half)
    for k in range(0, count, CHUNK):
        place = np.arange(first + k, first + min(k + CHUNK, count), dtype="int64") * down
        out[k : k + CHUNK] = (kernel[place % up] * long[(place // up - half + 1 - low)[:, None] + taps]).sum(1)
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        self.length, self.overlap = float(options.get("window", 90)), float(options.get("overlap", 0))
        self.rate = int(options.get("rate", 0))
        self.least = int(options.get("tasks", 64))
        self.range = (float(options.get("offset", 0)), float(options.get("duration", "inf"))) if "offset" in options or "duration" in options else None

    def partitions(self):
        out = []
        for path in self.paths:
            with opened(path) as f:
                native = f.getframerate()
                rate = self.rate or native
                frames = -(-f.getnframes() * rate // native)
            found = windows(frames, rate, self.length, self.overlap)
            if self.range and frames:
                start = min(int(self.range[0] * rate), frames - 1)
                found = [(start, int(min(self.range[1] * rate, frames - start)))]
            out += [(path, i, a, n) for i, (a, n) in enumerate(found)]
        return packed(out, self.least) or [Windows([])]

    def read(self, part: Windows):
        for path, own in groupby(part.windows, key=lambda w: w[0]):
            with opened(path) as f:
                native, frames = f.getframerate(), f.getnframes()
                rate = self.rate or native
                for _, number, start, count in own:
                    low, high = (start, start + count) if rate == native else needed(native, rate, start, count)
                    low, high = max(low, 0), min(high, frames)
                    f.setpos(min(low, frames))
                    x = mono(f.readframes(max(high - low, 0)), f.getsampwidth(), f.getnchannels())
                    if rate != native:
                        x = resampled(x, low, native, rate, start, count)
                    yield path, number, start / rate, rate, x.astype("float32").tolist()


class PcmSource(DataSource):
    @classmethod
    def name(cls):
        return "pcm"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcmSource)


def write_pcm(df: DataFrame, name: str, idx: str, samples: list[str], path: str, rate: int, width: int = 2) -> DataFrame:
    """Write one sound file path/<name>.wav for each name and give their names, paths and frames; samples are the channels, in -1..1.

    idx orders a file's frames. A file is one task's work, so names should part long sounds. It is put
    in its place by one rename, so a task that runs again leaves the same file.
    """

    def run(table):
        import uuid

        import numpy as np
        import pyarrow as pa

        table = table.sort_by(idx)
        top = 2 ** (8 * width - 1)
        x = np.stack([table.column(c).to_numpy(zero_copy_only=False) for c in samples], 1).astype("float64")
        whole = np.clip(np.rint(np.nan_to_num(x) * top), -top, top - 1).astype("<i8")
        if width == 1:
            whole += top
        data = whole.reshape(-1, 1).view("u1").reshape(-1, 8)[:, :width].tobytes()
        own = table.column(name)[0].as_py()
        where, folder = file_system(path)
        where.create_dir(folder, recursive=True)
        final, staged = f"{folder}/{own}.wav", f"{folder}/.{own}-{uuid.uuid4().hex}"
        with where.open_output_stream(staged) as out, wave.open(out, "w") as f:
            f.setnchannels(len(samples))
            f.setsampwidth(width)
            f.setframerate(rate)
            f.setnframes(len(whole))
            f.writeframesraw(data)
        where.move(staged, final)
        return pa.table({name: [own], "path": [f"{path}/{own}.wav"], "frames": pa.array([len(whole)], pa.int64())})

    rows = df.select(F.col(name).cast("string").alias(name), idx, *[F.col(c).cast("double").alias(c) for c in samples])
    return rows.groupBy(name).applyInArrow(run, f"{name} string, path string, frames long")
