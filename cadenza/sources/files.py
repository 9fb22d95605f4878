"""File sources and sinks: content hashes, expiring settings, snapshots, edit lists."""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def unexpired(settings: DataFrame, saved: str, now: Column, ttl_s: float) -> DataFrame:
    """Rows saved less than ttl_s seconds before now; a row without a time has expired."""
    return settings.where((now - F.col(saved) >= 0) & (now - F.col(saved) < ttl_s))


def decoded(raw: Column) -> Column:
    """JSON text of a column that holds it plain or as 'gz:' and base64; broken data gives null."""

    @F.pandas_udf("string")
    def inflate(s):
        def one(x):
            try:
                return gzip.decompress(x).decode("utf-8") if x is not None else None
            except (OSError, EOFError, UnicodeDecodeError):
                return None

        return s.map(one)

    packed = F.startswith(raw, F.lit("gz:"))
    return F.when(packed, inflate(F.when(packed, F.try_to_binary(F.substring(raw, 4, 1 << 30), F.lit("base64"))))).otherwise(raw)


def encoded(text: Column, longer_than: int) -> Column:
    """The inverse of decoded(): texts longer than a threshold are packed."""

    @F.pandas_udf("string")
    def deflate(s):
        import base64

        return s.map(lambda x: None if x is None else "gz:" + base64.b64encode(gzip.compress(x.encode("utf-8"), mtime=0)).decode())

    long = F.length(text) > longer_than
    return F.when(long, deflate(F.when(long, text))).otherwise(text)


def existing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns with their types; those that a source doesn't have are null."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(c) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


# --- sinks ---


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write a snapshot beside its predecessors and point to it with one rename; readers see the old or the new one whole.

    Returns the snapshot's folder. Snapshots beyond the newest `keep` are deleted.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(conf)
    before = snapshots(spark, path)
    number = before[-1][0] + 1 if before else 1
    staged, final = f"{path}/.staged-{uuid.uuid4().hex}", f"{path}/snapshot-{number:012d}"
    df.write.parquet(staged)
    # a claim that only one writer can create: on some file systems a rename would move into a folder that exists
    try:
        fs.create(P(f"{path}/.claim-{number:012d}"), False).close()
    except Exception as e:
        fs.delete(P(staged), True)
        raise RuntimeError(f"{final} exists: another writer was first") from e
    if fs.exists(P(final)) or not fs.rename(P(staged), P(final)):
        raise RuntimeError(f"{final} exists: another writer was first")
    for _, old in before[: max(0, len(before) + 1 - keep)]:
        fs.delete(P(old), True)
    return final


def snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the complete snapshots, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(conf)
    if not fs.exists(P(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(P(path))]
    return sorted((int(n.split("-")[1]), f"{path}/{n}") for n in names if n.startswith("snapshot-"))


def latest(spark: SparkSession, path: str) -> DataFrame:
    found = snapshots(spark, path)
    if not found:
        raise FileNotFoundError(f"no snapshot in {path}")
    return spark.read.parquet(found[-1][1])


def edit_list(cuts: DataFrame, key: str, start: str, end: str, clip: str) -> DataFrame:
    """Six columns of an edit decision list: key, n, clip, start, end and length, in seconds of three decimals."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(start, clip))
    r = lambda c: F.round(c, 3)
    return cuts.select(key, n.alias("n"), clip, r(F.col(start)).alias("start"), r(F.col(end)).alias("end"), r(F.col(end) - F.col(start)).alias("length"))


def concat_script(cuts: DataFrame, n: str, file: str, length: str, path: str) -> None:
    """Write the lines of a player's concatenation script in order, as one text file; quotes in names are escaped."""
    name = F.replace(F.col(file), F.lit("'"), F.lit("'\\''"))
    lines = F.format_string("file '%s'\nduration %.3f", name, F.col(length).cast("double"))
    cuts.select(n, lines.alias("value")).orderBy(n).coalesce(1).select("value").write.mode("overwrite").text(path)


def publish_tables(tables: dict[str, DataFrame], path: str, keep: int = 2) -> int:
    """Write several tables and point to all of them with one manifest; a reader sees the tables of one version. Returns its number.

    The tables are written first, to folders that nothing reads yet. A claim that only one writer can
    create gives the number; then one rename shows the manifest. Versions beyond the newest `keep` go,
    manifest first.
    """
    import json

    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(conf)
    own = uuid.uuid4().hex
    folders = {name: f"{path}/data-{own}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(folders[name])
    before = _manifests(spark, path)
    number = before[-1][0] + 1 if before else 1
    staged = P(f"{path}/.staged-{own}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    try:
        fs.create(P(f"{path}/.claim-{number:012d}"), False).close()
    except Exception as e:
        fs.delete(staged, False)
        fs.delete(P(f"{path}/data-{own}"), True)
        raise RuntimeError(f"version {number} of {path} exists: another writer was first") from e
    if not fs.rename(staged, P(f"{path}/manifest-{number:012d}")):
        raise RuntimeError(f"version {number} of {path} could not be shown")
    for _, old in before[: max(0, len(before) + 1 - keep)]:
        folder = next(iter(_read_manifest(spark, old).values())).rsplit("/", 1)[0]
        fs.delete(P(old), False)
        fs.delete(P(folder), True)
    return number


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(conf)
    if not fs.exists(P(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(P(path))]
    return sorted((int(n.split("-")[1]), f"{path}/{n}") for n in names if n.startswith("manifest-"))


def _read_manifest(spark: SparkSession, file: str) -> dict[str, str]:
    import json

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    stream = P(file).getFileSystem(conf).open(P(file))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version, all of one publish_tables()."""
    found = _manifests(spark, path)
    if not found:
        raise FileNotFoundError(f"no tables in {path}")
    return {name: spark.read.parquet(folder) for name, folder in _read_manifest(spark, found[-1][1]).items()}
