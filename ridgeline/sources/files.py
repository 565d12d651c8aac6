"""File discovery, content hashes, archives, tracks of position, and the sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.media import VIDEO_SUFFIXES, ride_chapter
from ridgeline.operators import catalogue
from ridgeline.sources import payloads

WINDOW = 8 << 20


def find_videos(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, bytes, modified, ride_id, chapter) of the videos under a folder; only names and sizes are read."""
    pattern = rf"(?i)\.({'|'.join(VIDEO_SUFFIXES)})$"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    own = found.where(F.col("path").rlike(pattern)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return own.withColumn("__p", ride_chapter(F.col("name"))).select("path", "name", "bytes", "modified", F.col("__p.ride").alias("ride_id"), F.col("__p.chapter").alias("chapter"))


def sampled_digest(n: int, read: Callable[[int, int], bytes], window: int = WINDOW) -> str:
    """blake2b of the size and of all n bytes, or of the first, middle and last window if there are more than those hold.
    read(size, start) gives bytes."""
    digest = hashlib.blake2b(str(n).encode(), digest_size=16)
    for start in (0,) if n <= 3 * window else (0, (n - window) // 2, n - window):
        digest.update(read(n if n <= 3 * window else window, start))
    return f"s3b2_{digest.hexdigest()}"


def sampled_hash(path: str) -> str:
    """The digest of a file, of which at most three windows are read."""
    with payloads.opened(path) as f:
        return sampled_digest(f.size(), f.read_at)


def hash_column(content: Column, window: int = WINDOW) -> Column:
    """The digest of binary content that is in a table already; null for null."""

    @F.pandas_udf("string")
    def of(batches: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else sampled_digest(len(x), lambda size, start, x=x: x[start : start + size], window) for x in batches], dtype=object)

    return of(content)


def with_content_hash(files: DataFrame) -> DataFrame:
    """files(path, ...) with content_hash: at most 24 MiB of each file are read, on the executors."""

    @F.pandas_udf("string")
    def of(paths: pd.Series) -> pd.Series:
        return pd.Series([sampled_hash(p) for p in paths], dtype=object)

    return files.withColumn("content_hash", of("path"))


def probed(files: DataFrame) -> DataFrame:
    """files(path, ...) with container_s, the seconds that the file itself tells, and error, why it cannot be read; only its index is read."""

    @F.pandas_udf("container_s double, error string")
    def of(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for path in paths:
            try:
                rows.append((payloads.container_duration(path), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(rows, columns=["container_s", "error"]).astype({"container_s": float, "error": object})

    out = files.withColumn("__p", of("path"))
    return out.select(*files.columns, F.when(~F.isnan("__p.container_s"), F.col("__p.container_s")).alias("container_s"), F.col("__p.error").alias("error"))


def verify(files: DataFrame, expected: str = "expected") -> DataFrame:
    """files(path, expected) with ok: whether the content is what it should be."""
    return with_content_hash(files).withColumn("ok", F.col("content_hash") == F.col(expected))


def index_archive(files: DataFrame) -> DataFrame:
    """(content_hash, path), the last path of each content."""
    return with_content_hash(files).groupBy("content_hash").agg(F.max("path").alias("path"))


def archive_plan(assets: DataFrame, index: DataFrame) -> DataFrame:
    """(content_hash, source_path, action): copy what the archive lacks, link what it has, skip what is recorded."""
    have = index.select("content_hash", F.col("path").alias("__path"))
    action = F.when(F.col("archived_path").isNotNull(), "skip").when(F.col("__path").isNotNull(), "link").otherwise("copy")
    return assets.join(have, "content_hash", "left").select("content_hash", "source_path", F.coalesce("archived_path", "__path").alias("archived_path"), action.alias("action"))


def resolve_originals(assets: DataFrame, present: DataFrame) -> DataFrame:
    """(content_hash, path, state): the source if it is there, else the archived copy, else missing."""
    there = present.select("path").distinct()
    a, b = there.select(F.col("path").alias("source_path"), F.lit(True).alias("__s")), there.select(F.col("path").alias("archived_path"), F.lit(True).alias("__a"))
    both = assets.select("content_hash", "source_path", "archived_path").join(a, "source_path", "left").join(b, "archived_path", "left")
    state = F.when(F.col("__s"), "source").when(F.col("__a"), "archive").otherwise("missing")
    return both.select("content_hash", F.when(F.col("__s"), F.col("source_path")).when(F.col("__a"), F.col("archived_path")).alias("path"), state.alias("state"))


def _place(path: str):
    return payloads.located(path)


def copy_verified(source: str, target: str, expected: str) -> None:
    """Copy a file beside the target, check its content, and only then give it its name. Nothing is left of a copy that fails."""
    (a, b), (c, d) = _place(source), _place(target)
    partial = f"{d}.partial"
    try:
        with a.open_input_stream(b) as data, c.open_output_stream(partial) as out:
            while part := data.read(WINDOW):
                out.write(part)
        got = sampled_hash(f"{target}.partial")
        if got != expected:
            raise ValueError(f"the copy of {source} is {got}, not {expected}")
        c.move(partial, d)
    except BaseException:
        if c.get_file_info(partial).is_file:
            c.delete_file(partial)
        raise


def archive_file(source: str, folder: str, expected: str, known: str | None = None) -> str:
    """The path of a file in the archive: where it is known to be, or a verified copy. A file of that name that is not known is
    an error, since it may be another one."""
    if known:
        return known
    target = f"{folder.rstrip('/')}/{source.rsplit('/', 1)[-1]}"
    system, at = _place(target)
    if system.get_file_info(at).is_file:
        raise FileExistsError(f"{target} is there, but not as {expected}")
    copy_verified(source, target, expected)
    return target


def restore_file(archived: str, folder: str, expected: str) -> str:
    """The path of an archived file in a working folder: an earlier copy if it is still right, else a verified new one."""
    target = f"{folder.rstrip('/')}/{archived.rsplit('/', 1)[-1]}"
    system, at = _place(target)
    if not (system.get_file_info(at).is_file and sampled_hash(target) == expected):
        copy_verified(archived, target, expected)
    return target


def copied(files: DataFrame, folder: str, how: Callable[[str, str, str], str] = restore_file) -> DataFrame:
    """files(content_hash, path) with target and error: each file archived or restored by a task of its own, one after the other
    inside a partition. A file that fails has an error and doesn't stop the others."""

    @F.pandas_udf("target string, error string")
    def each(paths: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        rows = []
        for path, expected in zip(paths, hashes, strict=True):
            try:
                rows.append((how(path, folder, expected), None))
            except Exception as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["target", "error"], dtype=object)

    return files.withColumn("__c", each("path", "content_hash")).select(*files.columns, "__c.*")


def read_gpx(spark: SparkSession, path: str, kind: str = "trkpt") -> DataFrame:
    """(lat, lon, ele) of a GPX file's points: trkpt, rtept or wpt."""
    schema = "_lat double, _lon double, ele double"
    return spark.read.format("xml").option("rowTag", kind).option("ignoreNamespace", True).schema(schema).load(path).select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele")


def fourcc_counts(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(path, code, n): how often each four-character code of interest stands in the first bytes of each file."""
    codes = ("GPS5", "GPS9", "ACCL", "GYRO", "GRAV", "CORI", "IORI", "STMP", "SCAL")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, at = payloads.located(path)
                with system.open_input_stream(at) as f:
                    data = f.read(most)
                yield pd.DataFrame({"path": path, "code": codes, "n": [data.count(c.encode()) for c in codes]})

    return files.select("path").mapInPandas(scan, "path string, code string, n long")


def write_series(df: DataFrame, path: str, asset: str = "content_hash") -> None:
    """A series table partitioned by asset: assets written again replace only their own partitions."""
    df.repartition(asset).sortWithinPartitions(asset, "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(asset).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header: catalogue reports, which are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_calibration(features: DataFrame, levels: DataFrame, path: str) -> None:
    """Both tables as one snapshot, so that they are always those of one calibration: levels stand in their folder."""
    catalogue.save_snapshots({"features": features, "levels": levels}, path)


def load_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/levels")


def export_and_clear(segments: DataFrame, path: str) -> tuple[int, DataFrame]:
    """(how many, segments): decisions exported, and taken back from the segments only after they were read back in full."""
    n = export_decisions(segments.where("status <> 'candidate'"), path)
    return n, segments.where("status = 'candidate'")


def export_decisions(rows: DataFrame, path: str, tag: str = "decisions-1") -> int:
    """Decisions as JSON lines with a format tag; read back and counted before anything may be cleared. Returns the count."""
    rows.withColumn("format", F.lit(tag)).write.mode("overwrite").json(path)
    back = rows.sparkSession.read.json(path, schema="format string")
    n, wrong = back.count(), back.where(F.col("format") != tag).count()
    if wrong or n != rows.count():
        raise ValueError(f"{path} holds {n} decisions, {wrong} of another format; nothing was cleared")
    return n
