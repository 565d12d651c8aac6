"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch of whole texts may hold, or one text.
TEXT_BATCH = "4m"
#: Rows of a narrow intermediate table that one task writes.
ROWS_PER_TASK = 40_000
#: What separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that go to Python: texts may be long. Batches of narrow rows stay as they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not own:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ridgeline-")
        sc.setCheckpointDir(own)
    return own.rstrip("/")


def materialize(df: DataFrame, name: str = "step", rows: int | None = None, file_rows: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    rows, if known, is a bound on the rows of a narrow table: it gets a task and a file for every
    ROWS_PER_TASK of them at most, and is not compressed. Iterations over tables that have become small
    then cost a few tasks and no codec buffers each. file_rows, if given, is the most rows of a file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ridgeline-{uuid.uuid4().hex}/{name}"
    if rows is None:
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    else:
        df.coalesce(max(1, -(-rows // ROWS_PER_TASK))).write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(df.schema).parquet(path).alias(name)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        if "/ridgeline-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ordered_ids(df: DataFrame, order: list[str | Column], name: str = "id") -> DataFrame:
    """Add ids that grow in the given order (not gapless). The order must be total."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return parts.withColumn(name, F.monotonically_increasing_id())


def dense_ids(df: DataFrame, order: list[str | Column], name: str = "id", rows: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given total order without a single-task window.

    One range exchange; the rows of each partition are counted (one row a partition) and the
    partitions' offsets, at most one a shuffle partition, are joined back.
    """
    placed = materialize(ordered_ids(df, order, "__mono"), "placed", rows)
    part = F.shiftright("__mono", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).collect()
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((row["__part"], total))
        total += row["__n"]
    index = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    if not offsets:
        return placed.withColumn(name, index).drop("__mono")
    starts = df.sparkSession.createDataFrame(offsets, "__part long, __start long")
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, index + F.col("__start"))
        .drop("__mono", "__part", "__start")
    )
