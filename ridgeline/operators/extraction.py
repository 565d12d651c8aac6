"""Telemetry of a file from its payloads to tables: an even 10 Hz grid, the motion sensors at their own rate, and the streams.

Every sample becomes a row (asset, key, t, name, value), so all columns of all files are laid on the grid by one interpolation,
one exchange by asset and name, and turned into columns at the end.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import series
from ridgeline.session import saved
from ridgeline.sources.payloads import PayloadSource

POSITION = ("GPS9", "GPS5")  # the first that a file has is used: it tells lock and dilution for each sample
STREAMS = (*POSITION, "ACCL", "GYRO", "GRAV", "CORI", "IORI", "SHUT", "ISOE", "TMPC")
_PLACE = ("gps_lat", "gps_lon", "gps_alt", "gps_speed2d", "gps_speed3d")
_TURN = ("w", "x", "y", "z")
#: Column names by stream and number of fields (fixed values of the format). Other streams and numbers get a number each.
NAMES = {
    ("GPS5", 5): _PLACE,
    ("GPS5", 7): (*_PLACE, "gps_fix", "gps_dop"),
    ("GPS9", 9): (*_PLACE, "gps_days", "gps_secs", "gps_dop", "gps_fix"),
    ("CORI", 4): tuple(f"cori_{x}" for x in _TURN),
    ("IORI", 4): tuple(f"iori_{x}" for x in _TURN),
    ("SHUT", 1): ("shut",),
    ("ISOE", 1): ("isoe",),
    ("TMPC", 1): ("tmpc",),
}
ASSET = "content_hash"


def read_payloads(spark: SparkSession, paths: list[str], keys: tuple[str, ...] = STREAMS, sizes: list[int] | None = None, errors: bool = False, split: int | None = None) -> DataFrame:
    """(content_hash, key, payload, seconds, stmp_us, n, samples) of files. The path stands for the hash.

    A file is a task, or several if its size is given and above split bytes. With errors there is a column error, and a file
    that cannot be read has a row of it. Filters on key and path go into the reader where Spark is set to push them.
    """
    spark.dataSource.register(PayloadSource)
    own = spark.read.format("telemetry").option("keys", ",".join(keys)).option("paths", json.dumps(paths))
    own = own.option("errors", "rows" if errors else "raise").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if sizes:
        own = own.option("sizes", json.dumps(sizes))
    if split:
        own = own.option("split", split)
    return own.load().withColumnRenamed("path", ASSET)


def best_position(payloads: DataFrame) -> DataFrame:
    """payloads without the position streams that come after the first one that a file has samples of."""
    place = F.array_position(F.array(*map(F.lit, POSITION)), F.col("key"))
    best = payloads.where((place > 0) & (F.col("n") > 0)).groupBy(F.col(ASSET).alias("__a")).agg(F.min(place).alias("__best"))
    return payloads.join(best, F.col(ASSET) == F.col("__a"), "left").where((place == 0) | (place == F.col("__best"))).drop("__a", "__best")


def names_of(key: Column, n: Column) -> Column:
    """The names of the n fields of a stream's samples."""
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lower(key), F.lit("_"), i.cast("string")))
    for (k, size), names in NAMES.items():
        out = F.when((key == k) & (n == size), F.array(*map(F.lit, names))).otherwise(out)
    return out


def unknown_layouts(payloads: DataFrame) -> DataFrame:
    """(content_hash, key, n, expected): streams that have names, but not for so many fields: their columns get numbers, and what
    is made of the named ones stays empty. For a file that shows this, the format has changed."""
    known: dict[str, list[int]] = {}
    for key, n in NAMES:
        known.setdefault(key, []).append(n)
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = payloads.where(F.size("samples") > 0).select(ASSET, "key", F.size(F.get("samples", F.lit(0))).alias("n")).distinct()
    return own.withColumn("expected", table[F.col("key")]).where(F.col("expected").isNotNull() & ~F.array_contains("expected", F.col("n")))


def fields(payloads: DataFrame) -> DataFrame:
    """(content_hash, key, t, name, value): every finite field of every sample. Samples of a position stream are dated by its
    own stamps, others by the track's times where there are any."""
    position = F.col("key").isin(*POSITION)
    stamp = F.when(position, F.col("stmp_us") / 1e6).otherwise(F.coalesce("seconds", F.col("stmp_us") / 1e6))
    own = payloads.withColumn("__stamp", stamp).withColumn("__stream", F.concat_ws("\x1f", ASSET, "key"))
    timed = series.payload_times(own, "__stream", "payload", "__stamp", "n")
    values = timed.select(ASSET, "key", "t", F.get("samples", F.col("j")).alias("__v")).where(F.size("__v") > 0)
    rows = values.select(ASSET, "key", "t", F.inline(F.arrays_zip(names_of(F.col("key"), F.size("__v")).alias("name"), F.col("__v").alias("value"))))
    return rows.where(F.abs("value") < float("inf"))


def on_grid(rows: DataFrame, columns: list[str], step: float = 0.1) -> DataFrame:
    """(content_hash, t, *columns) on an even grid up to the last sample of any stream. Position is not drawn across gaps of
    more than five seconds nor beyond its ends; other streams hold their ends. A column of fewer than two values is null."""
    spans = rows.groupBy(ASSET).agg(F.max("t").alias("__end")).where("__end > 0")
    grid = series.grid(spans, ASSET, "__end", step).withColumn("t", F.round("t", 6))
    named = rows.where(F.col("name").isin(*columns)).withColumn("__series", F.concat_ws("\x1f", ASSET, "name"))
    enough = named.groupBy(ASSET, "name", "__series").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    points = grid.join(enough, ASSET)
    position = F.startswith("name", F.lit("gps_"))
    parts = [
        series.interpolate(points.where(of).select("__series", "t"), named.where(of), "__series", "value", gap, clamp)
        for of, gap, clamp in ((position, series.MAX_GAP, False), (~position, None, True))
    ]
    both = parts[0].unionByName(parts[1]).join(enough, "__series")
    wide = both.groupBy(ASSET, "t").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])
    return grid.join(wide, [ASSET, "t"], "left")


def native_motion(rows: DataFrame) -> DataFrame:
    """(content_hash, t, accl_0..2, gyro_0..2) at the accelerometer's own times, the gyroscope laid onto them."""
    accl, gyro = ([f"{k}_{i}" for i in range(3)] for k in ("accl", "gyro"))
    wide = rows.where("key = 'ACCL'").groupBy(ASSET, "t").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in accl])
    named = rows.where("key = 'GYRO'").withColumn("__series", F.concat_ws("\x1f", ASSET, "name"))
    enough = named.groupBy(ASSET, "name", "__series").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    laid = series.interpolate(wide.select(ASSET, "t").join(enough, ASSET).select("__series", "t"), named, "__series", "value").join(enough, "__series")
    turned = laid.groupBy(ASSET, "t").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in gyro])
    return wide.join(turned, [ASSET, "t"], "left")


def stream_rates(rows: DataFrame) -> DataFrame:
    """(content_hash, key, n, rate): samples of each stream, and how many a second."""
    each = rows.select(ASSET, "key", "t").distinct().groupBy(ASSET, "key").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.min("t").alias("first"))
    span = F.when(F.col("key").isin(*POSITION), F.col("last") - F.col("first")).otherwise(F.col("last"))
    return each.select(ASSET, "key", "n", F.round(F.col("n") / F.greatest(span, F.lit(1e-6)), 1).alias("rate"))


def extract(payloads: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(telemetry on the 10 Hz grid, motion at its own rate, streams) of payloads as read_payloads() gives them."""
    rows = saved(fields(best_position(payloads)))
    every = [*_PLACE, "gps_days", "gps_secs", "gps_dop", "gps_fix", *[f"{k}_{i}" for k in ("accl", "gyro", "grav") for i in range(3)]]
    every += [n for (k, _), names in NAMES.items() if k not in POSITION for n in names]
    return on_grid(rows, columns or every), native_motion(rows), stream_rates(rows)
