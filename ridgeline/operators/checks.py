"""What a recording's telemetry should look like, and whether it does: numbers that are plain wrong in a file that was misread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.numbers import norm
from ridgeline.operators import features

ASSET = "content_hash"
#: A metric's verdict from its value: the case of the first condition that holds.
VERDICTS: dict[str, list[tuple[str, str]]] = {
    "accl_mean": [("value > 9.0 and value < 13.0", "ok"), ("true", "suspect: 9.8 to 12 is expected")],
    "grav_mean": [("value > 0.9 and value < 1.1", "ok"), ("true", "suspect: about 1 is expected")],
    "gps_fix": [("value > 0.8", "ok"), ("true", "sparse")],
    "gps_lock": [("value > 0.8", "ok"), ("true", "partial: seconds before the lock are left out")],
    "speed_p95": [("value > 0.5 and value < 20.0", "ok"), ("true", "suspect: not the speed of a ride")],
    "roll_suppression": [("value > 0.5", "levelled in the camera: do not level again"), ("value > 0.15", "partly levelled: look before trusting it"), ("true", "not levelled: levelling applies")],
}
WANTED = ("ACCL", "GYRO", "GRAV", "CORI", "IORI")


def measures(telemetry: DataFrame) -> DataFrame:
    """(content_hash, metric, value) of telemetry on its grid; metrics without a value have no row."""
    c = {f"{s}_{i}" for s in ("accl", "grav") for i in range(3)} | {"gps_lat", "gps_lon", "gps_speed2d", "gps_fix"}
    t = telemetry.select(ASSET, *[(F.col(x) if x in telemetry.columns else F.lit(None)).cast("double").alias(x) for x in sorted(c)])
    size = lambda s: norm(*[F.col(f"{s}_{i}") for i in range(3)])
    known = lambda x: F.abs(x) < float("inf")
    placed = F.coalesce((F.abs("gps_lat") > 0.01) & (F.abs("gps_lat") <= 90) & known(F.col("gps_lon")), F.lit(False)).cast("double")
    of = lambda x: F.when(known(x), x)
    own = t.groupBy(ASSET).agg(
        F.avg(of(size("accl"))).alias("accl_mean"), F.avg(of(size("grav"))).alias("grav_mean"),
        F.when(F.count("gps_lat") > 0, F.avg(placed)).alias("gps_fix"), F.avg((of(F.col("gps_fix")) >= 1.5).cast("double")).alias("gps_lock"),
        F.percentile(of(F.col("gps_speed2d")), F.array(F.lit(0.5), F.lit(0.95))).alias("__s"),
    )
    named = {m: F.col(m) for m in ("accl_mean", "grav_mean", "gps_fix", "gps_lock")} | {"speed_p50": F.get("__s", F.lit(0)), "speed_p95": F.get("__s", F.lit(1))}
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in named.items()])
    return own.select(ASSET, F.inline(rows)).where("value is not null")


def verdict() -> Column:
    """The verdict of a row with metric and value; null for metrics that are only told."""
    out = F.lit(None).cast("string")
    for metric, cases in VERDICTS.items():
        case = F.lit(None).cast("string")
        for condition, said in reversed(cases):
            case = F.when(F.expr(condition), said).otherwise(case)
        out = F.when(F.col("metric") == metric, case).otherwise(out)
    return out


def verify(telemetry: DataFrame, assets: DataFrame) -> DataFrame:
    """(content_hash, metric, value, verdict) of each of assets(content_hash, has_gpmd, streams): numbers with what they should be, and
    a row for each stream that is missing, for a position stream that gave no columns, and for a file without telemetry."""
    own = telemetry.join(assets.select(ASSET), ASSET, "left_semi")
    found = measures(own)
    whole = {f"{s}_{i}" for s, n in (("grav", 3),) for i in range(n)} | {f"{s}_{x}" for s in ("cori", "iori") for x in "wxyz"}
    if whole <= set(own.columns):
        steady = features.roll_suppression(own).where("suppression is not null")
        found = found.unionByName(steady.select(ASSET, F.lit("roll_suppression").alias("metric"), F.col("suppression").cast("double").alias("value")))
    told = found.withColumn("verdict", verdict())
    streams = F.coalesce("streams", F.array().cast("array<string>"))
    has = F.coalesce("has_gpmd", F.lit(False))
    position = F.arrays_overlap(streams, F.array(F.lit("GPS5"), F.lit("GPS9")))
    lacks = [F.when(~has, F.struct(F.lit("telemetry").alias("metric"), F.lit("no telemetry track: nothing to score by").alias("verdict")))]
    lacks += [F.when(has & ~F.array_contains(streams, k), F.struct(F.lit(k).alias("metric"), F.lit("missing").alias("verdict"))) for k in WANTED]
    lacks.append(F.when(has & ~position, F.struct(F.lit("GPS").alias("metric"), F.lit("missing: no speed, descent nor place").alias("verdict"))))
    gone = assets.select(ASSET, F.explode(F.filter(F.array(*lacks), lambda x: x.isNotNull())).alias("x")).select(ASSET, "x.metric", F.lit(None).cast("double").alias("value"), "x.verdict")
    placed = found.where("metric = 'gps_fix'").select(ASSET)
    unread = assets.where(has & position).join(placed, ASSET, "left_anti").select(ASSET, F.lit("GPS").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("the stream is there, but none of its columns is").alias("verdict"))
    return told.unionByName(gone).unionByName(unread)
