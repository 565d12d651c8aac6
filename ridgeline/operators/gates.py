"""Plausibility gates over series: what a sensor could not have measured becomes NULL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_SPEED, LOCKED, MAX_DOP = 30.0, 1.5, 6.0
GRADE_FLOOR, GRADE_OF_SPEED, GRADE_UNKNOWN = Decimal("0.35"), Decimal("0.6"), Decimal("3.0")


def plausible_speed(v: Column) -> Column:
    return F.when((v >= 0) & (v < MAX_SPEED), v)


def lock_gate(df: DataFrame, asset: str, value: str, fix: str) -> DataFrame:
    """df with the value only where the position is locked: if an asset ever locks, its locked rows; if it reports and never
    locks, none; if it does not report, all."""
    best = F.max(fix).over(W.partitionBy(asset))
    gated = F.when(best >= 2, F.when(F.col(fix) >= LOCKED, F.col(value))).when(best.isNotNull(), F.lit(None)).otherwise(F.col(value))
    return df.withColumn(value, gated)


def dop_gate(value: Column, dop: Column, fix: Column | None = None) -> Column:
    """The value unless its dilution is poor or it has no fix; what is not reported does not count against it."""
    ok = F.coalesce(dop <= MAX_DOP, F.lit(True))
    if fix is not None:
        ok = ok & F.coalesce(fix >= LOCKED, F.lit(True))
    return F.when(ok, value)


def bound_by_speed(grade: Column, speed: Column) -> Column:
    """The grade if the speed allows it: at most the greater of 0.35 and 0.6 of the speed, or 3 where that is unknown. The
    limits are decimals, so that 0.6 of a decimal speed is exact; that of a double is a double."""
    most = F.greatest(F.lit(GRADE_FLOOR), F.coalesce(F.abs(speed) * F.lit(GRADE_OF_SPEED), F.lit(GRADE_UNKNOWN)))
    return F.when(F.abs(grade) <= most, grade)


def rejected_share(before: Column, after: Column) -> Column:
    """Aggregate: the share of known values that a gate took away."""
    return F.count_if(before.isNotNull() & after.isNull()) / F.nullif(F.count(before), F.lit(0))


def detection_ok(score: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Size, score and edge priors of a detection of the right class."""
    area, width = (x1 - x0) * (y1 - y0), x1 - x0
    touches = (x0 < 0.02) | (x1 > 0.98)
    return (score >= 0.10) & area.between(0.0015, 0.030) & ~(touches & (width > 0.12))


def detection_priors(df: DataFrame, keys: list[str], wanted: int = 18) -> DataFrame:
    """(keys, kept, n_rejected) per frame of boxes(class_id, score, x0, y0, x1, y1): the class filter comes first and is not counted."""
    ok = detection_ok(*[F.col(c) for c in ("score", "x0", "y0", "x1", "y1")])
    own = df.where(F.col("class_id") == wanted)
    return own.groupBy(*keys).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("n_rejected"))


def upright(g0: Column, g1: Column, g2: Column) -> Column:
    """0 or 180 degrees from mean gravity; null if it lies mostly along the optical axis or across the picture."""
    weak = F.greatest(F.abs(g0), F.abs(g1)) < 0.3
    return F.when(weak | (F.abs(g0) > F.abs(g1)), F.lit(None).cast("int")).when(g1 > 0, 0).otherwise(180)


def framing_gate(hits: Column, n: Column) -> Column:
    """Why a clip is framed on its centre, null if it follows the subject."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "not covered").when(hits / n < 0.15, "too few hits")


LEAST_S, TINY_S = 20.0, 30.0


def long_enough(duration: Column, least: float = LEAST_S) -> Column:
    """Whether a recording lasts long enough to be ranked; an unknown duration doesn't."""
    return F.coalesce(duration, F.lit(0.0)) >= least


def has_position(streams: Column) -> Column:
    """Whether a list of streams has a position stream."""
    return F.coalesce(F.arrays_overlap(streams, F.array(F.lit("GPS5"), F.lit("GPS9"))), F.lit(False))


def shortcomings(has_telemetry: Column, streams: Column, duration: Column) -> Column:
    """What a recording lacks, as a list: telemetry, or position beside telemetry, and length."""
    telemetry = F.coalesce(has_telemetry, F.lit(False))
    cases = F.array(F.when(~telemetry, "no telemetry"), F.when(telemetry & ~has_position(streams), "no position"), F.when(~long_enough(duration, TINY_S), "tiny"))
    return F.filter(cases, lambda x: x.isNotNull())
