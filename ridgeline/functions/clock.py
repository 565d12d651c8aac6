"""Clocks and light."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a clock time that has no zone: UTC, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz")) / 1e6


def gps_epoch(days: Column, secs: Column, t: Column) -> Column:
    """Unix seconds of a series' start, from days since 2000-01-01, seconds of the day and the sample's time."""
    return F.lit(946_684_800.0) + days * 86_400.0 + (secs - t)


def lighting_label(elevation: Column) -> Column:
    return F.when(elevation.isNull(), "unknown").when(elevation > 0, "day").when(elevation > -6, "twilight").otherwise("night")


def exposure_label(median_iso: Column) -> Column:
    return F.when(median_iso.isNull(), F.lit(None).cast("string")).when(median_iso < 400, "day").otherwise("unknown")


def lighting_source(stored: Column, lighting: Column, lat: Column) -> Column:
    """The stored source, else the sun where there is a position and exposure where there isn't; - without lighting."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.when(F.coalesce(lighting, F.lit("")) == "", "-").when(lat.isNotNull(), "sun").otherwise("exposure"))


def solar_elevation(epoch: Column, lat: Column, lon: Column) -> Column:
    """Degrees of the sun above the horizon, by the low-precision almanac formula (about 0.01 degrees this century)."""
    n = epoch / 86_400.0 + 2_440_587.5 - 2_451_545.0
    mean_long, anomaly = F.pmod(280.460 + 0.9856474 * n, F.lit(360.0)), F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    ecliptic = F.radians(mean_long + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.0000004 * n)
    right, decl = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic)), F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.radians(F.pmod(280.46061837 + 360.98564736629 * n + lon, F.lit(360.0)))
    hour = sidereal - right
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(hour)))
