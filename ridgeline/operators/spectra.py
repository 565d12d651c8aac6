"""Averaged spectra: what periods a series has, and whether two stretches of it can be compared.

A series is cut into segments of as many samples, which are rows with an array; each is transformed under a Hann window,
and the powers of a series' segments are averaged by frequency. So no task holds a series, and a longer one only gives
a steadier spectrum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTS = 1024
LOW, HIGH, PEAKS, BLUR_HZ = 0.5, 8.0, 6, 0.05
#: Two stretches whose powers differ by more are not the same activity, and their shares say nothing.
POWER_RATIO = 25.0


def _powers(values: Column) -> Column:
    """The power of arrays of one length at each of their frequencies."""

    @F.pandas_udf("array<double>")
    def found(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.tolist()) if len(batch) else np.zeros((0, 2))
        x = (x - x.mean(axis=1, keepdims=True)) * np.hanning(x.shape[1])
        return pd.Series(list(np.abs(np.fft.rfft(x, axis=1)) ** 2))

    return found(values)


def segments(df: DataFrame, keys: list[str], value: str, points: int = POINTS) -> DataFrame:
    """(*keys, segment, values, rate): whole segments of df(*keys, t, value) in time order, without samples that are no numbers."""
    own = df.select(*keys, F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("__v")).where(F.abs("__v") < float("inf"))
    placed = own.withColumn("segment", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy("t")) - 1) / points).cast("long"))
    whole = placed.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("t", "__v"))).alias("__s")).where(F.size("__s") == points)
    rates = own.groupBy(*keys).agg(((F.count("*") - 1) / F.greatest(F.max("t") - F.min("t"), F.lit(1e-6))).alias("rate"))
    return whole.select(*keys, "segment", F.transform("__s", lambda s: s["__v"]).alias("values")).join(rates, keys)


def averaged(df: DataFrame, keys: list[str], value: str, points: int = POINTS) -> DataFrame:
    """(*keys, k, hz, power, segments): the mean power at each frequency over the segments of each series."""
    each = segments(df, keys, value, points).select(*keys, "rate", F.posexplode(_powers(F.col("values"))).alias("k", "power"))
    mean = each.groupBy(*keys, "k").agg((F.first("rate") * F.col("k") / points).alias("hz"), F.avg("power").alias("power"), F.count("*").alias("segments"))
    return mean.select(*keys, "k", "hz", "power", "segments")


def peaks(spectra: DataFrame, keys: list[str], most: int = PEAKS, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(*keys, rank, hz, share): the strongest local maxima of averaged() within [low, high], lightly smoothed, as shares of what is there.

    A series has as many frequencies as half a segment's samples, which is what one row holds here.
    """
    own = spectra.where(F.col("hz").between(low, high)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hz", "power"))).alias("__s"))
    step = F.get("__s", F.lit(1))["hz"] - F.get("__s", F.lit(0))["hz"]
    half = F.coalesce((F.greatest(F.lit(3), F.floor(F.lit(BLUR_HZ) / step).cast("int").bitwiseOR(F.lit(1))) / 2).cast("int"), F.lit(1))
    own = own.withColumn("__half", half)

    def around(s: Column, i: Column) -> Column:
        first, last = F.greatest(F.lit(0), i - F.col("__half")), F.least(F.size("__s") - 1, i + F.col("__half"))
        part = F.slice("__s", first + 1, last - first + 1)
        return F.struct(s["hz"].alias("hz"), (F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["power"]) / (last - first + 1)).alias("power"))

    own = own.select(*keys, F.transform("__s", around).alias("__m"))
    total = F.aggregate("__m", F.lit(0.0), lambda acc, x: acc + x["power"])
    up = lambda m, i: (i > 0) & (i < F.size("__m") - 1) & (m["power"] > F.get("__m", i - 1)["power"]) & (m["power"] >= F.get("__m", i + 1)["power"])
    tops = F.slice(F.array_sort(F.transform(F.filter("__m", up), lambda m: F.struct((-m["power"]).alias("less"), m["hz"].alias("hz")))), 1, most)
    out = own.select(*keys, total.alias("__total"), F.posexplode(tops).alias("__i", "__p"))
    share = F.when(F.col("__total") > 0, -F.col("__p.less") / F.col("__total")).otherwise(0.0)
    return out.select(*keys, (F.col("__i") + 1).alias("rank"), F.col("__p.hz").alias("hz"), share.alias("share"))


def band_shares(spectra: DataFrame, keys: list[str], edges: list[tuple[float, float]]) -> DataFrame:
    """(*keys, band, power, total, share) of averaged() in each band [lo, hi); total is that of all bands."""
    table = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(edges)])
    each = spectra.select(*keys, "hz", "power", F.inline(table))
    inside = F.when((F.col("hz") >= F.col("lo")) & (F.col("hz") < F.col("hi")), F.col("power")).otherwise(0.0)
    own = each.groupBy(*keys, "band").agg(F.sum(inside).alias("power"))
    total = F.sum("power").over(W.partitionBy(*keys))
    return own.select(*keys, "band", "power", total.alias("total"), F.try_divide("power", total).alias("share"))


def band_changes(df: DataFrame, keys: list[str], value: str, part: Column, edges: list[tuple[float, float]], points: int = POINTS, ratio: float = POWER_RATIO) -> DataFrame:
    """(*keys, band, share_before, share_after, change, comparable) between the stretches of df where part is 0 and where it is 1.

    change is null, as the shares are, where the total powers differ by the ratio or more; series without both have no rows.
    """
    own = df.withColumn("__part", part.cast("int")).where("__part in (0, 1)")
    shares = band_shares(averaged(own, [*keys, "__part"], value, points), [*keys, "__part"], edges)
    of = lambda c, p: F.max(F.when(F.col("__part") == p, F.col(c)))
    both = shares.groupBy(*keys, "band").agg(of("share", 0).alias("__a"), of("share", 1).alias("__b"), of("total", 0).alias("__ta"), of("total", 1).alias("__tb")).where("__ta is not null and __tb is not null")
    factor = F.try_divide(F.greatest("__ta", "__tb"), F.least("__ta", "__tb"))
    near = F.coalesce(factor < ratio, F.col("__ta") == F.col("__tb"))
    shown = lambda c: F.when(near, c)
    return both.select(*keys, "band", shown(F.col("__a")).alias("share_before"), shown(F.col("__b")).alias("share_after"), shown(F.col("__b") - F.col("__a")).alias("change"), near.alias("comparable"))
