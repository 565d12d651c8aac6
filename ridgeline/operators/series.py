"""Series by asset and time: grids, interpolation, windows, islands, slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_GAP = 5.0


def grid(spans: DataFrame, asset: str, end: str, step: float = 1.0) -> DataFrame:
    """(asset, t) at 0, step, 2 step, ... below end, which is at least one step."""
    n = F.ceil(F.round(F.greatest(F.col(end).cast("double"), F.lit(step)) / step, 9)).cast("long")
    return spans.select(asset, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("__i")).select(asset, (F.col("__i") * step).alias("t"))


def _around(points: DataFrame, samples: DataFrame, asset: str, value: str) -> DataFrame:
    """points(asset, t) with (t0, v0), the last sample at or before t, and (t1, v1), the first at or after it.

    Points and samples are laid in one order by (t, samples first); each row takes the last sample so far in that order,
    and the last so far in the opposite one. Both frames only grow, so each is one pass, however long a series is.
    """
    none = F.lit(None).cast("struct<t:double,v:double>")
    own = samples.where(F.col(value).isNotNull()).select(asset, F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    both = points.select(asset, F.col("t").cast("double").alias("t"), none.alias("__s"), F.lit(1).alias("__p")).unionByName(
        own.select(asset, "t", F.struct("t", "v").alias("__s"), F.lit(0).alias("__p"))
    )
    up = W.partitionBy(asset).orderBy("t", "__p").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(asset).orderBy(F.desc("t"), "__p").rowsBetween(W.unboundedPreceding, 0)
    found = both.select(asset, "t", "__p", F.last("__s", ignorenulls=True).over(up).alias("__a"), F.last("__s", ignorenulls=True).over(down).alias("__b"))
    return found.where("__p = 1").select(asset, "t", F.col("__a.t").alias("t0"), F.col("__a.v").alias("v0"), F.col("__b.t").alias("t1"), F.col("__b.v").alias("v1"))


def interpolate(points: DataFrame, samples: DataFrame, asset: str, value: str, max_gap: float | None = None, clamp: bool = True) -> DataFrame:
    """points(asset, t) with the value of samples(asset, t, value) interpolated linearly at t.

    One exchange by asset and no range join. Outside the samples the end values hold if clamp; a bracket
    longer than max_gap is no value.
    """
    found = _around(points, samples, asset, value)
    span = F.col("t1") - F.col("t0")
    inner = F.when(F.col("t0") == F.col("t"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / F.nullif(span, F.lit(0.0)))
    if max_gap is not None:
        inner = F.when((F.col("t0") == F.col("t")) | (span <= max_gap), inner)
    ends = F.coalesce(inner, F.when(F.col("t1").isNull(), F.col("v0")), F.when(F.col("t0").isNull(), F.col("v1"))) if clamp else inner
    return found.select(asset, "t", ends.alias(value))


def nearest(points: DataFrame, samples: DataFrame, asset: str, value: str, tolerance: float) -> DataFrame:
    """points with the value of the sample nearest in time, the earlier one of two, within the tolerance."""
    found = _around(points, samples, asset, value)
    before, after = F.col("t") - F.col("t0"), F.col("t1") - F.col("t")
    early = before.isNotNull() & (after.isNull() | (before <= after))
    gap = F.when(early, before).otherwise(after)
    return found.select(asset, "t", F.when(gap <= tolerance, F.when(early, F.col("v0")).otherwise(F.col("v1"))).alias(value))


def by_second(df: DataFrame, asset: str, how: dict[str, Column], least: int = 1) -> DataFrame:
    """Aggregates of each whole second, of those with at least so many samples."""
    out = df.groupBy(asset, F.floor("t").alias("second")).agg(F.count("*").alias("__n"), *[c.alias(k) for k, c in how.items()])
    return out.where(F.col("__n") >= least).drop("__n")


def rms(column: str) -> Column:
    return F.sqrt(F.avg(F.col(column) * F.col(column)))


def islands(df: DataFrame, asset: str, order: str, flag: Column) -> DataFrame:
    """(asset, first, last, n, end) of each run of rows with the flag, in order; end is the row after the run, null at the series' end."""
    by = W.partitionBy(asset).orderBy(order)
    on = df.select("*", F.coalesce(flag, F.lit(False)).alias("__on"), F.row_number().over(by).alias("__all"), F.lead(order).over(by).alias("__next"))
    runs = on.where("__on").withColumn("__run", F.col("__all") - F.row_number().over(W.partitionBy(asset).orderBy(order)))
    return runs.groupBy(asset, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.max_by("__next", F.col(order)).alias("end")).drop("__run")


def freefall(df: DataFrame, asset: str, t: str, magnitude: str, low: float = 3.5, least: float = 0.10, impact: float = 18.0, ahead_s: float = 0.6) -> DataFrame:
    """(asset, t_start, t_end, duration, landing): runs of low magnitude that last and are followed by an impact.

    A run ends at the first sample after it (or its last, at the series' end). The landing is the greatest magnitude
    of the next int(0.6 rate) samples, the rate being the asset's samples over its span.
    """
    by = W.partitionBy(asset).orderBy(t)
    every = W.partitionBy(asset)
    rate = F.count("*").over(every) / F.greatest(F.max(t).over(every) - F.min(t).over(every), F.lit(1e-6))
    rows = df.select(asset, t, magnitude, F.row_number().over(by).alias("__i"), F.floor(F.round(rate * ahead_s, 9)).cast("long").alias("__ahead"), F.count("*").over(every).alias("__n"))
    rows = rows.where("__n >= 10")
    runs = islands(rows, asset, "__i", F.col(magnitude) < low)
    runs = runs.select(asset, "first", F.coalesce("end", "last").alias("stop"), (F.col("last") + 1).alias("after"))
    # the landing window by equal keys: each run lists the sample numbers of its window
    spans = rows.groupBy(asset).agg(F.first("__ahead").alias("__ahead"))
    at = runs.join(spans, asset).where("__ahead > 0").select(asset, "first", F.explode(F.sequence(F.col("after"), F.col("after") + F.col("__ahead") - 1)).alias("__i"))
    peaks = at.join(rows.select(asset, "__i", magnitude), [asset, "__i"]).groupBy(asset, "first").agg(F.max(magnitude).alias("landing"))
    times = rows.select(asset, "__i", F.col(t).alias("__t"))
    out = runs.join(times.select(asset, F.col("__i").alias("first"), F.col("__t").alias("t_start")), [asset, "first"])
    out = out.join(times.select(asset, F.col("__i").alias("stop"), F.col("__t").alias("t_end")), [asset, "stop"]).join(peaks, [asset, "first"], "left")
    out = out.withColumn("duration", F.col("t_end") - F.col("t_start")).withColumn("landing", F.coalesce("landing", F.lit(0.0)))
    return out.where((F.col("duration") >= least) & (F.col("landing") >= impact)).select(asset, "t_start", "t_end", "duration", "landing")


def _padded(asset: str, order: str, value: str, offsets: range) -> list[Column]:
    """The values at each offset with the ends repeated."""
    by = W.partitionBy(asset).orderBy(order)
    every = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(every), F.last(value).over(every)
    return [F.col(value) if k == 0 else F.coalesce(F.lag(value, -k).over(by), first if k < 0 else last) for k in offsets]


def windowed_slope(asset: str, order: str, value: str, half: int = 10) -> Column:
    """Least-squares slope over a centred window with repeated ends: sum(k y) / sum(k k). The value must not be null."""
    terms = _padded(asset, order, value, range(-half, half + 1))
    total = F.lit(0.0)
    for k, y in zip(range(-half, half + 1), terms, strict=True):
        if k:
            total = total + k * y
    return total / (2 * sum(k * k for k in range(1, half + 1)))


def median_filter(asset: str, order: str, value: str, width: int = 9) -> Column:
    """Centred median with repeated ends. The value must not be null."""
    half = width // 2
    return F.get(F.sort_array(F.array(*_padded(asset, order, value, range(-half, half + 1)))), F.lit(half))


def rolling_median(asset: str, order: str, value: str, width: int) -> Column:
    """Centred median over the rows there are."""
    half = width // 2
    return F.percentile(value, F.lit(0.5)).over(W.partitionBy(asset).orderBy(order).rowsBetween(-half, width - 1 - half))


def peaks(df: DataFrame, asset: str, order: str, value: str, floor: Column) -> DataFrame:
    """Rows that are local maxima at or above the floor: strictly above the row before, at least the one after; both ends if strictly above their neighbour."""
    by = W.partitionBy(asset).orderBy(order)
    out = df.select("*", F.lag(value).over(by).alias("__was"), F.lead(value).over(by).alias("__will"))
    v = F.col(value)
    first, last = F.col("__was").isNull(), F.col("__will").isNull()
    top = F.when(first & last, F.lit(True)).when(first, v > F.col("__will")).when(last, v > F.col("__was")).otherwise((v > F.col("__was")) & (v >= F.col("__will")))
    return out.where((v >= floor) & top).drop("__was", "__will")


def full_trailing_mean(asset: str, order: list[str], value: str, width: int = 12) -> Column:
    """Mean of the last rows, only where there are as many."""
    frame = W.partitionBy(asset).orderBy(*order).rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(frame) == width, F.avg(value).over(frame))


def gradient(asset: str, order: str, value: str, at: str) -> Column:
    """Central differences, one-sided at the ends."""
    by = W.partitionBy(asset).orderBy(order)
    up, down = F.coalesce(F.lead(value).over(by), F.col(value)), F.coalesce(F.lag(value).over(by), F.col(value))
    right, left = F.coalesce(F.lead(at).over(by), F.col(at)), F.coalesce(F.lag(at).over(by), F.col(at))
    return (up - down) / F.nullif(right - left, F.lit(0.0))


def arc_length(asset: str, order: str, x: str, y: str) -> Column:
    """Way covered so far. Needs columns __dx and __dy free: steps() makes them."""
    return F.sum(F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2)).over(W.partitionBy(asset).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def steps(df: DataFrame, asset: str, order: str, x: str, y: str) -> DataFrame:
    by = W.partitionBy(asset).orderBy(order)
    return df.withColumn("__dx", F.coalesce(F.col(x) - F.lag(x).over(by), F.lit(0.0))).withColumn("__dy", F.coalesce(F.col(y) - F.lag(y).over(by), F.lit(0.0)))


def with_carried_time(df: DataFrame, asset: str, order: str, anchor: str, duration: str, name: str = "start") -> DataFrame:
    by = W.partitionBy(asset).orderBy(order)
    out = df.withColumn("__before", F.coalesce(F.sum(duration).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("__base", F.last(F.when(F.col(anchor).isNotNull(), F.col(anchor) - F.col("__before")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn(name, F.col("__base") + F.col("__before")).drop("__before", "__base")


def payload_times(df: DataFrame, asset: str, order: str, stamp: str, n: str) -> DataFrame:
    """df with a row per sample: j and t spread evenly to the next payload's stamp. Where there is no next stamp the samples
    are as far apart as in the payload before, or share a second. A payload without a stamp starts at its place."""
    by = W.partitionBy(asset).orderBy(order)
    own = F.when(F.col(n) > 0, (F.lead(stamp).over(by) - F.col(stamp)) / F.col(n))
    out = df.withColumn("__step", own).withColumn("__place", F.row_number().over(by) - 1)
    before = F.last("__step", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("__step", F.coalesce("__step", before, 1 / F.nullif(F.col(n).cast("double"), F.lit(0.0))))
    out = out.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias("j"))
    return out.withColumn("t", F.coalesce(F.col(stamp).cast("double"), F.col("__place").cast("double")) + F.col("j") * F.col("__step")).drop("__step", "__place")


def hold_then_ease(df: DataFrame, asset: str, order: str, value: str, centre: float, hold: float = 1.0, ease: float = 2.0, weights: tuple = (1.0, 0.8, 0.2, 0.6)) -> DataFrame:
    """df with target and weight: seen rows aim at themselves; a gap holds the last aim, eases to the centre along a
    raised cosine, then stays there; rows before the first sighting hold that one backwards."""
    track, held, eased, lost = weights
    by = W.partitionBy(asset).orderBy(order)
    back = by.rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(asset).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    seen = F.col(value).isNotNull()
    out = df.select(
        "*",
        F.last(F.when(seen, F.col(order)), ignorenulls=True).over(back).alias("__t"),
        F.last(value, ignorenulls=True).over(back).alias("__last"),
        F.last(value, ignorenulls=True).over(ahead).alias("__next"),
    )
    age = F.col(order) - F.col("__t")
    blend = 0.5 * (1 - F.cos(F.lit(3.141592653589793) * (age - hold) / ease))
    target = F.when(seen, F.col(value)).when(age.isNull(), F.coalesce("__next", F.lit(centre))).when(age <= hold, F.col("__last")).when(age <= hold + ease, F.col("__last") + (centre - F.col("__last")) * blend).otherwise(F.lit(centre))
    weight = F.when(seen, F.lit(track)).when(age.isNull(), F.when(F.col("__next").isNotNull(), F.lit(held)).otherwise(F.lit(lost))).when(age <= hold, F.lit(held)).when(age <= hold + ease, eased + (lost - eased) * blend).otherwise(F.lit(lost))
    return out.withColumn("target", target).withColumn("weight", weight).drop("__t", "__last", "__next")
