"""From telemetry to a row of features a second, and the clock of a ride's chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import clock
from ridgeline.functions.numbers import dot, norm, normalised, quat_conjugate, quat_rotate, roll_angle
from ridgeline.kernels import filters
from ridgeline.operators import gates, series

ASSET = "content_hash"
MIN_SLOPE = 21
#: A container clock further off than this is replaced by the position's.
MAX_DRIFT = 300.0


def to_grid(samples: DataFrame, columns: list[str], step: float = 0.1) -> DataFrame:
    """(content_hash, t, *columns) on an even grid, each column interpolated across gaps of up to 5 seconds and absent elsewhere.
    samples(content_hash, t, *columns) may have rows of several streams, with nulls in the columns that a stream lacks."""
    spans = samples.groupBy(ASSET).agg(F.max("t").alias("__end"))
    out = series.grid(spans.withColumn("__end", F.col("__end") + step), ASSET, "__end", step).withColumn("t", F.round("t", 6))
    points = out
    for c in columns:
        out = out.join(series.interpolate(points, samples.select(ASSET, "t", c), ASSET, c, series.MAX_GAP, clamp=False), [ASSET, "t"], "left")
    return out


def onto(points: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """points with the columns of samples on the points' clock, ends held: one stream laid onto another's."""
    out = points
    for c in columns:
        out = out.join(series.interpolate(points.select(ASSET, "t"), samples.select(ASSET, "t", c), ASSET, c), [ASSET, "t"], "left")
    return out


def signed_turn() -> Column:
    """Rotation about the vertical from gyro_0..2 and grav_0..2."""
    return dot([F.col(f"gyro_{i}") for i in range(3)], normalised([F.col(f"grav_{i}") for i in range(3)]))


def descent(grid: DataFrame, altitude: str) -> DataFrame:
    """(content_hash, t, grade): descent in metres a second from altitude a second: bridged, median of 9, slope over 21 s,
    negated, absent where altitude was and for series of fewer than 21 altitudes."""
    known = grid.select(ASSET, "t", F.col(altitude).alias("__alt"))
    bridged = series.interpolate(known.select(ASSET, "t"), known, ASSET, "__alt").withColumnRenamed("__alt", "__b")
    rows = bridged.join(known, [ASSET, "t"]).withColumn("__n", F.count("__alt").over(W.partitionBy(ASSET))).where(f"__n >= {MIN_SLOPE}")
    smooth = rows.withColumn("__m", series.median_filter(ASSET, "t", "__b"))
    slope = smooth.withColumn("__s", -series.windowed_slope(ASSET, "t", "__m"))
    return slope.select(ASSET, "t", F.when(F.col("__alt").isNotNull(), F.col("__s")).alias("grade"))


def native_or_grid(fused: DataFrame, telemetry: DataFrame, least: int = 64) -> DataFrame:
    """(content_hash, t, gyro_0..2, grav_0..2): the samples at the gyroscope's own rate, and for assets that have no more than the least of
    them those of the 10 Hz grid, in which faster turns are lost already."""
    columns = [ASSET, "t", *[f"{s}_{i}" for s in ("gyro", "grav") for i in range(3)]]
    if not set(columns) <= set(telemetry.columns):
        return fused.select(*columns)
    enough = fused.groupBy(ASSET).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(ASSET)
    return fused.join(enough, ASSET, "left_semi").select(*columns).unionByName(telemetry.join(enough, ASSET, "left_anti").select(*columns))


def twice(samples: DataFrame, value: str) -> DataFrame:
    """samples of the assets that have a value at two of them at least: one alone is no series."""
    n = F.count(F.when(F.abs(F.col(value).cast("double")) < float("inf"), 1)).over(W.partitionBy(ASSET))
    return samples.withColumn("__n", n).where("__n >= 2").drop("__n")


def compute(assets: DataFrame, telemetry: DataFrame, imu: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, air events): a row for every second of assets(content_hash, duration_s).

    telemetry is on the 10 Hz grid, imu at its own rate. Speed needs a lock and good dilution; grade also needs to be
    possible at that speed; cornering force is turn times speed. An event's air time is credited to the second it starts
    in, the longest one there; without an IMU roughness and air are unknown rather than none.
    """
    grid = series.grid(assets, ASSET, "duration_s")
    gated = gates.lock_gate(telemetry, ASSET, "gps_speed2d", "gps_fix")
    gated = gated.withColumn("__speed", gates.dop_gate(gates.plausible_speed(F.col("gps_speed2d")), F.col("gps_dop"))).withColumn("__alt", gates.dop_gate(F.col("gps_alt"), F.col("gps_dop"), F.col("gps_fix")))
    speed = series.interpolate(grid, twice(gated.select(ASSET, "t", F.col("__speed").alias("speed_ms")), "speed_ms"), ASSET, "speed_ms", series.MAX_GAP, clamp=False)
    altitude = series.interpolate(grid, twice(gated.select(ASSET, "t", "__alt"), "__alt"), ASSET, "__alt", series.MAX_GAP, clamp=False)
    gravity = telemetry.select(ASSET, "t", "grav_0", "grav_1", "grav_2")
    fused = onto(imu.select(ASSET, "t", "gyro_0", "gyro_1", "gyro_2"), gravity, ["grav_0", "grav_1", "grav_2"])
    turn = filters.turn_rate(native_or_grid(fused, telemetry), ASSET).withColumnRenamed("value", "yaw_rate")
    rough = filters.roughness(imu, ASSET).withColumnRenamed("value", "rough")
    accl = imu.select(ASSET, "t", norm(*[F.col(f"accl_{i}") for i in range(3)]).alias("__mag"))
    air = series.freefall(accl, ASSET, "t", "__mag")
    credited = air.groupBy(ASSET, F.floor("t_start").cast("double").alias("t")).agg(F.max("duration").alias("__air"))
    has_imu = imu.select(ASSET).distinct().withColumn("__imu", F.lit(True))
    out = grid
    for part in (turn, speed, descent(altitude, "__alt"), rough, credited):
        out = out.join(part, [ASSET, "t"], "left")
    out = out.join(has_imu, ASSET, "left")
    scores = out.select(
        ASSET, "t", "yaw_rate", "speed_ms", gates.bound_by_speed(F.col("grade"), F.col("speed_ms")).alias("grade"),
        (F.col("yaw_rate") * F.col("speed_ms")).alias("lat_accel"), "rough", F.when(F.col("__imu"), F.coalesce("__air", F.lit(0.0))).alias("air_s"),
    )
    return scores, air


def gps_start(telemetry: DataFrame) -> DataFrame:
    """(content_hash, started): Unix seconds of the start, the median over locked samples; at least ten are needed."""
    locked = telemetry.where("gps_days > 3650 and gps_fix >= 2 and gps_secs is not null")
    out = locked.groupBy(ASSET).agg(F.count("*").alias("__n"), F.percentile(clock.gps_epoch(F.col("gps_days"), F.col("gps_secs"), F.col("t")), F.lit(0.5)).alias("started"))
    return out.where("__n >= 10").drop("__n")


def retime(assets: DataFrame, starts: DataFrame) -> DataFrame:
    """assets with started, drift_s and lighting. A chapter starts at its own position's time, else after the chapters since the
    ride's last known start, else by the container if that isn't far off. Lighting set by hand stays; without any position it
    comes from exposure(median ISO) in assets.iso."""
    own = assets.join(starts, ASSET, "left").withColumn("__ride", F.coalesce("ride_id", ASSET))
    timed = series.with_carried_time(own.withColumnRenamed("started", "__gps"), "__ride", "chapter", "__gps", "duration_s", "__carried")
    container = clock.epoch(F.col("recorded_at"))
    started = F.coalesce("__carried", container)
    timed = timed.withColumn("drift_s", F.col("__gps") - container).withColumn("started", started)
    elevation = clock.solar_elevation(F.col("started"), F.col("gps_lat"), F.col("gps_lon"))
    label = F.when(F.col("lighting_source") == "hand", F.col("lighting")).when(F.col("gps_lat").isNotNull(), clock.lighting_label(elevation)).otherwise(clock.exposure_label(F.col("iso")))
    source = F.when(F.col("lighting_source") == "hand", "hand").when(F.col("gps_lat").isNotNull(), "sun").when(F.col("iso").isNotNull(), "exposure")
    timed = timed.withColumn("__l", label).withColumn("__s", source)
    return timed.drop("lighting", "lighting_source", "__gps", "__carried", "__ride").withColumnsRenamed({"__l": "lighting", "__s": "lighting_source"})


def recorded(container: Column, gps: Column) -> Column:
    """The container's time, unless the position's is further off than five minutes."""
    return F.when(F.abs(gps - container) > MAX_DRIFT, gps).otherwise(F.coalesce(container, gps))


def body_roll(telemetry: DataFrame, axis: int = 2, asset: str = ASSET, least: int = 10) -> DataFrame:
    """(asset, t, axis, roll): degrees that the body leans, from grav_0..2, if the axis is the one that the camera looks along.

    Down is the other axis that carries more of an asset's mean gravity, whichever way it points, so level is zero. Samples
    without a direction have no roll, and assets with fewer than the least of others no rows. Angles are not unwrapped.
    """
    g = [F.col(f"grav_{i}").cast("double") for i in range(3)]
    whole = F.coalesce(norm(*g) > 1e-6, F.lit(False)) & F.coalesce(norm(*g) < float("inf"), F.lit(False))
    own = telemetry.select(asset, "t", *[F.when(whole, x / norm(*g)).alias(f"__{i}") for i, x in enumerate(g)])
    p, q = (i for i in range(3) if i != axis)
    means = own.groupBy(asset).agg(F.count(f"__{p}").alias("__n"), *[F.avg(f"__{i}").alias(f"__m{i}") for i in (p, q)]).where(F.col("__n") >= least)
    first = F.abs(f"__m{p}") >= F.abs(f"__m{q}")
    side, down = F.when(first, F.col(f"__{q}")).otherwise(F.col(f"__{p}")), F.when(first, F.col(f"__{p}")).otherwise(F.col(f"__{q}"))
    upright = F.signum(F.when(first, F.col(f"__m{p}")).otherwise(F.col(f"__m{q}")))
    return own.join(means, asset).select(asset, "t", F.lit(axis).alias("axis"), roll_angle(side, upright * down).alias("roll"))


def roll_fit(tilts: DataFrame, asset: str = ASSET, least: int = 12) -> DataFrame:
    """(asset, axis, corr, gain, constant, usable) of tilts(asset, axis, tilt, roll, confidence): the candidate axis whose body
    roll follows the tilt seen in the picture best. Usable with enough frames, a correlation of 0.35 and a plausible gain."""
    fit = tilts.groupBy(asset, "axis").agg(
        F.count("*").alias("n"), F.corr("tilt", "roll").alias("corr"), F.regr_slope("tilt", "roll").alias("gain"),
        F.try_divide(F.sum(F.col("confidence") * F.col("tilt")), F.sum("confidence")).alias("constant"),
    )
    best = fit.groupBy(asset).agg(F.max_by(F.struct("axis", "n", "corr", "gain", "constant"), F.abs("corr")).alias("b")).select(asset, "b.*")
    usable = (F.col("n") >= least) & (F.abs("corr") >= 0.35) & F.abs("gain").between(0.08, 1.5)
    return best.withColumn("usable", F.coalesce(usable, F.lit(False)))


def visible_roll(rolls: DataFrame, fits: DataFrame, asset: str = ASSET) -> DataFrame:
    """rolls(asset, t, axis, roll) with visible: gain times the roll off its median, plus the constant tilt; of usable fits only."""
    own = rolls.join(fits.where("usable").select(asset, "axis", "gain", "constant"), [asset, "axis"])
    middle = own.groupBy(asset).agg(F.percentile("roll", F.lit(0.5)).alias("__mid"))
    return own.join(middle, asset).withColumn("visible", F.col("gain") * (F.col("roll") - F.col("__mid")) + F.col("constant")).drop("__mid")


def direction_spread(df: DataFrame, group: str, vectors: dict[str, list[Column]]) -> DataFrame:
    """(group, *names): the mean angle in degrees of each named vector from its mean direction; null for fewer than two vectors.
    Vectors without length or with a part that is missing don't count."""
    units = df.select(group, *[F.array(*[F.when(norm(*v) > 1e-9, x / norm(*v)) for x in v]).alias(k) for k, v in vectors.items()])
    whole = {k: F.exists(k, lambda x: x.isNull() | F.isnan(x)) for k in vectors}
    units = units.select(group, *[F.when(~whole[k], F.col(k)).alias(k) for k in vectors])
    means = units.groupBy(group).agg(*[F.array(*[F.avg(F.get(k, F.lit(i))) for i in range(3)]).alias(f"__m_{k}") for k in vectors], *[F.count(k).alias(f"__n_{k}") for k in vectors])
    both = units.join(means, group)

    def angle(k: str) -> Column:
        mean = [F.get(f"__m_{k}", F.lit(i)) for i in range(3)]
        along = F.try_divide(dot([F.get(k, F.lit(i)) for i in range(3)], mean), norm(*mean))
        return F.when(F.col(f"__n_{k}") > 1, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along)))))

    return both.groupBy(group).agg(*[F.avg(angle(k)).alias(k) for k in vectors])


def roll_suppression(telemetry: DataFrame, group: str = ASSET, least: float = 0.5) -> DataFrame:
    """(group, spread, image_spread, suppression, locked): how much steadier gravity is in the picture than in the body.

    Gravity is turned by the image orientation both ways, since files don't tell which one is meant, and the steadier one
    counts. A body that moves by half a degree or less tells nothing.
    """
    gravity, turn = [F.col(f"grav_{i}") for i in range(3)], [F.col(f"iori_{x}") for x in "wxyz"]
    found = direction_spread(telemetry, group, {"spread": gravity, "__one": quat_rotate(quat_conjugate(turn), gravity), "__two": quat_rotate(turn, gravity)})
    image = F.least("__one", "__two")
    share = F.when(F.col("spread") > least, 1 - image / F.col("spread"))
    return found.select(group, "spread", image.alias("image_spread"), share.alias("suppression"), (share > 0.5).alias("locked"))


def level_summary(rolls: DataFrame, fits: DataFrame, asset: str = ASSET, least: float = 1.5) -> DataFrame:
    """(asset, n, constant, spread, most, worth) of rolls(asset, t, axis, roll), of usable fits only: the median lean of the
    picture in degrees, the span of the middle nine tenths and the greatest size around it, and if the median is worth a turn."""
    seen = visible_roll(rolls, fits, asset).where(F.abs("visible") < float("inf"))
    p = lambda q: F.percentile("visible", F.lit(q))
    out = seen.groupBy(asset).agg(F.count("*").alias("n"), p(0.5).alias("constant"), p(0.95).alias("__hi"), p(0.05).alias("__lo"), F.max("visible").alias("__max"), F.min("visible").alias("__min"))
    most = F.greatest(F.col("__max") - F.col("constant"), F.col("constant") - F.col("__min"))
    return out.select(asset, "n", "constant", (F.col("__hi") - F.col("__lo")).alias("spread"), most.alias("most"), (F.abs("constant") >= least).alias("worth"))


def turn_spread(df: DataFrame, group: str, order: str, turn: list[str]) -> DataFrame:
    """(group, spread): the mean angle in degrees of unit quaternions from their mean. A quaternion and its negative are the same
    turn, so all are brought to the side of the group's first one."""
    q = [F.col(c) for c in turn]
    size = norm(*q)
    known = df.where((size > 1e-9) & (size < float("inf"))).select(group, order, *[(c / size).alias(f"__q{i}") for i, c in enumerate(q)])
    first = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    side = F.signum(dot([F.col(f"__q{i}") for i in range(4)], [F.first(f"__q{i}").over(first) for i in range(4)]))
    own = known.withColumn("__side", side).select(group, *[(F.col(f"__q{i}") * F.col("__side")).alias(f"__q{i}") for i in range(4)])
    means = own.groupBy(group).agg(F.count("*").alias("__n"), *[F.avg(f"__q{i}").alias(f"__m{i}") for i in range(4)])
    mean = [F.col(f"__m{i}") for i in range(4)]
    along = F.abs(F.try_divide(dot([F.col(f"__q{i}") for i in range(4)], mean), norm(*mean)))
    angle = F.degrees(2 * F.acos(F.least(F.lit(1.0), along)))
    return own.join(means.where("__n > 1"), group).groupBy(group).agg(F.avg(angle).alias("spread"))
