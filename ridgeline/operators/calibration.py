"""Corpus calibration: percentile tables, ranks, levels by availability, composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.numbers import availability_key, power_mean, rank_interp, rising
from ridgeline.operators import quantiles

BREAKS = 101
MIN_FEATURE, MIN_BUCKET, SPREAD = 100, 200, 1e-9
AIR_FULL, AIR_GAIN = 0.80, 0.75
WEIGHTS = {"speed": 0.0, "turn": 0.15, "rough": 0.85, "descent": 0.0}
SHARPNESS = 2.0


def grid() -> Column:
    return F.array(*[F.lit(i / (BREAKS - 1)) for i in range(BREAKS)])


def long_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(*keys, feature, value) rows of the features that are present."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.inline(pairs)).where("value is not null")


def corpus_breaks(df: DataFrame, features: list[str], approximate: bool = False) -> DataFrame:
    """(feature, n, breaks, reason): 101 linearly interpolated percentiles of each feature.

    breaks are null, with a reason, for features that cannot be ranked. Exact percentiles are selected by refined
    counts, in jobs that run at the call; approximate takes them from a bounded sketch, in one lazy pass.
    """
    own = long_features(df, [], features)
    if approximate:
        found = own.groupBy("feature").agg(F.count("value").alias("n"), F.percentile_approx("value", grid(), 100_000).alias("breaks"))
    else:
        found = quantiles.percentiles(own.withColumnRenamed("feature", "g"), BREAKS).withColumnRenamed("g", "feature")
    all_ = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    joined = all_.join(found, "feature", "left")
    n = F.coalesce("n", F.lit(0))
    flat = F.get("breaks", F.lit(99)) - F.get("breaks", F.lit(1)) <= SPREAD
    reason = F.when(n == 0, "absent").when(n < MIN_FEATURE, "too few").when(flat, "no spread")
    return joined.select("feature", n.alias("n"), F.when(reason.isNull(), rising(F.col("breaks"))).alias("breaks"), reason.alias("reason"))


def with_breaks(df: DataFrame, breaks: DataFrame, features: list[str]) -> DataFrame:
    """df with a column b_<feature> for each feature's breaks: one row of features, so it is broadcast."""
    wide = breaks.groupBy().agg(*[F.first(F.when(F.col("feature") == f, F.col("breaks")), ignorenulls=True).alias(f"b_{f}") for f in features])
    return df.join(F.broadcast(wide))


def ranked(df: DataFrame, breaks: DataFrame, features: list[str]) -> DataFrame:
    """df with s_<feature>: the percentile rank of each feature, null where it or its breaks are absent."""
    out = with_breaks(df, breaks, features)
    return out.select(*df.columns, *[rank_interp(F.col(f).cast("double"), F.col(f"b_{f}")).alias(f"s_{f}") for f in features])


#: What each sub-score ranks, the first that an asset's second has: cornering force where the speed is known, else the turn.
SOURCES = {"speed": ("speed_ms",), "turn": ("lat_accel", "yaw_rate"), "rough": ("rough",), "descent": ("grade",)}


def score_breaks(scores: DataFrame, approximate: bool = False) -> DataFrame:
    """corpus_breaks() of all columns that sub-scores rank."""
    return corpus_breaks(scores, [c for own in SOURCES.values() for c in own], approximate)


def sub_scores(scores: DataFrame, breaks: DataFrame) -> DataFrame:
    """scores with s_speed, s_turn, s_rough, s_descent and s_air."""
    columns = [c for own in SOURCES.values() for c in own]
    out = ranked(scores, breaks, columns)
    subs = [F.coalesce(*[F.col(f"s_{c}") for c in own]).alias(f"s_{k}") for k, own in SOURCES.items()]
    return out.select(*scores.columns, *subs, air_score(F.col("air_s")).alias("s_air"))


def leveled(df: DataFrame, subs: list[str], weights: list[float], sharpness: float = SHARPNESS) -> DataFrame:
    """df with level_raw, the power mean of the sub-scores, and key, which of them it is made of."""
    present = [F.col(s).isNotNull() & F.lit(w > 0) for s, w in zip(subs, weights, strict=True)]
    return df.withColumn("level_raw", power_mean([F.col(s) for s in subs], weights, sharpness or SHARPNESS)).withColumn("key", availability_key(present))


def level_breaks(levels: DataFrame, approximate: bool = False) -> DataFrame:
    """(key, n, breaks) of each availability key with enough rows, and of all rows (key null). Exact ones by refined counts,
    in jobs that run at the call; approximate ones from a bounded sketch, in one lazy pass."""
    own = levels.where("level_raw is not null")
    kind = levels.schema["key"].dataType
    if approximate:
        sets = own.groupingSets([["key"], []], "key")
        found = sets.agg(F.grouping("key").alias("every"), F.count("level_raw").alias("n"), F.percentile_approx("level_raw", grid(), 100_000).alias("breaks"))
    else:
        # a group for each key, and one that no key is called
        groups = F.explode(F.array(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("null")), F.lit("every")))
        found = quantiles.percentiles(own.select(groups.alias("g"), F.col("level_raw").alias("value")), BREAKS)
        found = found.select((F.col("g") == "every").cast("int").alias("every"), F.when(F.startswith("g", F.lit("=")), F.substr("g", F.lit(2))).cast(kind).alias("key"), "n", "breaks")
    return found.where((F.col("every") == 1) | (F.col("n") >= MIN_BUCKET)).select(F.when(F.col("every") == 0, F.col("key")).alias("key"), "n", rising(F.col("breaks")).alias("breaks"))


def level_ranks(levels: DataFrame, buckets: DataFrame) -> DataFrame:
    """levels with level: the rank in the bucket of the row's key, else among all. At most 16 buckets: broadcast."""
    own = buckets.where("key is not null").select(F.col("key").alias("__key"), F.col("breaks").alias("__own"))
    every = buckets.where("key is null").agg(F.first("breaks").alias("__every"))
    out = levels.join(F.broadcast(own), F.col("key") == F.col("__key"), "left").join(F.broadcast(every))
    return out.select(*levels.columns, rank_interp(F.col("level_raw"), F.coalesce("__own", "__every")).alias("level"))


def smooth(column: str, asset: str, order: list[str], half: int = 1) -> Column:
    """Centred mean that ignores missing values."""
    return F.avg(column).over(W.partitionBy(asset).orderBy(*order).rowsBetween(-half, half))


def dilate(column: str | Column, asset: str, order: list[str], half: int = 1) -> Column:
    """Centred maximum that ignores missing values."""
    return F.max(column).over(W.partitionBy(asset).orderBy(*order).rowsBetween(-half, half))


def air_score(air_s: Column) -> Column:
    return F.when(air_s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), air_s / AIR_FULL)))


def composite(df: DataFrame, asset: str, order: list[str]) -> DataFrame:
    """df(level, s_air) with level_s, s_air_d and composite = 1 - (1 - level_s)(1 - 0.75 air).

    A missing level counts as 0; missing air as 0, also if an asset has none at all.
    """
    out = df.withColumn("level_s", smooth("level", asset, order)).withColumn("s_air_d", F.coalesce(dilate(F.coalesce("s_air", F.lit(0.0)), asset, order), F.lit(0.0)))
    return out.withColumn("composite", 1 - (1 - F.coalesce("level_s", F.lit(0.0))) * (1 - AIR_GAIN * F.col("s_air_d")))


def parse_weights(text: str) -> dict[str, float]:
    """Weights from "rough=0.8,turn=0.2"; those not named are 0, a name that isn't a feature is an error."""
    out = dict.fromkeys(WEIGHTS, 0.0)
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, value = part.partition("=")
        if name not in out:
            raise ValueError(f"{name!r} is none of {', '.join(WEIGHTS)}")
        out[name] = float(value)
    return out


def same_weights(a: dict[str, float], b: dict[str, float], tolerance: float = 1e-6) -> bool:
    """Whether two sets of weights are in the same proportions."""
    x, y = sum(a.values()), sum(b.values())
    if x <= 0 or y <= 0:
        return x == y
    return all(abs(a.get(k, 0.0) / x - b.get(k, 0.0) / y) <= tolerance for k in {*a, *b})
