"""Clips worth watching, from a score a second: peaks grow into stretches, and one clip survives each neighbourhood.

All steps but two are joins and windows over rows. A stretch ends at the nearest second that is below a share of its peak,
which is looked up in a pyramid of minima; means over seconds come from running sums joined at both ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators import intervals, series
from ridgeline.session import saved

#: What a clip may be about, and the column that tells how much it is.
KINDS = {"speed": "s_speed", "turn": "s_turn", "rough": "s_rough", "jump": "s_air_d"}

#: Parts of a block of minima.
FAN = 64


@dataclass(frozen=True)
class Rules:
    shortest: float = 10.0
    longest: int = 30
    lead: float = 1.5
    apart: float = 9.0
    keep: float = 0.55  # share of the peak that a stretch holds
    prominence: float = 0.30  # share of p95 - median
    score: float = 0.55
    repeat: float = 0.75  # factor for each better clip of the same kind
    tail: float = 4.0
    most: int = 6


def seconds_of(scores: DataFrame, asset: str) -> DataFrame:
    """(asset, i, y, *kinds): the scores numbered from 0 in time order; a score that is no number is 0, and no part of a kind."""
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))  # noqa: E731 (NaN is above infinity)
    at = (F.row_number().over(W.partitionBy(asset).orderBy("t")) - 1).cast("int")
    own = [finite(c).alias(k) if c in scores.columns else F.lit(None).cast("double").alias(k) for k, c in KINDS.items()]
    return scores.select(asset, at.alias("i"), F.coalesce(finite("composite"), F.lit(0.0)).alias("y"), *own)


def bars(seconds: DataFrame, asset: str, rules: Rules) -> DataFrame:
    """(asset, n, floor, bar): what a peak and a clip's mean must reach, of assets that have any score."""
    p = lambda q: F.percentile("y", F.lit(q))
    out = seconds.groupBy(asset).agg(F.count("*").cast("int").alias("n"), p(0.5).alias("__m"), p(0.7).alias("__h"), p(0.95).alias("__u"), F.bool_or(F.col("y") != 0).alias("__any"))
    rise = rules.prominence * (F.col("__u") - F.col("__m"))
    return out.where("__any").select(asset, "n", F.greatest(F.col("__h"), F.col("__m") + rise).alias("floor"), F.greatest(F.lit(rules.score), F.col("__m") + rise / 2).alias("bar"))


def pyramid(seconds: DataFrame, asset: str, most: int) -> list[DataFrame]:
    """Minima over blocks of FAN seconds, over FAN of those, and so on: (asset, block, mins), the minima of a block's parts in order."""
    own, out = seconds.select(asset, F.col("i").alias("__i"), "y"), []
    while True:
        laid = own.groupBy(asset, F.expr(f"__i div {FAN}").cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("__i", "y"))).alias("__parts"))
        level = saved(laid.select(asset, "block", F.transform("__parts", lambda p: p["y"]).alias("mins")))
        out.append(level)
        if most < FAN:
            return out
        own, most = level.select(asset, F.col("block").alias("__i"), F.array_min("mins").alias("y")), most // FAN


def stretches(peaks: DataFrame, seconds: DataFrame, asset: str, rules: Rules) -> DataFrame:
    """peaks(asset, i, y, ...) with first and last: the seconds around i that stay at or above the share of y.

    The nearest lower second to either side is looked up in a pyramid of minima: in the peak's own block, else in the
    narrowest block around it that has a lower part on that side, and from there down. A peak carries FAN minima a level.
    """
    size = seconds.groupBy(asset).agg(F.count("*").cast("int").alias("__size"))
    levels = pyramid(seconds, asset, (seconds.agg(F.max("i")).first()[0] or 0))
    low = F.col("y") * F.lit(rules.keep)
    found = peaks
    for k, level in enumerate(levels):
        found = found.withColumn("block", F.expr(f"i div {FAN ** (k + 1)}").cast("int")).join(level.withColumnRenamed("mins", f"__m{k}"), [asset, "block"], "left").drop("block")
    left, right = F.lit(None), F.lit(None)
    for k in reversed(range(len(levels))):  # the narrowest level that has one comes first
        at = F.expr(f"i div {FAN ** k} % {FAN}").cast("int")
        parts = F.transform(F.col(f"__m{k}"), lambda v, j: F.when(v < low, j))
        before = F.array_max(F.filter(parts, lambda j: j < at))  # noqa: B023 (used in this round)
        after = F.array_min(F.filter(parts, lambda j: j > at))  # noqa: B023
        base = F.expr(f"i div {FAN ** (k + 1)} * {FAN}").cast("int")
        hit = lambda j: F.struct(F.lit(k).alias("level"), (base + j).alias("block"))  # noqa: B023, E731
        left, right = F.when(before.isNotNull(), hit(before)).otherwise(left), F.when(after.isNotNull(), hit(after)).otherwise(right)
    none = "struct<level:int,block:int>"
    found = found.withColumn("__left", left.cast(none)).withColumn("__right", right.cast(none)).drop(*[f"__m{k}" for k in range(len(levels))])
    for k in reversed(range(len(levels) - 1)):  # down: the last or the first lower part of the block that was found
        for side, pick in (("__left", F.array_max), ("__right", F.array_min)):
            down = found[side]["level"] == k + 1
            own = levels[k].select(asset, F.col("block").alias("__at"), F.col("mins").alias("__mins"))
            found = found.withColumn("__at", F.when(down, F.col(side)["block"])).join(own, [asset, "__at"], "left")
            part = pick(F.filter(F.transform("__mins", lambda v, j: F.when(v < low, j)), lambda j: j.isNotNull()))
            lower = F.struct(F.lit(k).alias("level"), (F.col("__at") * FAN + part).alias("block"))
            found = found.withColumn(side, F.when(F.col("__at").isNotNull(), lower).otherwise(F.col(side))).drop("__at", "__mins")
    found = found.join(size, asset)
    return found.withColumn("first", F.coalesce(F.col("__left")["block"] + 1, F.lit(0))).withColumn("last", F.coalesce(F.col("__right")["block"], F.col("__size")) - 1).drop("__left", "__right", "__size")


def with_mean(df: DataFrame, seconds: DataFrame, asset: str, first: str, end: str, name: str) -> DataFrame:
    """df with the mean of y over the seconds [first, end): a running sum, joined at both ends."""
    so_far = F.sum("y").over(W.partitionBy(asset).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    sums = seconds.select(asset, (F.col("i") + 1).alias("__i"), so_far.alias("__s"))
    for c in (first, end):
        own = sums.select(asset, F.col("__i").alias(c), F.col("__s").alias(f"__{c}"))
        df = df.join(own, [asset, c], "left").withColumn(f"__{c}", F.coalesce(f"__{c}", F.lit(0.0)))
    return df.withColumn(name, (F.col(f"__{end}") - F.col(f"__{first}")) / (F.col(end) - F.col(first))).drop(f"__{first}", f"__{end}")


def narrowed(spans: DataFrame, seconds: DataFrame, asset: str, rules: Rules) -> DataFrame:
    """spans(asset, i, n, first, last) of which none is longer than a clip may be. Of a longer one stays the window with the
    best mean that holds the peak and a tail behind it; of those within 1 % the one with the peak nearest to the lead."""
    width, i = rules.longest, F.col("i")
    wide = spans.where(F.col("last") + 1 - F.col("first") > width)
    least, most = F.greatest(F.col("first"), i - width + int(rules.tail)), F.least(i, F.col("last") - width + 1)
    only = F.greatest(F.col("first"), most)
    starts = F.when(most < least, F.array(only)).otherwise(F.sequence(least, F.greatest(least, most)))
    tried = wide.select(asset, "i", "n", F.explode(starts).alias("s")).withColumn("e", F.least(F.col("s") + width, F.col("n")))
    means = with_mean(tried, seconds, asset, "s", "e", "mean").withColumn("__best", F.max("mean").over(W.partitionBy(asset, "i")))
    close = means.where(F.col("mean") >= F.col("__best") - 0.01 * F.abs("__best"))
    chosen = close.groupBy(asset, "i").agg(F.min(F.struct(F.abs(i - F.col("s") - rules.lead).alias("off"), "s"))["s"].alias("__s"))
    out = spans.join(chosen, [asset, "i"], "left")
    return out.withColumn("first", F.coalesce("__s", "first")).withColumn("last", F.coalesce(F.col("__s") + width - 1, F.col("last"))).drop("__s")


def edges(rules: Rules) -> tuple[Column, Column]:
    """t_in and t_out of a row with i, n, first and last: lead-in, least length, tail, greatest length, in that order."""
    start, stop = F.col("first") - F.lit(rules.lead), F.col("last") + F.lit(1.0)
    short = F.greatest(F.lit(0.0), rules.shortest - (stop - start)) / 2
    grown = stop + short
    ended = F.when(grown - F.col("i") < rules.tail, F.least(F.col("n").cast("double"), F.col("i") + F.lit(rules.tail))).otherwise(grown)
    begun = F.greatest(start - short, ended - float(rules.longest), F.lit(0.0))
    return begun, F.least(F.col("n").cast("double"), ended)


def out_of_events(t_in: Column, t_out: Column, events: Column, passes: int = 8, step: float = 0.5) -> Column:
    """struct(a, b): the edges moved out of the events that hold them, in as many passes over events(t_start, t_end) as that takes, eight at most."""
    start = F.struct(t_in.cast("double").alias("a"), t_out.cast("double").alias("b"))

    def leave(s: Column, e: Column) -> Column:
        inside = lambda x: (e["t_start"] < x) & (x < e["t_end"])
        return F.struct(F.when(inside(s["a"]), e["t_start"] - step).otherwise(s["a"]).alias("a"), F.when(inside(s["b"]), e["t_end"] + step).otherwise(s["b"]).alias("b"))

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, lambda s, _: F.aggregate(events, s, leave))
    return F.when(F.size(events) > 0, moved).otherwise(start)


def with_kind(clips: DataFrame, seconds: DataFrame, asset: str) -> DataFrame:
    """clips(asset, i, a, e) with features, the greatest value of each kind in the seconds [a, e), and dominant, the kind of
    the greatest of those, the first of equal ones."""
    inside = clips.select(asset, F.col("i").alias("__peak"), F.explode(F.sequence("a", F.col("e") - 1)).alias("i"))
    most = inside.join(seconds.drop("y"), [asset, "i"]).groupBy(asset, F.col("__peak").alias("i")).agg(*[F.max(k).alias(k) for k in KINDS])
    best, dominant = F.greatest(*KINDS), F.lit("unknown")
    for k in reversed(KINDS):
        dominant = F.when(F.col(k) == best, k).otherwise(dominant)
    features = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.col(k))])
    return clips.join(most.select(asset, "i", features.alias("features"), dominant.alias("dominant")), [asset, "i"])


def clip_candidates(scores: DataFrame, events: DataFrame | None = None, asset: str = "content_hash", rules: Rules = Rules()) -> DataFrame:
    """(asset, rank, t_in, t_out, peak_t, peak, score, adjusted, dominant, features) of every asset, best first, from
    scores(asset, t, composite, s_*), a row a second, and events(asset, t_start, t_end) that no clip may start or end in."""
    seconds = saved(seconds_of(scores, asset))  # read by every step
    limits = bars(seconds, asset, rules)
    tops = series.peaks(seconds.select(asset, "i", "y").join(limits, asset), asset, "i", "y", F.col("floor"))
    spans = narrowed(saved(stretches(tops, seconds, asset, rules)), seconds, asset, rules)
    t_in, t_out = edges(rules)
    spans = spans.withColumn("t_in", t_in).withColumn("t_out", t_out)
    if events is not None:
        lists = events.groupBy(asset).agg(F.sort_array(F.collect_list(F.struct(F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end")))).alias("__events"))
        none = F.array().cast("array<struct<t_start:double,t_end:double>>")
        moved = out_of_events(F.col("t_in"), F.col("t_out"), F.coalesce("__events", none))
        spans = spans.join(lists, asset, "left").withColumn("__m", moved).withColumn("t_in", F.greatest(F.lit(0.0), "__m.a")).withColumn("t_out", F.col("__m.b")).drop("__m", "__events")
    spans = spans.where(F.col("t_out") - F.col("t_in") >= 0.8 * rules.shortest).withColumn("a", F.floor("t_in").cast("int"))
    spans = spans.withColumn("e", F.greatest(F.least(F.col("n"), F.ceil("t_out").cast("int")), F.col("a") + 1))
    clear = with_mean(spans, seconds, asset, "a", "e", "score").where(F.col("score") >= F.col("bar") - 1e-9)  # running sums round
    # of equal peaks the inner ones are first, then the one at the start
    place = F.when(F.col("i") == 0, 1).when(F.col("i") == F.col("n") - 1, 2).otherwise(0)
    apart = intervals.suppress(clear.drop("floor", "bar"), asset, [-F.col("y"), place, F.col("i")], "t_in", "t_out", rules.apart, most=3 * rules.most, digits=2)
    chosen = apart.withColumn("t_in", F.round("t_in", 2)).withColumn("t_out", F.round("t_out", 2)).withColumn("__order", F.struct(-F.col("y"), place, "i"))
    ranked = intervals.diversify(with_kind(saved(chosen), seconds, asset), asset, "dominant", "score", "__order", rules.repeat, rules.most)
    return ranked.select(asset, F.col("rank").cast("int").alias("rank"), "t_in", "t_out", F.col("i").cast("double").alias("peak_t"), F.col("y").alias("peak"), "score", "adjusted", "dominant", "features")
