"""Joins of points and intervals within an asset, and folds over ordered lists."""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _cells(lo: Column, hi: Column, width: float | Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")))


def points_inside(points: DataFrame, spans: DataFrame, asset: str, t: str, start: str, end: str, width: float = 10.0) -> DataFrame:
    """points joined to the spans that hold them strictly inside. Spans name the cells they touch, so the join is by equal keys."""
    cells = spans.withColumn("__cell", _cells(F.col(start), F.col(end), width))
    own = points.withColumn("__cell", F.floor(F.col(t) / width).cast("long"))
    return own.join(cells, [asset, "__cell"]).where((F.col(t) > F.col(start)) & (F.col(t) < F.col(end))).drop("__cell")


def slices(series: DataFrame, clips: DataFrame, asset: str, t: str, key: str, start: str, end: str, pad: float = 0.0, width: float = 30.0) -> DataFrame:
    """series with the key of each clip that holds its time, ends included, with so much around it. A row in two clips is there twice."""
    own = clips.select(asset, key, (F.col(start) - pad).alias("__a"), (F.col(end) + pad).alias("__b"))
    cells = own.withColumn("__cell", _cells(F.col("__a"), F.col("__b"), width))
    placed = series.withColumn("__cell", F.floor(F.col(t) / width).cast("long"))
    return placed.join(cells, [asset, "__cell"]).where(F.col(t).between(F.col("__a"), F.col("__b"))).drop("__cell", "__a", "__b")


def within_any(points: DataFrame, spans: DataFrame, asset: str, t: str, start: str, end: str, width: float = 30.0) -> DataFrame:
    """The points whose time any span holds, ends included, each once."""
    cells = spans.select(asset, F.col(start).alias("__a"), F.col(end).alias("__b"), _cells(F.col(start), F.col(end), width).alias("__cell"))
    placed = points.withColumn("__cell", F.floor(F.col(t) / width).cast("long")).alias("p")
    same = (F.col(f"p.{asset}") == F.col(f"s.{asset}")) & (F.col("p.__cell") == F.col("s.__cell")) & F.col(f"p.{t}").between(F.col("s.__a"), F.col("s.__b"))
    return placed.join(cells.alias("s"), same, "left_semi").drop("__cell")


#: Spans that touch a cell are dealt into blocks of about so many.
BLOCK = 5_000


def overlaps(spans: DataFrame, asset: str, key: str, start: str, end: str, gap: float = 0.0, width: float = 30.0) -> DataFrame:
    """(asset, a, b), a < b, of spans that overlap or are less than the gap apart.

    Less its gap, the later start of a pair lies in the earlier span, so a pair is found once: in the cell of that start, by the block
    of the earlier span. A block is all that a task must hold. The result grows with the square of the spans that meet, which rows
    and bytes of the join's input don't show: its partitions are numbered, so that adaptive execution doesn't merge them."""
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = spans.select(asset, F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"), (F.col(start) - gap).alias("__from"), (F.col(end) + gap).alias("__upto"))
    touching = own.where(F.col("__e") >= F.col("__from")).withColumn("__cell", _cells(F.col("__from"), F.col("__e"), width))
    blocks = touching.groupBy(asset, "__cell").agg(F.ceil(F.count("*") / BLOCK).alias("__blocks")).hint("merge")
    dealt = lambda df, block: df.join(blocks, [asset, "__cell"]).withColumn("__block", block).drop("__blocks").repartition(n, asset, "__cell", "__block")
    later = dealt(own.withColumn("__cell", F.floor(F.col("__from") / width)), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).alias("l")
    holding = dealt(touching, F.pmod(F.xxhash64("__k"), F.col("__blocks"))).alias("h")

    l, h = (lambda c: F.col(f"l.__{c}")), (lambda c: F.col(f"h.__{c}"))  # noqa: E731, E741
    lesser = l("k") < h("k")
    after = (l("from") > h("from")) | ((l("from") == h("from")) & ~lesser)
    meet = F.when(lesser, (l("s") < h("upto")) & (h("from") < l("e"))).otherwise((h("s") < l("upto")) & (l("from") < h("e")))
    same = [F.col(f"l.{c}") == F.col(f"h.{c}") for c in (asset, "__cell", "__block")]
    return later.join(holding.hint("merge"), [*same, l("k") != h("k"), after, meet]).select(F.col(f"l.{asset}").alias(asset), F.least(l("k"), h("k")).alias("a"), F.greatest(l("k"), h("k")).alias("b"))


#: How often spatial_nearest takes a quarter of the radius at most.
QUARTERINGS = 2


def spatial_nearest(points: DataFrame, targets: DataFrame, key: str, radius: float) -> DataFrame:
    """points(key, x, y) with the nearest target(target, x, y) within the radius, the least target of equally near ones.

    A point's reach is the radius, or a quarter or a sixteenth of it if one target of the point's own square is that near. Targets are
    in tiles of every reach and a point names those that its own reach touches, so dense places make few pairs. The joins are merged by
    hint: Spark doesn't see that rows multiply, and would broadcast them all."""
    n, reach = F.col("__n"), radius / F.pow(F.lit(4.0), F.col("__n"))
    reaches = lambda least: F.explode(F.sequence(F.lit(least), F.lit(QUARTERINGS))).alias("__n")
    cells = lambda x, y, width: {"__cx": F.floor(F.col(x) / width), "__cy": F.floor(F.col(y) / width)}
    far = F.sqrt((F.col("x") - F.col("__tx")) ** 2 + (F.col("y") - F.col("__ty")) ** 2)
    spots = targets.groupBy(F.col("x").alias("__tx"), F.col("y").alias("__ty")).agg(F.min("target").alias("target"))

    side = reach * 0.7  # its diagonal is within reach
    some = spots.select("__tx", "__ty", reaches(1)).withColumns(cells("__tx", "__ty", side)).groupBy("__n", "__cx", "__cy").agg(F.first("__tx").alias("__tx"), F.first("__ty").alias("__ty"))
    squares = points.select(key, "x", "y", reaches(1)).withColumns(cells("x", "y", side)).join(some.hint("merge"), ["__n", "__cx", "__cy"], "left")
    own = squares.groupBy(key, "x", "y").agg(F.coalesce(F.max(F.when(far <= reach, n)), F.lit(0)).alias("__n"))

    tiles = spots.select("target", "__tx", "__ty", reaches(0)).withColumns(cells("__tx", "__ty", 2 * reach))
    more = reach * (1 + 1e-9)  # a distance may have been rounded down to the reach
    touched = own.withColumn("__cx", _cells(F.col("x") - more, F.col("x") + more, 2 * reach)).withColumn("__cy", _cells(F.col("y") - more, F.col("y") + more, 2 * reach))
    pairs = touched.join(tiles.hint("merge"), ["__n", "__cx", "__cy"]).withColumn("distance", far).where(F.col("distance") <= reach)
    return pairs.groupBy(key).agg(F.min_by("target", F.struct("distance", "target")).alias("target"), F.min("distance").alias("distance"))


def budget_split(df: DataFrame, group: str, order: list[str], size: str, budget: float) -> DataFrame:
    """(group, *order, size, part) with part 1, 2, ...: consecutive rows of a group as long as their sizes fit the budget; a
    larger one stands alone. One pass over each group in order."""
    own = df.select(group, *order, size)

    def deal(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, na_position="first")
        parts, part, used = [], 0, 0.0
        for x in g[size].astype(float):
            fits = part and not used + x > budget
            part, used = (part, used + x) if fits else (part + 1, x)
            parts.append(part)
        return g.assign(part=np.array(parts, dtype=np.int32))

    return own.groupBy(group).applyInPandas(deal, StructType([*own.schema.fields, StructField("part", IntegerType())]))


def suppress(df: DataFrame, group: str, order: list[Column], start: str, end: str, gap: float, most: int | None = None, digits: int | None = None) -> DataFrame:
    """The rows of df kept greedily in the given order of each group: a row goes if a kept one is less than the gap away, or if
    most rows are kept. With digits, kept edges count as rounded to so many.

    Kept rows are apart, so in the order of their starts only the neighbours of a new one need be looked at."""
    names, columns = [f"__o{i}" for i in range(len(order))], df.columns
    keyed = df.select("*", *[c.alias(n) for n, c in zip(names, order, strict=True)])

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(names)
        starts, ends, kept = [], [], []
        for a, b in zip(g[start].astype(float), g[end].astype(float), strict=True):
            i = bisect(starts, a)
            free = (not i or a >= ends[i - 1] + gap) and (i == len(starts) or starts[i] - gap >= b) and (most is None or len(starts) < most)
            kept.append(free)
            if free:
                starts.insert(i, a if digits is None else round(a, digits))
                ends.insert(i, b if digits is None else round(b, digits))
        return g.loc[np.array(kept, dtype=bool), columns]

    return keyed.groupBy(group).applyInPandas(choose, df.schema)


def diversify(df: DataFrame, group: str, kind: str, score: str, key: str, factor: float = 0.75, most: int = 6) -> DataFrame:
    """df with adjusted and rank: each further row of a kind counts less; the best by adjusted score stay."""
    nth = F.row_number().over(W.partitionBy(group, kind).orderBy(F.desc(score), key)) - 1
    out = df.withColumn("adjusted", F.col(score) * F.pow(F.lit(factor), nth))
    return out.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("adjusted"), key))).where(F.col("rank") <= most)
