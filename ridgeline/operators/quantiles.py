"""Exact percentiles by counting: many ranks of many groups, selected by refined counts.

A round deals the values that are still in question into buckets, counts each bucket and notes its least and greatest
value and a bounded sketch of it. A bucket whose values are equal answers all ranks in it; of the others only those that
hold a wanted rank are refined, with cuts from their sketches. Sketches choose cuts and never answers, so results are exact.
When few values are left they are counted one by one. No value is exchanged before that, no buffer grows with the rows,
and the driver holds a few numbers a bucket, of which there are at most CUTS a group or FINER for each wanted rank.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.session import saved

#: Buckets of a group in the first round, and of each bucket that is refined later.
CUTS, FINER = 2_048, 32
#: So many values left are counted one by one.
FEW = 1 << 20
_SKETCH = 10_000


def _bucket(cuts: Column, steps: Column) -> Column:
    """How many of the ascending cuts are below the value: a binary search as a fold."""
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) < F.col("value")), at + s).otherwise(at))


def _probes(n: int) -> Column:
    return F.array(*[F.lit((i + 1) / (n + 1)) for i in range(n)])


@dataclass
class Span:
    """Values from least to most, of which the first has a known rank; inner are cuts within."""

    least: float
    most: float
    first: int
    n: int
    inner: list[float]

    def edges(self, finer: bool) -> list[float]:
        """The upper ends of the buckets that it is cut into."""
        return [*sorted({c for c in self.inner if self.least <= c < self.most}), self.most] if finer else [self.most]


def _laid(spans: dict[str, list[Span]], finer: bool) -> tuple[dict[str, list[float]], dict[str, dict[int, Span]]]:
    """Ascending cuts of each group, and the span that each bucket (cut before, cut] of interest belongs to."""
    cuts: dict[str, list[float]] = {}
    owners: dict[str, dict[int, Span]] = {}
    for g, own in spans.items():
        cuts[g] = sorted({x for s in own for x in (math.nextafter(s.least, -math.inf), *s.edges(finer))})
        place = {c: i for i, c in enumerate(cuts[g])}
        owners[g] = {place[c]: s for s in own for c in s.edges(finer)}
    return cuts, owners


def _dealt(rows: DataFrame, cuts: dict[str, list[float]], owners: dict[str, dict[int, Span]]) -> DataFrame:
    """(g, value, b) of rows(g, value) in the buckets of interest. A row a group is broadcast."""
    table = rows.sparkSession.createDataFrame([(g, c, sorted(owners[g])) for g, c in cuts.items()], "g string, __cuts array<double>, __own array<int>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(map(len, cuts.values())).bit_length()))])
    found = rows.join(F.broadcast(table), "g").withColumn("b", _bucket(F.col("__cuts"), steps))
    return found.where(F.array_contains("__own", F.col("b"))).select("g", "value", "b")


def order_statistics(rows: DataFrame, wanted: dict[str, list[int]], few: int = FEW, cuts: int = CUTS, finer: int = FINER) -> dict[str, dict[int, float]]:
    """{group: {rank: value}} of the wanted ranks, from 0, of rows(g, value), whose values are numbers."""
    told = lambda n: [F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", _probes(n), _SKETCH).alias("inner")]
    out: dict[str, dict[int, float]] = {g: {} for g in wanted}
    spans: dict[str, list[Span]] = {}

    def settle(g: str, least: float, most: float, first: int, n: int, inner: list[float]) -> None:
        """Answer the ranks of a bucket, or leave it to be refined."""
        at = wanted[g]
        ranks = at[bisect_left(at, first) : bisect_left(at, first + n)]
        if least == most:
            out[g] |= dict.fromkeys(ranks, least)
        elif ranks:
            spans.setdefault(g, []).append(Span(least, most, first, n, inner))

    for r in rows.groupBy("g").agg(*told(cuts)).collect():
        settle(r["g"], r["least"], r["most"], 0, r["n"], r["inner"])
    while sum(s.n for own in spans.values() for s in own) > few:
        edges, owners = _laid(spans, finer=True)
        spans = {}
        at: dict[int, int] = {}
        for r in sorted(_dealt(rows, edges, owners).groupBy("g", "b").agg(*told(finer)).collect(), key=lambda r: (r["g"], r["b"])):
            span = owners[r["g"]][r["b"]]
            first = at.setdefault(id(span), span.first)
            at[id(span)] += r["n"]
            settle(r["g"], r["least"], r["most"], first, r["n"], r["inner"])
    if spans:
        edges, owners = _laid(spans, finer=False)
        ranks = lambda g, s: wanted[g][bisect_left(wanted[g], s.first) : bisect_left(wanted[g], s.first + s.n)]
        starts = rows.sparkSession.createDataFrame([(g, b, s.first, ranks(g, s)) for g, own in owners.items() for b, s in own.items()], "g string, b int, __first long, __ranks array<long>")
        each = _dealt(rows, edges, owners).groupBy("g", "b", "value").agg(F.count("*").alias("n")).join(F.broadcast(starts), ["g", "b"])
        each = each.withColumn("__until", F.col("__first") + F.sum("n").over(W.partitionBy("g", "b").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
        hit = F.filter("__ranks", lambda k: (k >= F.col("__until") - F.col("n")) & (k < F.col("__until")))
        for r in each.select("g", "value", hit.alias("ranks")).where("size(ranks) > 0").collect():
            out[r["g"]] |= dict.fromkeys(r["ranks"], r["value"])
    return out


def percentiles(rows: DataFrame, points: int = 101, few: int = FEW, cuts: int = CUTS, finer: int = FINER) -> DataFrame:
    """(g, n, breaks) of each group of rows(g, value): so many evenly spaced percentiles, interpolated linearly between values.

    Null values don't count; NaN is above all numbers. Jobs run at the call; the groups must be few, as features or classes are.
    """
    rows = saved(rows.select("g", F.col("value").cast("double").alias("value")).where("value is not null"))
    counts = {r["g"]: (r["n"], r["nan"]) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.isnan("value")).alias("nan")).collect()}
    places = {g: [(n - 1) * (i / (points - 1)) for i in range(points)] for g, (n, _) in counts.items()}
    sizes = {g: n - nan for g, (n, nan) in counts.items()}
    wanted = {g: sorted({k for p in own for k in (math.floor(p), math.ceil(p)) if k < sizes[g]}) for g, own in places.items()}
    found = order_statistics(rows.where(~F.isnan("value")), wanted, few, cuts, finer)

    def at(g: str, p: float) -> float:
        low, high = (found[g].get(k, math.nan) for k in (math.floor(p), math.ceil(p)))
        return low if math.floor(p) == math.ceil(p) or low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    table = [(g, counts[g][0], [at(g, p) for p in own]) for g, own in places.items()]
    return rows.sparkSession.createDataFrame(table, "g string, n long, breaks array<double>")
