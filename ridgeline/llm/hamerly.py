"""Centroid clustering with Hamerly's bounds, exact in integers.

Vectors become integers, floor(scale * x). The start centroids are the k rows whose id hashes least. A round
assigns every row to its nearest centroid (squared Euclidean distance, ties to the smaller number) and makes
each non-empty centroid the componentwise floor of its rows' mean; empty ones stay.

Beside its cluster a row keeps two numbers: an upper bound of the distance to its own centroid and a lower
bound of the distance to the second nearest. When centroids move, the upper bound grows by its centroid's
drift and the lower one shrinks by the largest drift of the others. A row whose upper bound stays below the
lower one, or below half the distance from its centroid to the nearest other, keeps its cluster unseen. Else the upper
bound is made tight by one distance, and only a row that is then still in doubt is compared with all centroids.
Bounds are doubles that are rounded apart, and only a strict gap between them decides: what is skipped is right.

Rows with their bounds are a table in the shared folder, written anew each round. Only the rows that moved
change the sums, and sums are made in each task first; the driver holds k centroids and never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import drop_table, materialize

#: Components below this have differences whose squares and sums of 2**12 of them fit a long.
_NARROW = 1 << 24
_MOST_DIM = 1 << 12
#: Rounding of bounds: far above the error of a double's square root and sum, far below any gap that matters.
_APART = 1e-12
#: Sums are sent as signed digits of so many bits, so that adding 2**22 tasks' digits fits a long.
_DIGIT = 40
_LONG = (1 << 63) - 1


def integers(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles as rows of dim: longs if all are narrow, else Python's integers."""
    flat = flat.astype(np.float64)
    with np.errstate(over="ignore"):
        wide = np.floor(flat * scale)
    if dim <= _MOST_DIM and (not len(flat) or np.abs(wide).max() < _NARROW):
        return wide.astype(np.int64).reshape(-1, dim)
    own = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in flat.tolist()]
    return np.array(own, dtype=object).reshape(-1, dim)


def _narrowed(v: np.ndarray) -> np.ndarray:
    """v as longs if it is narrow, else as Python's integers."""
    if v.shape[-1] <= _MOST_DIM and all(abs(x) < _NARROW for x in v.ravel().tolist()):
        return v.astype(np.int64)
    return v.astype(object)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row. Longs are narrow, so only they stay longs."""
    if rows.dtype != centroids.dtype:
        rows, centroids = rows.astype(object), centroids.astype(object)
    gap = rows - centroids
    return (gap * gap).sum(axis=-1)


def _root(d: np.ndarray, way: int) -> np.ndarray:
    """The square roots of integers as doubles that are surely not below (way 1) or not above (way -1) them."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64)) * (1 + way * _APART)
    roots = [isqrt(x) + (way > 0) for x in d.tolist()]
    return np.array([float(x) * (1 + way * _APART) if x < 10**300 else (np.inf if way > 0 else 1e300) for x in roots])


class Centroids:
    """The centroids, what half the gap to the nearest other is, and how far they moved."""

    def __init__(self, values: list[list[int]], before: Centroids | None = None):
        self.values = _narrowed(np.array(values, dtype=object))
        self.each = [_narrowed(c) for c in self.values]
        k = len(values)
        self.half = np.full(k, np.inf)
        for i in range(k):
            others = np.delete(np.arange(k), i)
            if len(others):
                self.half[i] = 0.5 * _root(squared(self.values[others], self.values[i]), -1).min()
        self.drift = np.zeros(k) if before is None else _root(squared(self.values, before.values), 1)
        order = np.sort(self.drift)[::-1]
        #: the largest drift among the others
        self.most = np.where(np.arange(k) == self.drift.argmax(), order[1] if k > 1 else 0.0, order[0])

    def scan(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, lower bound of the second) of rows, against all centroids."""
        each = [squared(rows, c) for c in self.each]
        d = np.stack(each, axis=1) if all(x.dtype != object for x in each) else np.stack([x.astype(object) for x in each], axis=1)
        near, at = d.argmin(axis=1), np.arange(len(rows))
        best = d[at, near]
        if len(each) == 1:
            return near, best, np.full(len(rows), np.inf)
        d[at, near] = d.max(axis=1)
        return near, best, _root(d.min(axis=1), -1)


def _vectors(lists: pa.Array, scale: int) -> np.ndarray:
    dim = len(lists[0]) if len(lists) else 1
    return integers(lists.flatten().to_numpy(zero_copy_only=False), dim, scale)


def _by_width(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the narrow rows and of the others: few wide ones don't slow the rest down."""
    if v.dtype != object:
        return [(np.arange(len(v)), v)]
    wide = np.array([v.shape[1] > _MOST_DIM or max(map(abs, x)) >= _NARROW for x in v.tolist()])
    return [(np.flatnonzero(~wide), v[~wide].astype(np.int64)), (np.flatnonzero(wide), v[wide])]


def _assigner(centroids: Centroids, scale: int, first: bool):
    """The batch function that brings (cluster, upper, lower) up to date and tells the cluster before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = _vectors(batch.column("v"), scale), batch.num_rows
            if first:
                was, upper, lower = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
                doubt = np.ones(n, dtype=bool)
            else:
                was = batch.column("cluster").to_numpy().astype(np.int64)
                upper = (batch.column("upper").to_numpy() + centroids.drift[was]) * (1 + _APART)
                lower = np.maximum(batch.column("lower").to_numpy() * (1 - _APART) - centroids.most[was] * (1 + _APART), 0.0)
                doubt = ~(upper < np.maximum(lower, centroids.half[was]))
            now, scanned = was.copy(), 0
            for places, own in _by_width(v):
                own, at = own[doubt[places]], places[doubt[places]]
                if len(at) and not first:  # one distance each makes the upper bound tight
                    upper[at] = _root(squared(own, centroids.values[was[at]]), 1)
                    still = ~(upper < np.maximum(lower, centroids.half[was]))[at]
                    own, at = own[still], at[still]
                if len(at):
                    scanned += len(at)
                    near, best, second = centroids.scan(own)
                    now[at], upper[at], lower[at] = near, _root(best, 1), second
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(now.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(np.full(n, scanned, dtype=np.int32))],
                names=["vec_id", "v", "cluster", "was", "upper", "lower", "scanned"],
            )

    return assign


def _digits(x: int) -> list[int]:
    out = []
    while x:
        low = abs(x) & ((1 << _DIGIT) - 1)
        out.append(low if x > 0 else -low)
        x = (abs(x) >> _DIGIT) * (1 if x > 0 else -1)
    return out


def _sums(scale: int):
    """The batch function that gives what the rows of a task that moved add to the clusters: (cluster, place, digit, value), place -1 being the count."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            v = _vectors(batch.column("v"), scale)
            for name, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(name).to_numpy()
                for c in np.unique(own[own >= 0]).tolist():
                    at = own == c
                    part = [sign * int(at.sum()), *(sign * int(x) for x in v[at].sum(axis=0))]
                    total[c] = [a + b for a, b in zip(total[c], part, strict=True)] if c in total else part
        rows = [(c, p - 1, i, d) for c, parts in total.items() for p, x in enumerate(parts) for i, d in enumerate(_digits(x))]
        columns = [np.array(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(columns, ("i4", "i4", "i4", "i8"), strict=True)], names=["cluster", "place", "digit", "value"])

    return summed


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly dim components, none null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, bad), F.lit(False))


def _starts(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k start centroids: the driver gets k rows."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(own.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [integers(np.array(r["v"]), len(r["v"]), scale)[0].tolist() for r in rows]


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, upper, lower, scanned, was) of the usable rows(vec_id, embedding), and the centroids they are assigned to.

    scanned is the number of full scans in the row's batch in the last assignment. v are the components as given.
    """
    v = F.col("embedding")
    kept = rows.select("vec_id", v.alias("v")).where(usable(F.col("v"), dim))
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kind['vec_id']}, v {kind['v']}, cluster int, was int, upper double, lower double, scanned int"
    values = _starts(kept, k, seed, scale)
    if not values:
        return rows.sparkSession.createDataFrame([], schema), []
    centroids, sums = Centroids(values), [[0] * (dim + 1) for _ in values]
    state = None
    for step in range(rounds + 1):
        before = kept if state is None else state.select("vec_id", "v", "cluster", "upper", "lower")
        after = materialize(before.mapInArrow(_assigner(centroids, scale, state is None), schema), "assigned")
        if state is not None:
            drop_table(state)
        state = after
        if step == rounds:
            break
        moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_sums(scale), "cluster int, place int, digit int, value long")
        for r in moved.groupBy("cluster", "place", "digit").agg(F.sum("value").alias("value")).collect():  # k * dim numbers, of a few digits
            sums[r["cluster"]][r["place"] + 1] += r["value"] << (_DIGIT * r["digit"])
        values = [[s // own[0] for s in own[1:]] if own[0] else old for own, old in zip(sums, values, strict=True)]
        centroids = Centroids(values, centroids)
    return state, values


def _distances(values: list[list[int]], scale: int):
    """The batch function that gives the squared distance to the own centroid, as the nearest long."""
    centroids = Centroids(values).values

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = _vectors(batch.column("v"), scale), batch.column("cluster").to_numpy()
            out = np.zeros(len(v), dtype=np.int64)
            for at, rows in _by_width(v):
                if len(at):
                    out[at] = np.minimum(squared(rows, centroids[own[at]]), _LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(out)], names=["vec_id", "cluster", "distance"])

    return measure


def clustered(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row of rows(vec_id, embedding).

    Vectors that are null, have another number of components or hold null or non-finite ones take no part. Repeated
    rows count each by itself; rows that hash alike start in order of their vectors; a null id hashes as "". Fewer
    than k rows give fewer centroids, an empty table no rows. Components of any size are exact; a distance or inertia
    beyond a long is given as the largest long. Other columns are ignored.
    """
    state, values = clusters(rows, k, rounds, dim, scale, seed)
    kind = state.schema["vec_id"].dataType.simpleString()
    if not values:
        return state.select("vec_id", "cluster", *[F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    found = materialize(state.select("vec_id", "v", "cluster").mapInArrow(_distances(values, scale), f"vec_id {kind}, cluster int, distance long"), "distances")
    drop_table(state)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    totals = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # k rows at most
    every = min(sum(totals.values()), _LONG)
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in values]
    named = [(c, min(s, _LONG), every, digest[c]) for c, s in sorted(totals.items())]
    table = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row a cluster, k at most
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
