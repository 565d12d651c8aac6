"""Exact top-k search by inner product in M-trees, best node first.

Vectors get one more coordinate, sqrt(m**2 - |x|**2) with m the greatest norm, and queries a zero: then nearness in the
metric is the order of inner products. Equal vectors are one point, with the few smallest ids that can be answers.
Points are dealt to pivots, the nearest of some that are picked by hash, and a pivot's points, however many, to trees of
bounded size. Nodes of a tree are pages of at most PAGE entries; a routing entry has its object, its covering radius and the
distance to its parent's object, a leaf entry the latter. A search keeps nodes in a heap by the least distance that they can
hold, and skips entries whose stored parent distance already shows, by the triangle inequality, that they are too far,
without computing theirs. Scores are exact integers; bounds leave room for rounding, so ties are not lost.

Each distinct query is first searched in the trees of its own pivot. What it finds there bounds it everywhere: a tree whose
pivot is further away than that bound and the pivot's radius is not searched for it at all, and in the others the search
starts with the bound. Queries are written to files of at most BLOCK rows in the shared folder; a task makes its tree once and
reads block after block. The best of all trees' answers are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.common import drop_table, materialize

PAGE = 256
TREE_ROWS = 16_384
BLOCK = 4_096
#: The driver holds so many vectors at most.
PIVOTS = 1_024
_EXACT = 1 << 62  # inner products that may exceed this are made of Python's integers


class Node:
    """A page: routing entries with children, or leaf entries with rows."""

    __slots__ = ("children", "parent", "points", "radii", "rows")

    def __init__(self, points, parent, rows=None, radii=None, children=None):
        self.points, self.parent, self.rows, self.radii, self.children = points, parent, rows, radii, children


class MTree:
    """A tree of distinct vectors; members[i] are the (id, place) that vector i stands for, in order. most is the square of the greatest norm, here or beyond."""

    def __init__(self, members: list[list[tuple[int, int]]], vectors: np.ndarray, most: float = 0.0):
        self.members, self.vectors, self.objects = members, vectors, None
        own = vectors.astype(np.float64)
        self.largest = max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0
        norms = (own**2).sum(axis=1)
        self.most = max(most, float(norms.max()) if len(norms) else 0.0)
        self.points = np.c_[own, np.sqrt(np.maximum(self.most - norms, 0))]
        self.computed = self.skipped = 0
        self.root = self._build(np.arange(len(vectors)), None)

    def _to(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> Node:
        if len(rows) <= PAGE:
            return Node(self.points[rows], self._to(rows, parent) if parent is not None else np.zeros(len(rows)), rows=rows)
        # routing objects: spread over the rows, each next one far from those before
        fan = min(PAGE, -(-len(rows) // PAGE) * 2)
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 8 * fan)).astype(np.int64)]
        picked, gap = [some[0]], self._to(some, self.points[some[0]])
        while len(picked) < fan and gap.max() > 0:
            picked.append(some[int(gap.argmax())])
            gap = np.minimum(gap, self._to(some, self.points[picked[-1]]))
        if len(picked) == 1:  # copies of one point: any split will do
            parts = np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))
            picked = [p[0] for p in parts]
        else:
            center = self.points[picked]
            near = np.empty(len(rows), dtype=np.int64)
            for i in range(0, len(rows), 4096):
                x = self.points[rows[i : i + 4096]]
                near[i : i + 4096] = ((center**2).sum(axis=1)[None] - 2 * x @ center.T).argmin(axis=1)
            parts = [rows[near == i] for i in range(len(picked))]
        points, children, radii = [], [], []
        for pick, part in zip(picked, parts, strict=True):
            if len(part):
                if len(part) == len(rows):
                    return self._halves(rows, parent)
                points.append(self.points[pick])
                radii.append(float(self._to(part, self.points[pick]).max()))
                children.append(self._build(part, self.points[pick]))
        points = np.array(points)
        to_parent = np.sqrt(((points - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(len(points))
        return Node(points, to_parent, radii=np.array(radii), children=children)

    def _halves(self, rows: np.ndarray, parent: np.ndarray | None) -> Node:
        points, radii, children = [], [], []
        for part in np.array_split(rows, 2):
            points.append(self.points[part[0]])
            radii.append(float(self._to(part, points[-1]).max()))
            children.append(self._build(part, points[-1]))
        points = np.array(points)
        to_parent = np.sqrt(((points - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(2)
        return Node(points, to_parent, radii=np.array(radii), children=children)

    def search(self, query: np.ndarray, k: int, bound: int | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, id, place); ties to smaller ids and places. Scores below the bound need not be found."""
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -place): the worst first
        point = np.r_[query.astype(np.float64), 0.0]
        base = float((point**2).sum()) + self.most
        slack = 1e-6 * (1 + np.sqrt(base))
        reach = lambda score: float(np.sqrt(max(0.0, base - 2 * score))) + slack
        limit = np.inf if bound is None else reach(bound)
        wide = self.largest * max(map(abs, query.tolist()), default=0) * len(query) >= _EXACT
        if wide and self.objects is None:
            self.objects = self.vectors.astype(object)
        vectors, exact = (self.objects, query.astype(object)) if wide else (self.vectors, query)
        heap, n = [(0.0, 0, self.root, None)], 1
        while heap:
            least, _, node, gap = heapq.heappop(heap)
            if least > limit:
                break
            at, points = None, node.points
            if gap is not None and limit < np.inf:
                kept = np.abs(gap - node.parent) - (node.radii if node.children else 0) <= limit
                n_kept = int(np.count_nonzero(kept))
                if 4 * n_kept <= 3 * len(kept):  # picking out most of a page costs more than its distances
                    at = np.flatnonzero(kept)
                    points = points[at]
            self.computed += len(points)
            if not len(points):
                continue
            along = points @ point  # points are all as long, so this tells the distances
            if node.children:
                far = np.sqrt(np.maximum(base - 2 * along, 0.0))
                for i, d in zip(range(len(points)) if at is None else at.tolist(), far.tolist(), strict=True):
                    if (low := max(0.0, d - node.radii[i])) <= limit:
                        heapq.heappush(heap, (low, n, node.children[i], d))
                        n += 1
                continue
            rows = node.rows if at is None else node.rows[at]
            floor = best[0][0] if len(best) == k else bound
            if floor is not None:
                rows = rows[along >= float(floor) - 1e-9 * (1 + base)]
                if not len(rows):
                    continue
            scores = vectors[rows] @ exact
            if floor is not None:
                rows, scores = rows[scores >= floor], scores[scores >= floor]
            for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
                for own, place in self.members[row]:
                    if len(best) < k:
                        heapq.heappush(best, (score, -own, -place))
                    elif (score, -own, -place) > best[0]:
                        heapq.heapreplace(best, (score, -own, -place))
                    else:
                        break  # the next ones of this vector are no better
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        return [(s, -i, -p) for s, i, p in sorted(best, reverse=True)]


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as an array of longs; null if a component is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(~F.exists(vector, bad), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _read(path: str) -> pa.Table:
    system, at = fs.FileSystem.from_uri(path)
    return pq.read_table(at, filesystem=system)


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    own = vectors.astype(np.float64)
    return np.c_[own, np.sqrt(np.maximum(most - (own**2).sum(axis=1), 0))]


def _gaps(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all points to all others, at most a million at a time."""
    out, step = np.empty((len(points), len(others))), max(1, (1 << 20) // max(1, len(others)))
    for i in range(0, len(points), step):
        part = points[i : i + step]
        out[i : i + step] = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] + (others**2).sum(axis=1) - 2 * part @ others.T, 0))
    return out


#: Pivots by the length of their vectors: numbers, and points.
Pivots = dict[int, tuple[list[int], np.ndarray]]


def _placed(classes: DataFrame, pivots: Pivots, most: float) -> DataFrame:
    """classes(cid, v, ...) with pivot and gap, the nearest pivot to each vector as a point, and to each as a query: home. -1 without one."""
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sizes = np.diff(ends)
            pivot, home, gap = np.full(len(sizes), -1, np.int32), np.full(len(sizes), -1, np.int32), np.full(len(sizes), np.inf)
            for dim in np.unique(sizes).tolist():
                if dim in pivots:
                    at = np.flatnonzero(sizes == dim)
                    numbers, points = pivots[dim]
                    own = flat[ends[at][:, None] + np.arange(dim)]
                    far = _gaps(_lifted(own, most), points)
                    near = far.argmin(axis=1)
                    pivot[at], gap[at] = np.array(numbers)[near], far[np.arange(len(at)), near]
                    home[at] = np.array(numbers)[_gaps(np.c_[own.astype(np.float64), np.zeros(len(at))], points).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(home), pa.array(gap)], names=[*batch.schema.names, "pivot", "home", "gap"])

    return classes.mapInArrow(place, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", pivot int, home int, gap double")


def _answers(paths: list[str], k: int, most: float, points: dict[int, np.ndarray], radii: dict[int, float], at_home: bool):
    """The function that makes a group's tree and searches it for the queries at home there, or for all others that it may hold something for. A score is high * 2**63 + low."""

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        pivot, dim = key[0], key[1]
        tree, found = None, []
        for path in paths:
            own = _read(path)
            homes, sizes = own.column("home").to_numpy(), pc.list_value_length(own.column("v")).to_numpy()
            mine = (sizes == dim) & ((homes == pivot) if at_home else (homes != pivot))
            if not mine.any():
                continue
            own = own.filter(pa.array(mine))
            queries = own.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            bounds = [None] * len(queries)
            if not at_home:
                bounds = [None if h is None else (h << 63) + low for h, low in zip(own.column("high").to_pylist(), own.column("low").to_pylist(), strict=True)]
            near = np.ones(len(queries), dtype=bool)
            if not at_home and pivot in points:
                squares = (queries.astype(np.float64) ** 2).sum(axis=1)
                least = _gaps(np.c_[queries.astype(np.float64), np.zeros(len(queries))], points[pivot][None])[:, 0] - radii[pivot]
                reach = np.array([np.inf if s is None else np.sqrt(max(0.0, q + most - 2 * float(s))) for s, q in zip(bounds, squares.tolist(), strict=True)])
                near = least <= reach + 1e-5 * (1 + np.sqrt(squares + most))
            for i in np.flatnonzero(near).tolist():
                if tree is None:
                    members = [[(int(m["vec_id"]), int(m["place"])) for m in x] for x in group["members"]]
                    tree = MTree(members, np.stack(group["v"].tolist()) if dim else np.zeros((len(group), 0), np.int64), most)
                found += [(own.column("cid")[i].as_py(), other, place, *divmod(score, 1 << 63)) for score, other, place in tree.search(queries[i], k, bounds[i])]
        out = pd.DataFrame(found, columns=["cid", "vec_id", "place", "high", "low"])
        return out.assign(high=[max(-(1 << 63), min((1 << 63) - 1, x)) for x in out["high"]]).astype("int64")

    return answer


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("cid").orderBy(F.desc("high"), F.desc("low"), "vec_id", "place")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def top_k(rows: DataFrame, k: int = 5, scale: int = 256, every: int = 50, tree_rows: int = TREE_ROWS, most_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows(vec_id, embedding) whose vec_id is divisible by every.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Every other row is a
    candidate for every row but itself: repeated ones count each, and a repeated query has its ranks for each row. Only
    vectors of a query's length are its candidates. Fewer than k candidates give fewer rows, an empty table none.
    Components beyond a long after scaling are the nearest long; a score beyond one is given as the nearest long, but
    takes its place by its exact value (up to 126 bits). Other columns are ignored.
    """
    own = rows.select("vec_id", quantized(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    own = materialize(own.withColumn("place", F.monotonically_increasing_id()), "vectors")
    # of equal vectors only the k + 1 smallest ids can be answers: one of them may be the query's own
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "place"))
    members = own.withColumn("__n", nth).where(F.col("__n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "place"))).alias("members"))
    classes = materialize(members.select(F.get("members", F.lit(0))["place"].alias("cid"), "v", "members"), "classes")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, most = classes.agg(F.count("*"), F.max(square)).first()
    most = float(most or 0.0) * (1 + 1e-9)
    picked = classes.select("v", F.xxhash64("cid").alias("__h")).orderBy("__h").limit(max(1, min(most_pivots, -(-n // tree_rows)))).collect()
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(picked):
        by_dim.setdefault(len(r["v"]), []).append(i)
    pivots = {dim: (at, _lifted(np.array([picked[i]["v"] for i in at], dtype=np.int64).reshape(len(at), dim), most)) for dim, at in by_dim.items()}
    points = {i: p for at, own_points in pivots.values() for i, p in zip(at, own_points, strict=True)}
    placed = materialize(_placed(classes, pivots, most), "placed")
    sizes = {r["pivot"]: (r["n"], r["gap"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()}  # a row a pivot
    radii = {p: g * (1 + 1e-9) for p, (_, g) in sizes.items()}
    parts = F.create_map(*[F.lit(x) for p, (m, _) in sizes.items() for x in (p, -(-m // tree_rows))]) if sizes else F.create_map(F.lit(-1), F.lit(1))
    dealt = placed.withColumn("dim", F.size("v")).withColumn("tree", F.pmod(F.xxhash64("cid"), parts[F.col("pivot")]).cast("int"))
    asked = own.where(F.col("vec_id") % every == 0)
    asked = materialize(asked.join(classes.select("cid", "v"), "v").select("cid", F.col("vec_id").alias("query_id"), "place"), "asked")
    queries = placed.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v", "home")
    files = materialize(queries, "queries", file_rows=BLOCK)
    schema = "cid long, vec_id long, place long, high long, low long"
    trees = dealt.select("pivot", "dim", "tree", "v", "members").groupBy("pivot", "dim", "tree")
    search = lambda paths, at_home: trees.applyInPandas(_answers(sorted(paths), k + 1, most, points, radii, at_home), schema)
    first = materialize(_best(search(files.inputFiles(), True), k + 1), "home")  # names only: the tasks read the files
    bounds = first.where(F.col("nth") == k + 1).select("cid", "high", "low")
    bounded = materialize(files.join(bounds, "cid", "left"), "bounded", file_rows=BLOCK)
    rest = search(bounded.inputFiles(), False)
    best = materialize(_best(first.select(*[c.split()[0] for c in schema.split(", ")]).unionByName(rest), k + 1), "best")
    both = asked.withColumnRenamed("place", "__own").join(best, "cid").where(F.col("place") != F.col("__own"))
    ranks = both.withColumn("rank", F.row_number().over(W.partitionBy("__own").orderBy("nth"))).where(F.col("rank") <= k)
    for done in (own, classes, placed, files, first, bounded):
        drop_table(done)
    least, greatest = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    score = F.when(F.col("high") == 0, F.col("low")).when(F.col("high") == -1, F.col("low") + least).when(F.col("high") > 0, greatest).otherwise(least)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
