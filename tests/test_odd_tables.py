"""Registered queries against their DuckDB SQL on small tables with values at the edge of a rule."""

import datetime
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ridgeline import plans
from ridgeline.operators import intervals


def same(spark, d, name, tables):
    """The query's rows, the same as its SQL's to the last digit, sorted."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{d}/{t}.parquet", coerce_timestamps="us")
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(plans.ORACLES[name])
    order = lambda rows: sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)
    got = order(tuple(r) for r in plans.QUERIES[name](spark, str(d)).select(*want.columns).collect())
    assert got == order(want.fetchall())
    return got


def events(rows):
    """An event of (user, value, k) each."""
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    return [{"event_id": i, "ts": at + datetime.timedelta(seconds=i), "user_id": u, "event_type": "view", "value": v, "props": f'{{"k": {k}}}'} for i, (u, v, k) in enumerate(rows)]


@pytest.mark.parametrize("k, value", [(3, 353.0), (3, 137.0), (6, 461.0), (6, 29.0), (9, 569.0)])
def test_a_grade_at_the_limit_of_its_speed_is_kept(spark, tmp_path, k, value):
    assert [r[:2] for r in same(spark, tmp_path, "bound_by_speed", {"events": events([(1, value, k), (1, 600.0, 1)])})] == [(1, 1)]


def test_the_rejected_share_is_rounded_as_in_sql(spark, tmp_path):
    rows = [(1, 600.0, 1)] * 41 + [(1, 245.0, 1)] * 599 + [(2, None, 1)]
    assert [r[3] for r in same(spark, tmp_path, "bound_by_speed", {"events": events(rows)})] == [0.064062, "nan"]


def near(spark, points, targets, radius):
    """spatial_nearest's rows; points and targets are (key, x, y)."""
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, x double, y double")
    return sorted(map(tuple, intervals.spatial_nearest(frame(points, "id"), frame(targets, "target"), "id", radius).collect()))


def nearest(points, targets, radius):
    """The same by all pairs."""
    pairs = ((i, math.sqrt((x - a) ** 2 + (y - b) ** 2), t) for i, x, y in points for t, a, b in targets if None not in (x, y, a, b))
    best = {}
    for i, far, t in pairs:
        if far <= radius and (i not in best or (far, t) < best[i]):
            best[i] = far, t
    return sorted((i, t, far) for i, (far, t) in best.items())


def test_nearest_targets_are_those_of_all_pairs(spark):
    dice = random.Random(7)
    at = lambda n, wide: [(dice.choice([1, 1, 1, 30]) * dice.uniform(-wide, wide), dice.uniform(-wide, wide)) for _ in range(n)]
    grid = [(20.0 * i, 1.25 * j) for i in range(-3, 4) for j in range(-3, 4)]
    points = [(i % 290, *p) for i, p in enumerate([*at(100, 3), *at(150, 90), *grid, (None, 1.0), (1e15, -1e15)])]
    targets = [(500 - i // 2, *p) for i, p in enumerate([*at(60, 2), *at(60, 90), *grid, *grid, (20.0, 0.0), (1.0, None), (1e15, -1e15)])]
    assert near(spark, points, targets, 20.0) == nearest(points, targets, 20.0)
    assert near(spark, points, targets, 1.25) == nearest(points, targets, 1.25)


def test_a_target_at_the_radius_counts(spark):
    assert near(spark, [(1, 0.0, 0.0), (2, -0.1, 0.0), (3, 5.0, 0.0)], [(9, 12.0, 16.0), (8, 20.0, 0.0), (7, -15.0, 0.0)], 20.0) == [(1, 7, 15.0), (2, 7, 14.9), (3, 8, 15.0)]
    assert near(spark, [(1, 0.0, 0.0)], [(9, 12.0, 16.0), (8, 20.0, 0.0)], 20.0) == [(1, 8, 20.0)]


def test_targets_are_not_broadcast(spark, sf_dir):
    plan = plans.QUERIES["spatial_nearest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_dense_targets_make_few_pairs(spark):
    """900 points among 900 targets a unit apart: the pairs within 20 are 571,120."""
    spots = [(i, float(i % 30), float(i // 30)) for i in range(900)]
    frame = lambda key: spark.createDataFrame(spots, f"{key} long, x double, y double")
    out = intervals.spatial_nearest(frame("id"), frame("target"), "id", 20.0)
    assert sorted(map(tuple, out.collect())) == [(i, i, 0.0) for i in range(900)]
    assert joined(out) < 30_000


def joined(out):
    """The most rows that a join of a frame, just collected, made."""
    plan, most = out._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    return most


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "asset string, id long, s double, e double")


@pytest.mark.parametrize("block", [4, 5_000])
@pytest.mark.parametrize("gap", [0.0, 0.7])
def test_overlaps_are_those_of_all_pairs(spark, monkeypatch, block, gap):
    monkeypatch.setattr(intervals, "BLOCK", block, raising=False)
    dice = random.Random(3)
    starts = [round(dice.choice([dice.uniform(-9, 9), dice.uniform(-90, 90), 6.0]), 1) for _ in range(160)]
    rows = [(dice.choice(["x", "x", "y", None]), i, s, round(s + dice.choice([0.0, 0.1, 3.0, 10.0, 70.0, -2.0]), 1)) for i, s in enumerate(starts)]
    rows += [("y", 900, None, 3.0), ("y", 901, 3.0, None), ("y", None, 3.0, 4.0), ("y", 5, 6.0, 7.0)]
    dice.shuffle(rows)
    meet = lambda p, q: p[0] == q[0] is not None and None not in p + q and p[1] < q[1] and p[2] < q[3] + gap and q[2] - gap < p[3]
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if meet(p, q))
    assert len(want) > 500 and sorted(map(tuple, intervals.overlaps(spans_of(spark, rows), "asset", "id", "s", "e", gap=gap, width=3.0).collect())) == want


def test_pairs_of_one_moment_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 20, raising=False)
    out = intervals.overlaps(spans_of(spark, [("x", i, 1.0, 2.0 + i) for i in range(400)]), "asset", "id", "s", "e")
    made = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert sum(made) == 400 * 399 // 2 and len(made) == 4
