"""The tracker over a stream: frames out of order and too late, and a subject that expires."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline.kernels import tracker
from ridgeline.streaming import extensions

SCHEMA = "asset long, ts timestamp, t double, boxes array<struct<x0:double,y0:double,x1:double,y1:double,score:double>>, rejected int"


def frame(asset, i, boxes=None):
    u = 0.3 + 0.01 * i
    own = [(u, 0.4, u + 0.05, 0.5, 0.8), (0.9, 0.9, 0.95, 0.95, 0.9 if i == 7 else 0.2)] if boxes is None else boxes
    return (asset, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=i / 5), i / 5, own, i % 2)


@pytest.fixture
def rocks(spark):
    for k, v in extensions.ROCKS.items():
        spark.conf.set(k, v)
    yield
    for k in extensions.ROCKS:
        spark.conf.unset(k)


def test_frames_out_of_order_give_the_tracks_of_the_whole(spark, tmp_path, rocks):
    source = tmp_path / "in"
    source.mkdir()
    later = (3, dt.datetime(2024, 1, 1, 1, tzinfo=dt.timezone.utc), 3600.0, [], 0)
    batches = [
        [frame(1, i) for i in (0, 3, 1, 2, 9)] + [frame(2, i) for i in range(4)],
        [frame(1, i) for i in (8, 5, 4, 6, 7)] + [frame(2, 4, [])],  # before frames that came already, within what may be late
        [frame(1, i) for i in range(10, 40)],
        [later],  # an hour on: the watermark passes all, and both are silent for longer than is kept
        [frame(1, 20, [(0.0, 0.0, 0.1, 0.1, 1.0)])],  # too late: dropped
    ]
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    out = extensions.track_stream(stream, late="2 seconds", idle_s=30)
    q = out.writeStream.outputMode("append").format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "check")).start()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for part in (tmp_path / f"b{i}").glob("*.parquet"):
            part.rename(source / f"{i}.parquet")
        q.processAllAvailable()
    q.stop()
    names = [c.split()[0] for c in tracker.SCHEMA.split(", ")]
    got = {(r["asset"], r["t"]): tuple(r[n] for n in names) for r in spark.table("tracks").collect()}
    frames = {1: [frame(1, i) for i in range(40)], 2: [frame(2, i) for i in range(4)] + [frame(2, 4, [])]}
    for asset, own in frames.items():
        for row in tracker.follow([(t, boxes, rejected) for _, _, t, boxes, rejected in own]):
            assert got[asset, row[0]] == pytest.approx(row)
    assert {k for k in got if k[0] in (1, 2)} == {(a, f[2]) for a, own in frames.items() for f in own}
    # nothing is kept of the assets that went silent
    state = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "subject").load()
    assert state.where(F.col("key.asset").isin(1, 2)).count() == 0
