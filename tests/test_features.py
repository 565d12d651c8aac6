"""A planted ride through the whole feature stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import calibration, features


def test_a_ride(spark):
    rate, n = 100, 60
    t = np.arange(0, n, 1 / rate)
    accl = np.full(len(t), 9.8) + np.where((t > 20) & (t < 40), 3 * np.sin(2 * np.pi * 15 * t), 0)
    accl[(t >= 50) & (t < 50.3)] = 0.5
    accl[(t >= 50.3) & (t < 50.4)] = 30
    imu = [("h1", float(a), float(b), 0.0, 0.0, 0.0, 0.4, 0.0) for a, b in zip(t, accl, strict=True)]
    imu = spark.createDataFrame(imu, "content_hash string, t double, accl_0 double, accl_1 double, accl_2 double, gyro_0 double, gyro_1 double, gyro_2 double")
    rows = []
    for i in range(n * 10):
        at = i / 10
        fix = 3.0 if at < 45 else 0.0
        rows.append(("h1", at, 0.0, 9.8, 0.0, 5.0, 100.0 - 0.5 * at, 2.0, fix))
    telemetry = spark.createDataFrame(rows, "content_hash string, t double, grav_0 double, grav_1 double, grav_2 double, gps_speed2d double, gps_alt double, gps_dop double, gps_fix double")
    assets = spark.createDataFrame([("h1", float(n)), ("h2", 3.0)], "content_hash string, duration_s double")
    scores, air = features.compute(assets, telemetry, imu)
    got = {(r["content_hash"], r["t"]): r for r in scores.collect()}
    assert len(got) == n + 3
    second = got["h1", 30.0]
    assert second["rough"] == pytest.approx(3 / 2**0.5, rel=0.1) and got["h1", 10.0]["rough"] < 0.3
    assert second["yaw_rate"] == pytest.approx(0.4, abs=0.01) and second["speed_ms"] == pytest.approx(5.0) and second["lat_accel"] == pytest.approx(2.0, abs=0.05)
    assert second["grade"] == pytest.approx(0.5, abs=1e-6)
    assert got["h1", 55.0]["speed_ms"] is None and got["h1", 55.0]["grade"] is None
    assert got["h1", 50.0]["air_s"] == pytest.approx(0.3, abs=0.02) and got["h1", 49.0]["air_s"] == 0.0
    assert got["h2", 0.0]["air_s"] is None and got["h2", 0.0]["rough"] is None
    assert air.count() == 1


def test_clocks(spark):
    assets = spark.createDataFrame(
        [("a", "r", 1, 100.0, "2024-06-21 12:00:00", 51.5, 0.0, None, None, None), ("b", "r", 2, 50.0, "2024-06-21 03:00:00", None, None, 200.0, None, None), ("c", None, None, 10.0, "2024-06-21 12:00:00", None, None, 900.0, "night", "hand")],
        "content_hash string, ride_id string, chapter int, duration_s double, recorded_at string, gps_lat double, gps_lon double, iso double, lighting string, lighting_source string",
    ).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    starts = spark.createDataFrame([("a", 1718971200.0)], "content_hash string, started double")
    got = {r["content_hash"]: r for r in features.retime(assets, starts).collect()}
    assert got["b"]["started"] == 1718971300.0 and got["a"]["drift_s"] == 0.0
    assert [got[k]["lighting"] for k in "abc"] == ["day", "day", "night"] and [got[k]["lighting_source"] for k in "abc"] == ["sun", "exposure", "hand"]


def test_weights():
    assert calibration.parse_weights("rough=0.8, turn=0.2")["rough"] == 0.8
    with pytest.raises(ValueError):
        calibration.parse_weights("smooth=1")
    assert calibration.same_weights({"a": 1.0, "b": 3.0}, {"a": 0.25, "b": 0.75}) and not calibration.same_weights({"a": 1.0}, {"b": 1.0})


def test_roll(spark):
    rng = np.random.default_rng(1)
    roll = rng.normal(0, 5, 60)
    rows = [("h", "z", float(0.4 * r + 2 + rng.normal(0, 0.1)), float(r), 1.0) for r in roll] + [("h", "x", float(0.4 * r), float(rng.normal()), 1.0) for r in roll]
    fit = features.roll_fit(spark.createDataFrame(rows, "content_hash string, axis string, tilt double, roll double, confidence double"))
    r = fit.first()
    assert r["axis"] == "z" and r["gain"] == pytest.approx(0.4, rel=0.1) and r["usable"]
    rolls = spark.createDataFrame([("h", 0.0, "z", 0.0), ("h", 1.0, "z", 10.0), ("h", 2.0, "z", -10.0)], "content_hash string, t double, axis string, roll double")
    seen = {x["t"]: x["visible"] for x in features.visible_roll(rolls, fit).collect()}
    assert seen[1.0] - seen[2.0] == pytest.approx(20 * r["gain"])
