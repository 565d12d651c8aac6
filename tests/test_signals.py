"""Planted answers for tilt, spectra, body roll, exact percentiles and stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.kernels import tilt
from ridgeline.operators import calibration, clips, features, quantiles, spectra


def picture(degrees, height=120, width=160):
    """Stripes of two directions, turned; its mean is zero, so its border is no edge."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    a = np.radians(degrees)
    u, v = x * np.cos(a) + y * np.sin(a), -x * np.sin(a) + y * np.cos(a)
    return 100 * np.tanh(4 * np.sin(u / 6)) + 60 * np.tanh(4 * np.sin(v / 8))


@pytest.mark.parametrize("degrees", [-17.0, -3.0, 2.0, 9.0, 20.0])
def test_a_turned_picture_is_tilted_by_as_much(degrees):
    got, strength = tilt.tilts(np.stack([picture(0), picture(degrees)]))
    assert got[1] - got[0] == pytest.approx(degrees, abs=0.06 * abs(degrees)) and strength.min() > 0.2


def test_pictures_of_any_kind(spark):
    noise = np.random.default_rng(1).integers(0, 255, (40, 50), dtype=np.uint8)
    rows = [(1, picture(5).ravel().tolist()), (2, None), (3, []), (4, [1.0] * 160 * 20), (5, [0.0] * 100), (6, picture(5).ravel().tolist() + [7.0])]
    df = spark.createDataFrame(rows, "id int, pixels array<double>")
    got = {r["id"]: (r["tilt"], r["strength"]) for r in tilt.frame_tilts(df, "pixels", 160).collect()}
    assert got[1] == got[6] and got[1][0] == pytest.approx(5, abs=0.3)
    assert got[2] == (None, None) and got[3] == (None, 0.0) and got[5] == (None, 0.0)
    assert got[4][0] == pytest.approx(0, abs=1e-6)  # a flat picture only has its border
    grey = spark.createDataFrame([(noise.tobytes(),)], "pixels binary")
    want = tilt.tilts(noise[None].astype(float))
    assert tilt.frame_tilts(grey, "pixels", 50).first()[0] == pytest.approx(want[0][0])
    assert tilt.frame_tilts(df.limit(0), "pixels", 160).count() == 0


def tones(rate=50.0, n=6_000, hz=(1.7, 4.2), seed=2):
    t = np.arange(n) / rate
    v = 3 * np.sin(2 * np.pi * hz[0] * t) + 2 * np.sin(2 * np.pi * hz[1] * t) + np.random.default_rng(seed).normal(0, 1, n)
    return t, v


def test_planted_tones_are_the_peaks(spark):
    t, v = tones()
    rows = [("a", float(x), float(y)) for x, y in zip(t, v, strict=True)] + [("b", float(x), 0.0) for x in t[:1100]] + [("c", float(x), float(y)) for x, y in zip(t[:500], v, strict=False)]
    rows += [("a", 7.001, None), ("a", 7.002, float("nan"))]
    spectrum = spectra.averaged(spark.createDataFrame(rows, "asset string, t double, v double").repartition(3), ["asset"], "v")
    found = {}
    for r in spectra.peaks(spectrum, ["asset"]).orderBy("asset", "rank").collect():
        found.setdefault(r["asset"], []).append((r["hz"], r["share"]))
    assert [round(h, 1) for h, _ in found["a"][:2]] == [1.7, 4.2] and found["a"][0][1] > 2 * found["a"][2][1]
    assert "b" not in found and "c" not in found  # flat, and shorter than a segment
    assert spectrum.where("asset = 'a'").select("segments").first()[0] == 5
    # the mean over segments, directly
    power = np.mean([np.abs(np.fft.rfft((x - x.mean()) * np.hanning(1024))) ** 2 for x in (v[i : i + 1024] for i in range(0, 5 * 1024, 1024))], axis=0)
    got = [r["power"] for r in spectrum.where("asset = 'a'").orderBy("k").collect()]
    assert np.allclose(got, power, rtol=1e-9)


def test_stretches_of_other_power_are_not_compared(spark):
    t, v = tones(n=4_096)
    loud = np.where(t < 40.96, v, 6 * v)
    rows = [("same", float(a), float(b)) for a, b in zip(t, v, strict=True)] + [("louder", float(a), float(b)) for a, b in zip(t, loud, strict=True)] + [("short", float(a), float(b)) for a, b in zip(t[:1500], v, strict=False)]
    df = spark.createDataFrame(rows, "asset string, t double, v double")
    got = {}
    for r in spectra.band_changes(df, ["asset"], "v", F.col("t") >= 40.96, [(0.5, 3.0), (3.0, 8.0)]).collect():
        got.setdefault(r["asset"], []).append(r)
    assert set(got) == {"same", "louder"}
    assert all(r["comparable"] and abs(r["change"]) < 0.05 for r in got["same"])
    assert all(not r["comparable"] and r["change"] is None and r["share_before"] is None for r in got["louder"])


def test_body_roll_whichever_way_down_points(spark):
    lean = np.radians(np.linspace(-20, 20, 21))
    rows = [("up", float(i), float(np.sin(a)), float(np.cos(a)), 0.3) for i, a in enumerate(lean)]
    rows += [("turned over", float(i), float(np.sin(a)), float(-np.cos(a)), 0.3) for i, a in enumerate(lean)]
    rows += [("side", float(i), float(np.cos(a)), float(np.sin(a)), 0.3) for i, a in enumerate(lean)]
    rows += [("up", 99.0, 0.0, 0.0, 0.0), ("up", 98.0, None, 1.0, 0.0), ("few", 0.0, 0.0, 1.0, 0.0)]
    got = features.body_roll(spark.createDataFrame(rows, "content_hash string, t double, grav_0 double, grav_1 double, grav_2 double")).toPandas().sort_values("t")
    for asset in ("up", "turned over", "side"):
        own = got[(got["content_hash"] == asset) & (got["t"] < 90)]["roll"].to_numpy()
        assert np.allclose(own, np.degrees(lean), atol=1e-9)
    assert got[got["t"] > 90]["roll"].isna().all() and "few" not in set(got["content_hash"])


def test_the_grid_serves_where_the_gyroscope_is_missing(spark):
    fused = spark.createDataFrame([("a", i / 200, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0) for i in range(200)] + [("b", 0.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0)], "content_hash string, t double, gyro_0 double, gyro_1 double, gyro_2 double, grav_0 double, grav_1 double, grav_2 double")
    grid = spark.createDataFrame([(a, i / 10, 0.2, 0.0, 0.0, 1.0, 0.0, 0.0) for a in "abc" for i in range(100)], fused.schema)
    own = {r["content_hash"]: (r["n"], r["g"]) for r in features.native_or_grid(fused, grid).groupBy("content_hash").agg(F.count("*").alias("n"), F.max("gyro_0").alias("g")).collect()}
    assert own == {"a": (200, 0.1), "b": (100, 0.2), "c": (100, 0.2)}
    assert features.native_or_grid(fused, grid.drop("gyro_0")).count() == 201
    assert features.twice(spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, None), ("b", 0.0, 1.0), ("b", 1.0, 2.0)], "content_hash string, t double, v double"), "v").select("content_hash").distinct().collect() == [("b",)]


@pytest.mark.parametrize(("few", "cuts", "finer"), [(1 << 20, 2_048, 32), (50, 16, 8), (0, 8, 2)])
def test_percentiles_are_exact_however_often_they_are_refined(spark, few, cuts, finer):
    rng = np.random.default_rng(1)
    rows = [("normal", float(x)) for x in rng.normal(0, 1, 3_000)] + [("ties", float(x)) for x in rng.integers(0, 5, 2_000)] + [("one value", 1.5)] * 700
    rows += [("steep", float(x)) for x in np.exp(rng.normal(0, 50, 1_500))] + [("single", 3.0), ("none", None)] + [("nan", float("nan"))] * 3 + [("nan", 1.0)] * 2
    rows += [("edges", x) for x in (1e308, -1e308, 5e-324, 0.0, -0.0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    plain = df.where("value is not null").groupBy("g").agg(F.count("value").alias("n"), F.percentile("value", F.array(*[F.lit(i / 100) for i in range(101)])).alias("p")).collect()
    got = {r["g"]: (r["n"], r["breaks"]) for r in quantiles.percentiles(df, 101, few, cuts, finer).collect()}
    assert set(got) == {r["g"] for r in plain}
    for r in plain:
        assert got[r["g"]][0] == r["n"] and np.allclose(got[r["g"]][1], r["p"], rtol=1e-12, atol=0, equal_nan=True)
    assert quantiles.percentiles(df.limit(0)).count() == 0


def test_sketched_breaks_are_near_exact_ones(spark):
    df = spark.createDataFrame([(float(x), k) for k in (1, 3) for x in np.random.default_rng(k).uniform(0, 1, 400)] + [(0.5, 2), (0.25, None)], "level_raw double, key int")
    exact, sketch = (sorted(calibration.level_breaks(df, approximate=a).collect(), key=lambda r: r["key"] or 0) for a in (False, True))
    assert [(r["key"], r["n"]) for r in exact] == [(r["key"], r["n"]) for r in sketch] == [(None, 802), (1, 400), (3, 400)]
    assert all(np.allclose(a["breaks"], b["breaks"], atol=0.02) for a, b in zip(exact, sketch, strict=True))


@pytest.mark.parametrize("n", [1, 10, 64, 65, 5_000])
def test_stretches_end_at_the_nearest_lower_second(spark, n):
    rng = np.random.default_rng(n)
    ys = np.round(rng.uniform(0, 1, n), 3)
    seconds = spark.createDataFrame([("x", i, float(y)) for i, y in enumerate(ys)] + [("other", 0, 0.0)], "asset string, i int, y double")
    tops = [("x", int(i), float(ys[i]) / (1 if j % 3 else 50)) for j, i in enumerate(rng.choice(n, min(n, 200), replace=False))]
    rules = clips.Rules()
    for r in clips.stretches(spark.createDataFrame(tops, seconds.schema), seconds, "asset", rules).collect():
        first = last = r["i"]
        while first > 0 and ys[first - 1] >= r["y"] * rules.keep:
            first -= 1
        while last < n - 1 and ys[last + 1] >= r["y"] * rules.keep:
            last += 1
        assert (r["first"], r["last"]) == (first, last)
