"""Planted answers for expressions, gates, catalogue states, sources and streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from ridgeline import nulls, schema
from ridgeline.functions import clock, media, numbers
from ridgeline.operators import calibration, catalogue, decisions, gates, intervals, ordering, series
from ridgeline.sources import files, payloads
from ridgeline.streaming import extensions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_worked_second(spark):
    subs = [F.lit(None).cast("double"), F.lit(0.359946), F.lit(0.987927), F.lit(None).cast("double")]
    raw = one(spark, numbers.power_mean(subs, [0.0, 0.15, 0.85, 0.0], 2.0))
    assert raw == pytest.approx(0.921430, abs=5e-6)
    smooth = (0.990415 + 0.958597 + 0.998200) / 3
    assert smooth == pytest.approx(0.982404, abs=5e-6)
    df = spark.createDataFrame([(1, float(i), v, a) for i, (v, a) in enumerate([(0.990415, 0.0), (0.958597, 0.0), (0.998200, 0.5)])], "asset int, t double, level double, s_air double")
    out = {r["t"]: r["composite"] for r in calibration.composite(df, "asset", ["t"]).collect()}
    assert out[1.0] == pytest.approx(1 - (1 - smooth) * (1 - 0.75 * 0.5), abs=5e-6)


@pytest.mark.parametrize("p", [1.0, 2.0, 8.0])
def test_power_mean_is_the_formula(spark, p):
    got = one(spark, numbers.power_mean([F.lit(1.0), F.lit(0.5), F.lit(0.9)], [0.85, 0.15, 0.0], p))
    assert got == pytest.approx((0.85 + 0.15 * 0.5**p) ** (1 / p))
    assert one(spark, numbers.power_mean([F.lit(None).cast("double")], [1.0], p)) is None


def test_rank_interp_clamps_and_interpolates(spark):
    breaks = F.array(*[F.lit(float(i)) for i in range(101)])
    for v, want in ((-1.0, 0.0), (0.0, 0.0), (50.5, 0.505), (100.0, 1.0), (200.0, 1.0)):
        assert one(spark, numbers.rank_interp(F.lit(v), breaks)) == pytest.approx(want)
    assert one(spark, numbers.rank_interp(F.lit(None).cast("double"), breaks)) is None
    assert one(spark, numbers.rising(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)))) == [1.0, 3.0, 3.0]


def test_names_and_shapes(spark):
    for name, want in (("GX010603.MP4", ("0603", 1)), ("gopr0042.mp4", ("0042", 1)), ("holiday.mp4", (None, None)), ("GH120001", ("0001", 12))):
        assert tuple(one(spark, media.ride_chapter(F.lit(name)))) == want
    assert one(spark, media.slugify(F.lit("0603 / best bit!"))) == "0603_best_bit"
    assert one(spark, media.slugify(F.lit("!!"))) == "cut"
    assert tuple(one(spark, media.crop_box(F.lit(5312), F.lit(2988))))[:2] == (1680, 2988)
    assert one(spark, media.rotation_budget(F.lit(1680), F.lit(2988), F.lit(5312), F.lit(2988))) == pytest.approx(25.0, abs=1e-3)
    assert one(spark, media.rotation_budget(F.lit(1214), F.lit(2160), F.lit(3840), F.lit(2160))) == pytest.approx(17.8, abs=0.1)
    rates = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, media.plan_fps(rates(29.97, 29.97, 29.97))) is None
    assert one(spark, media.plan_fps(rates(29.97, 59.94))) == 59.94
    assert one(spark, media.plan_fps(rates(29.97, 59.94), slowest=True)) == 29.97
    assert one(spark, media.plan_fps(rates(59.94, 120))) == 60.0
    assert one(spark, media.aspect_label(F.lit(0), F.lit(5))) == "unknown"
    assert one(spark, media.parse_rate(F.lit("30000/1001"))) == pytest.approx(29.97003)
    assert one(spark, media.human_bytes(F.lit(1_500_000))) == "1.5 MB"


def test_probe(spark):
    text = json.dumps({"format": {"format_name": "mov", "duration": "12.5", "size": "100", "tags": {"creation_time": "2024-01-01T00:00:00Z"}}, "streams": [{"codec_type": "video", "codec_name": "hevc", "width": 5312, "height": 2988, "r_frame_rate": "60000/1001", "pix_fmt": "yuv420p10le"}, {"codec_type": "data", "codec_tag_string": "gpmd"}]})
    p = one(spark, media.probe_fields(F.lit(text)))
    assert (p["duration_s"], p["vcodec"], p["aspect"], p["bit_depth"], p["has_gpmd"]) == (12.5, "hevc", "16:9", 10, True)


def test_quaternions(spark):
    half = F.lit(2**-0.5)
    q = [half, F.lit(0.0), F.lit(0.0), half]  # a quarter turn about z
    got = one(spark, F.array(*numbers.quat_rotate(q, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])))
    assert got == pytest.approx([0, 1, 0], abs=1e-12)
    unit = one(spark, F.array(*numbers.quat_multiply(q, numbers.quat_conjugate(q))))
    assert unit == pytest.approx([1, 0, 0, 0], abs=1e-12)


def test_light(spark):
    noon = one(spark, clock.solar_elevation(F.lit(1718971200.0), F.lit(51.48), F.lit(0.0)))  # 2024-06-21 12:00 UTC, Greenwich
    assert noon == pytest.approx(61.95, abs=0.3)
    assert one(spark, clock.lighting_label(F.lit(-3.0))) == "twilight"


def test_upright_and_priors(spark):
    assert one(spark, gates.upright(F.lit(0.01), F.lit(0.94), F.lit(0.26))) == 0
    assert one(spark, gates.upright(F.lit(0.01), F.lit(-0.94), F.lit(0.26))) == 180
    assert one(spark, gates.upright(F.lit(0.9), F.lit(0.2), F.lit(0.2))) is None
    boxes = [(18, 0.9, 0.0, 0.5, 0.3, 0.6), (18, 0.6, 0.45, 0.45, 0.55, 0.6), (18, 0.5, 0.5, 0.5, 0.505, 0.51), (18, 0.9, 0.1, 0.1, 0.9, 0.9), (1, 0.9, 0.4, 0.4, 0.5, 0.5)]
    df = spark.createDataFrame([(1, *b) for b in boxes], "frame int, class_id int, score double, x0 double, y0 double, x1 double, y1 double")
    assert tuple(gates.detection_priors(df, ["frame"]).first()) == (1, 1, 3)


def test_nan_boundary(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None)], "a double, b double")
    assert [tuple(r) for r in nulls.nan_to_null(df).collect()] == [(None, 1.0), (None, None)]
    for s in (schema.asset(), schema.segment(), schema.render_job(), schema.stage_run(), schema.telemetry(), schema.scores(), schema.track()):
        assert spark.createDataFrame([], s).count() == 0


class Disk:
    """A file system of names, on which renames from some names fail."""

    def __init__(self, names, stuck):
        self.names, self.stuck = dict(names), stuck

    def exists(self, name):
        return name in self.names

    def rename(self, a, b):
        if a in self.stuck or b in self.names:
            return False
        self.names[b] = self.names.pop(a)
        return True

    def delete(self, name, _):
        return self.names.pop(name, None) is not None


@pytest.mark.parametrize(("stuck", "left"), [((), {"at": "new"}), (("at",), {"at": "was"}), (("fresh",), {"at": "was"}), (("fresh", "gone"), {"gone": "was", "fresh": "new"})])
def test_a_failed_swap_loses_nothing(stuck, left):
    disk = Disk({"at": "was", "fresh": "new"}, stuck)
    if stuck:
        with pytest.raises(OSError):
            catalogue.swap(disk, "at", "fresh", "gone")
    else:
        catalogue.swap(disk, "at", "fresh", "gone")
    assert disk.names == left
    first = Disk({"fresh": "new"}, ())
    catalogue.swap(first, "at", "fresh", "gone")
    assert first.names == {"at": "new"}


def test_running_totals_over_several_parts(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.randrange(40), rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(5)
    got = {r["id"]: (r["n"], r["s"]) for r in ordering.running(df, ["k", "id"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[i] == (n, total)
        total += v
    assert ordering.numbered(df.limit(0), ["k"], "n").count() == 0


def test_queue(spark):
    jobs = spark.createDataFrame([], "id bigint, name string, status string, error string, created_at string")
    jobs = catalogue.enqueue(jobs, spark.createDataFrame([("a", "1"), ("b", "2")], "name string, created_at string"))
    assert catalogue.next_job(jobs).first()["name"] == "a"
    jobs = catalogue.cancel(jobs, 1)
    assert catalogue.next_job(jobs).first()["name"] == "b"
    jobs = jobs.withColumn("status", F.when(F.col("id") == 2, "running").otherwise(F.col("status")))
    assert {r["name"]: r["status"] for r in catalogue.fail_orphans(jobs).collect()} == {"a": "cancelled", "b": "error"}


def test_catalogue_changes(spark, tmp_path):
    assets = spark.createDataFrame([("h1", "GX010603.MP4", "0603", None, None, None), ("h2", "GX020603.MP4", "0603", "day", "sun", "bar")], "content_hash string, filename string, ride_id string, lighting string, lighting_source string, mount string")
    assert {tuple(r) for r in catalogue.set_ride(assets, "0603", "night", "chest").select("lighting", "lighting_source", "mount").collect()} == {("night", "hand", "chest")}
    assert catalogue.find_one(assets, "h1")["filename"] == "GX010603.MP4"
    with pytest.raises(LookupError):
        catalogue.find_one(assets, "0603")
    runs = spark.createDataFrame([("h1", "score", 2, "ok", "1")], "content_hash string, stage string, stage_version int, status string, finished_at string")
    new = spark.createDataFrame([("h1", "score", 3, "error", "2"), ("h1", "score", 3, "ok", "3")], runs.schema)
    got = catalogue.record_stage(runs, new)
    assert [r["status"] for r in got.collect()] == ["ok"] and catalogue.stage_done(got, catalogue.stage_versions(got)).first()["done"]
    path = str(tmp_path / "runs")
    catalogue.save_snapshot(got, path)
    catalogue.save_snapshot(spark.read.parquet(path).limit(0), path)
    assert spark.read.parquet(path).count() == 0
    jobs = spark.createDataFrame([(1, [2, 1]), (2, [1, 3])], "id bigint, segment_ids array<bigint>")
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    assert [r["name"] for r in catalogue.ordered_edit(jobs.where("id = 1"), parts).orderBy("pos").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no segment 3 for job 2"):
        catalogue.ordered_edit(jobs, parts).collect()
    segments = spark.createDataFrame([(1, "candidate", None, None, None)], "id bigint, status string, reason string, t_in_user double, decided_at string")
    decided = catalogue.decide(segments, spark.createDataFrame([(1, "approved", "fun", 2.0, "now")], "id bigint, status string, reason string, t_in_user double, at string"))
    assert tuple(decided.first()) == (1, "approved", "fun", 2.0, "now")


def test_freefall_end_is_the_sample_after(spark):
    mag = [9.8] * 10 + [1.0] * 3 + [25.0] + [9.8] * 10
    df = spark.createDataFrame([(1, i * 0.1, m) for i, m in enumerate(mag)], "asset int, t double, mag double")
    r = series.freefall(df, "asset", "t", "mag").first()
    assert (round(r["t_start"], 3), round(r["t_end"], 3), r["landing"]) == (1.0, 1.3, 25.0)


def test_slope_and_median(spark):
    df = spark.createDataFrame([(1, float(i), 3.0 * i) for i in range(60)], "asset int, t double, v double")
    out = df.select("t", series.windowed_slope("asset", "t", "v").alias("s"), series.median_filter("asset", "t", "v").alias("m")).where("t = 30").first()
    assert out["s"] == pytest.approx(3.0) and out["m"] == 90.0


def test_suppression_equals_a_loop(spark):
    import random

    random.seed(3)
    spans = [(i, random.random(), a := random.uniform(0, 300), a + random.uniform(8, 30)) for i in range(40)]
    df = spark.createDataFrame([(1, *s) for s in spans], "g int, id int, score double, a double, b double")
    got = {(r["a"], r["b"]) for r in intervals.suppress(df, "g", [-F.col("score"), F.col("id")], "a", "b", 9.0).collect()}
    kept = []
    for _, _, a, b in sorted(spans, key=lambda s: -s[1]):
        if not any(a < d + 9 and c - 9 < b for c, d in kept):
            kept.append((a, b))
    assert got == set(kept)


def test_ridge_equals_newton(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = (rng.uniform(size=200) < 1 / (1 + np.exp(-x @ [1.0, -0.5]))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    model = decisions.fit_ridge(df, ["a", "b"], "y")
    full, w = np.c_[x, np.ones(200)], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        ridge = np.diag([2.0, 2.0, 0.0])
        w -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + ridge, full.T @ (p - y) + ridge @ w)
    assert list(model.coefficients) == pytest.approx(list(w[:2]), abs=1e-5)
    weights = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (0, "b", -1.0), (1, "b", 1.0)], "fold int, feature string, weight double")
    stable = {r["feature"]: r["stable"] for r in decisions.weight_stability(weights).collect()}
    assert stable == {"a": True, "b": False}
    assert {r["feature"]: r["weight"] for r in decisions.suggested_weights(decisions.weight_stability(weights)).collect()} == {"a": 1.0, "b": 0.0}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "GX010001.MP4").write_bytes(b"one" * 10)
    (tmp_path / "a" / "copy.mp4").write_bytes(b"one" * 10)
    (tmp_path / "a" / "GX010001.LRV").write_bytes(b"low")
    found = files.find_videos(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == ["GX010001.MP4", "copy.mp4"]
    index = files.index_archive(found)
    assert index.count() == 1 and index.first()["content_hash"].startswith("s3b2_")
    checked = files.verify(found.withColumn("expected", F.lit(index.first()["content_hash"])))
    assert checked.where("ok").count() == 2
    assets = spark.createDataFrame([(index.first()["content_hash"], "x", None), ("other", "y", None), ("done", "z", "p")], "content_hash string, source_path string, archived_path string")
    assert {r["content_hash"]: r["action"] for r in files.archive_plan(assets, index).collect()} == {index.first()["content_hash"]: "link", "other": "copy", "done": "skip"}
    present = spark.createDataFrame([("x",), ("p",)], "path string")
    assert sorted(r["state"] for r in files.resolve_originals(assets, present).collect()) == ["archive", "missing", "source"]
    assert files.fourcc_counts(found).where("n > 0").count() == 0
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="51.5" lon="-0.1"><ele>10</ele></trkpt><trkpt lat="51.6" lon="-0.2"><ele>12</ele></trkpt></trkseg></trk></gpx>')
    assert [tuple(r) for r in files.read_gpx(spark, str(tmp_path / "t.gpx")).collect()] == [(51.5, -0.1, 10.0), (51.6, -0.2, 12.0)]
    rows = spark.createDataFrame([(1, "approved")], "id int, status string")
    assert files.export_decisions(rows, str(tmp_path / "log")) == 1
    files.write_csv(rows, str(tmp_path / "csv"))
    data = spark.createDataFrame([("h1", 0.0, 1.0), ("h2", 0.0, 2.0)], "content_hash string, t double, v double")
    files.write_series(data, str(tmp_path / "series"))
    files.write_series(data.where("content_hash = 'h1'").withColumn("v", F.lit(9.0)), str(tmp_path / "series"))
    assert {r["content_hash"]: r["v"] for r in spark.read.parquet(str(tmp_path / "series")).collect()} == {"h1": 9.0, "h2": 2.0}


def item(key, kind, size, repeat, body):
    return key.encode() + struct.pack(">cBH", kind.encode() if kind else b"\0", size, repeat) + body + b"\0" * (-len(body) % 4)


def atom(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_payload_source(spark, tmp_path):
    fields = [(515000000, -1000000, 12345, 2500, 30), (515000100, -1000100, 12350, 2600, 31)]
    body = b"".join(struct.pack(">5i", *f) for f in fields)
    strm = item("STMP", "J", 8, 1, struct.pack(">Q", 42)) + item("SCAL", "l", 4, 5, struct.pack(">5i", 10**7, 10**7, 1000, 1000, 100)) + item("GPS5", "l", 20, 2, body)
    payload = item("DEVC", None, 1, len(item("STRM", None, 1, len(strm), strm)), item("STRM", None, 1, len(strm), strm))
    mdat = atom(b"mdat", payload)
    ftyp = atom(b"ftyp", b"mp41\0\0\0\0")
    stbl = atom(b"stsd", struct.pack(">II", 0, 1) + atom(b"gpmd", b"\0" * 8)) + atom(b"stsz", struct.pack(">III", 0, 0, 1) + struct.pack(">I", len(payload))) + atom(b"stco", struct.pack(">III", 0, 1, len(ftyp) + 8)) + atom(b"stts", struct.pack(">IIII", 0, 1, 1, 1001)) + atom(b"stsc", struct.pack(">IIIII", 0, 1, 1, 1, 1))
    moov = atom(b"moov", atom(b"trak", atom(b"mdia", atom(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 1000, 0, 0)) + atom(b"minf", atom(b"stbl", stbl)))))
    path = tmp_path / "x.mp4"
    path.write_bytes(ftyp + mdat + moov)
    spark.dataSource.register(payloads.PayloadSource)
    row = spark.read.format("telemetry").option("key", "GPS5").load(str(path)).first()
    assert (row["payload"], row["seconds"], row["stmp_us"], row["n"]) == (0, 0.0, 42, 2)
    assert row["samples"][0] == pytest.approx([51.5, -0.1, 12.345, 2.5, 0.3])
    with pytest.raises(ValueError):
        payloads.struct_format("?", 20, None)
    assert list(payloads.divisors([0.0], 2)) == [1.0, 1.0]


def test_streams(spark, tmp_path, sf_dir):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    events = extensions.read_events(spark, str(tmp_path / "in"))
    for name, df in (("w", extensions.windowed(events)), ("s", extensions.sessions(events))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() > 0
