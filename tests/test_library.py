"""A folder of recordings, from bytes to ranked rides and clips, and the catalogue's state machines."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from ridgeline import schema
from ridgeline.__main__ import main
from ridgeline.functions.media import ride_chapter
from ridgeline.kernels import framing
from ridgeline.library import Library
from ridgeline.operators import calibration, catalogue, features, gates, intervals
from ridgeline.sources import files

from .test_extraction import gps9, item, movie, nested

SECONDS = 120


def vectors(key, i, rate, value):
    body = b"".join(struct.pack(">3f", *value(i + j / rate)) for j in range(rate))
    return nested(item(key, "f", 12, rate, body))


def ride(path, phase):
    """Two minutes with a rough stretch, steady turning and a position."""
    shake = lambda t: 4.0 * math.sin(2 * math.pi * 15 * t) * (1 + 3 * (50 + phase < t < 75 + phase)) * (1 + 0.2 * math.sin(t / 7))
    second = lambda i: [
        gps9(i),
        vectors("ACCL", i, 200, lambda t: (9.8 + shake(t), 0.1, 0.2)),
        vectors("GYRO", i, 200, lambda t: (0.0, 0.4 + 0.3 * math.sin(t / 5 + phase), 0.0)),
        vectors("GRAV", i, 30, lambda t: (0.0, 1.0, 0.0)),
    ]
    return movie(path, [second(i) for i in range(SECONDS)], 1000)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    videos = folder / "videos"
    videos.mkdir()
    for i, name in enumerate(("GX010603.MP4", "GX020603.MP4", "GX010604.MP4")):
        ride(videos / name, 10 * i)
    own = Library(spark, str(folder / "root"))
    assert own.ingest(str(videos)) == 3 and own.ingest(str(videos)) == 0
    own.score()
    own.calibrate({"speed": 0.0, "turn": 0.2, "rough": 0.8, "descent": 0.0})
    return own, videos


def test_stages_of_a_library(library, spark, tmp_path, capsys):
    own, videos = library
    assets = {r["filename"]: r for r in own.table("assets").collect()}
    assert {(r["ride_id"], r["chapter"]) for r in assets.values()} == {("0603", 1), ("0603", 2), ("0604", 1)}
    assert assets["GX010603.MP4"]["streams"] == ["ACCL", "GPS9", "GRAV", "GYRO"] and assets["GX010603.MP4"]["duration_s"] == pytest.approx(SECONDS, abs=0.2)
    scores = own.table("scores")
    assert scores.count() == 3 * SECONDS and scores.where("rough > 8").count() > 60 and scores.where("yaw_rate is null").count() == 0
    weights = {"speed": 0.0, "turn": 0.2, "rough": 0.8, "descent": 0.0}
    n = own.clips(weights)
    found = own.table("segments").collect()
    assert n == len(found) >= 3 and len({r["id"] for r in found}) == n and {r["status"] for r in found} == {"candidate"}
    best = {r["content_hash"]: r for r in found if r["rank"] == 1}
    for i, name in enumerate(("GX010603.MP4", "GX020603.MP4", "GX010604.MP4")):
        r = best[assets[name]["content_hash"]]
        assert r["t_in"] < 75 + 10 * i and r["t_out"] > 50 + 10 * i and r["dominant"] in ("rough", "turn")
    # a decided segment stays through the next selection
    first = found[0]
    delta = spark.createDataFrame([(first["id"], "approved", None, None, None, None)], "id bigint, status string, reason string, t_in_user double, t_out_user double, at timestamp")
    own.replace("segments", catalogue.decide(own.table("segments"), delta.withColumn("at", F.current_timestamp())))
    assert own.clips(weights) == n and own.table("segments").where("status = 'approved'").first()["id"] == first["id"]
    ranked = own.rank("top30").collect()
    assert {r["ride"] for r in ranked} == {"0603", "0604"} and ranked[0]["top30"] >= ranked[1]["top30"] and len(own.rank(top=1).collect()) == 1
    assert {r["lacks"] for r in own.inventory().collect()} == {""} and own.buckets().agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    assert own.label("0603", style="trail") == 2 and own.label("0603", style="trail") == 0
    counts = {(r["style"], r["mount"]): r["files"] for r in catalogue.label_counts(own.table("assets")).collect()}
    assert counts == {("trail", "-"): 2, ("-", "-"): 1}
    # decisions by the score itself: the fit sees them, and says that there are too few pairs within rides
    names = [f.name for f in schema.segment().fields]
    extra = spark.range(100, 160).select(F.col("id"), F.lit(assets["GX010603.MP4"]["content_hash"]).alias("content_hash"), F.col("id").cast("double").alias("t_in"), (F.col("id") + 12.0).alias("t_out"), (F.col("id") % 2 * 0.2 + 0.5).alias("score"),
        F.create_map(F.lit("turn"), F.col("id") % 7 / 7.0, F.lit("rough"), 0.3 + 0.4 * (F.col("id") % 2) + F.col("id") % 5 / 50.0).alias("features"), F.when(F.col("id") % 2 == 1, "approved").otherwise("rejected").alias("status"))
    before = own.table("segments")
    own.replace("segments", before.unionByName(extra, allowMissingColumns=True).select(*names))
    row, weights = own.fit()
    row = row.first()
    assert row["n"] >= 60 and row["fit"] > 0.95 and row["verdict"] in ("no better", "keep current", "use it")
    assert {r["feature"]: r["weight"] for r in weights.collect()}["rough"] > 0.5
    own.replace("segments", own.table("segments").where("id < 100"))
    with pytest.raises(ValueError, match="too few"):
        own.fit()
    order = [(r["ride"], r["chapter"], r["t_in"]) for r in own.listed().collect()]
    assert order == sorted(order) and own.recordings().count() == 3
    assert {r["degrees"] for r in own.orient().collect()} == {0} and own.level().where("suppression is null").count() == 3  # no quaternions here
    n, rest = files.export_and_clear(own.table("segments"), str(tmp_path / "log"))
    assert n == 1 and rest.where("status <> 'candidate'").count() == 0
    for command in (["rank", own.root, "--top", "1"], ["inventory", own.root], ["buckets", own.root], ["log", own.root], ["label", own.root], ["label", own.root, "0604", "--mount", "chest"]):
        assert main(command) == 0
    out = capsys.readouterr().out
    assert "GX010604.MP4" in out and "trail" in out and "1 changed" in out


def test_archive_and_restore(library, tmp_path):
    own, videos = library
    shelf, work = tmp_path / "shelf", tmp_path / "work"
    shelf.mkdir()
    work.mkdir()
    (shelf / "GX010604.MP4").write_bytes(b"another file")
    failed = own.archive(str(shelf)).collect()
    assert [r["path"].endswith("GX010604.MP4") for r in failed] == [True] and "is there" in failed[0]["error"]
    assert (shelf / "GX010603.MP4").read_bytes() == (videos / "GX010603.MP4").read_bytes()
    back = own.restore(str(work)).collect()
    assert len(back) == 2 and all(r["error"] is None for r in back) and (work / "GX020603.MP4").exists()
    (work / "GX020603.MP4").write_bytes(b"spoilt")
    assert all(r["error"] is None for r in own.restore(str(work)).collect()) and (work / "GX020603.MP4").stat().st_size > 100
    with pytest.raises(ValueError):
        files.copy_verified(str(videos / "GX010603.MP4"), str(work / "x.mp4"), "s3b2_other")
    assert sorted(p.name for p in work.iterdir()) == ["GX010603.MP4", "GX020603.MP4"]


def test_jobs_in_tasks(spark, tmp_path):
    path, out = str(tmp_path / "jobs"), str(tmp_path)
    rows = [(1, "a", [1], "queued"), (2, "b", [2], "queued"), (3, "c", [3], "running"), (4, "d", [1, 9], "queued"), (5, "e", None, "cancelled")]
    jobs = spark.createDataFrame(rows, "id bigint, name string, segment_ids array<bigint>, status string").withColumns({"out_path": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    catalogue.save_snapshot(jobs, path)

    def do(job):
        target = f"{out}/{job.name}"
        with open(target, "w") as f:
            f.write(str(job["segment_ids"]))
        if 9 in job.segment_ids:
            raise ValueError("no segment 9")
        return target

    def clean(job):
        import os

        os.remove(f"{out}/{job.name}")

    state = lambda: {r["id"]: (r["status"], r["out_path"] and r["out_path"].rsplit("/", 1)[1], r["error"]) for r in spark.read.parquet(path).collect()}
    assert catalogue.work_in_tasks(path, spark, do, clean, most=1) == 1
    assert state() == {1: ("done", "a", None), 2: ("queued", None, None), 3: ("error", None, "interrupted"), 4: ("queued", None, None), 5: ("cancelled", None, None)}
    assert catalogue.work_in_tasks(path, spark, do, clean) == 2 and catalogue.work_in_tasks(path, spark, do, clean) == 0
    assert state()[2] == ("done", "b", None) and state()[4] == ("error", None, "no segment 9")
    assert (tmp_path / "b").read_text() == "[2]" and not (tmp_path / "d").exists()


def test_job_worker(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = [(1, "a", [1], "queued"), (2, "b", [2], "queued"), (3, "c", [3], "running"), (4, "d", [1, 9], "queued")]
    jobs = spark.createDataFrame(rows, "id bigint, name string, segment_ids array<bigint>, status string").withColumns({"out_path": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    catalogue.save_snapshot(jobs, path)
    order, cleaned = [], []

    def do(job):
        order.append(job["id"])
        if job["id"] == 2:
            raise RuntimeError("no encoder")
        return f"out/{job['name']}.mp4"

    assert catalogue.work(path, spark, do, lambda job: cleaned.append(job["id"])) == 3
    got = {r["id"]: (r["status"], r["out_path"], r["error"]) for r in spark.read.parquet(path).collect()}
    assert order == [1, 2, 4] and cleaned == [2]
    assert got == {1: ("done", "out/a.mp4", None), 2: ("error", None, "no encoder"), 3: ("error", None, "interrupted"), 4: ("done", "out/d.mp4", None)}
    segments = spark.createDataFrame([(1, "h", "approved"), (2, "h", "candidate")], "id bigint, content_hash string, status string")
    assert [tuple(r) for r in catalogue.known_queued(jobs, segments).orderBy("id").collect()] == [(1, 1), (4, 1)]
    assets = spark.createDataFrame([("h", "x.mp4")], "content_hash string, filename string")
    assert catalogue.by_id(segments, assets, 2)["filename"] == "x.mp4" and catalogue.by_id(segments, assets, 7) is None


def test_predicates_and_slices(spark):
    df = spark.createDataFrame([(True, ["ACCL", "GPS9"], 25.0), (True, ["ACCL"], 19.0), (None, None, None)], "gpmd boolean, streams array<string>, s double")
    got = df.select(gates.long_enough(F.col("s")), gates.has_position(F.col("streams")), F.array_join(gates.shortcomings(F.col("gpmd"), F.col("streams"), F.col("s")), "+")).collect()
    assert [tuple(r) for r in got] == [(True, True, "tiny"), (False, False, "no position+tiny"), (False, False, "no telemetry+tiny")]
    points = spark.createDataFrame([("a", float(t)) for t in range(100)] + [("b", 5.0)], "asset string, t double")
    spans = spark.createDataFrame([("a", 1, 10.0, 12.0), ("a", 2, 11.0, 45.0), ("c", 3, 0.0, 9.0)], "asset string, clip int, t0 double, t1 double")
    assert sorted(r["t"] for r in intervals.within_any(points, spans, "asset", "t", "t0", "t1").collect()) == [float(t) for t in range(10, 46)]
    cut = intervals.slices(points, spans, "asset", "t", "clip", "t0", "t1", 2.0)
    assert {k: sorted(r["t"] for r in cut.where(F.col("clip") == k).collect()) for k in (1, 2, 3)} == {1: [float(t) for t in range(8, 15)], 2: [float(t) for t in range(9, 48)], 3: []}


def test_turn_rank_is_of_cornering_where_it_is_known(spark):
    rows = [("a", float(i), None if i % 2 else i / 10, i / 50, 3.0 + i % 7, 0.2 * (i % 9), 5.0 + i % 11, 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "content_hash string, t double, lat_accel double, yaw_rate double, speed_ms double, grade double, rough double, air_s double")
    breaks = calibration.score_breaks(df)
    plain = {(r["t"]): (r["s_lat_accel"], r["s_yaw_rate"]) for r in calibration.ranked(df, breaks, ["lat_accel", "yaw_rate"]).collect()}
    for r in calibration.sub_scores(df, breaks).collect():
        lateral, yaw = plain[r["t"]]
        assert r["s_turn"] == (yaw if r["t"] % 2 else lateral) and r["s_air"] == 0.0


def test_levels_and_turns(spark):
    angle = lambda i: 0.02 * (i % 11 - 5)
    rows = [("a", float(i), *(s * x for x in (math.cos(angle(i) / 2), math.sin(angle(i) / 2), 0.0, 0.0))) for i in range(99) for s in [1 if i % 3 else -1]]
    df = spark.createDataFrame(rows, "asset string, t double, w double, x double, y double, z double")
    want = sum(math.degrees(abs(angle(i))) for i in range(99)) / 99
    assert features.turn_spread(df, "asset", "t", ["w", "x", "y", "z"]).first()["spread"] == pytest.approx(want, rel=1e-3)
    rolls = spark.createDataFrame([("a", float(i), 0, float(i % 21 - 10)) for i in range(210)], "content_hash string, t double, axis int, roll double")
    fits = spark.createDataFrame([("a", 0, 0.5, 2.0, True)], "content_hash string, axis int, gain double, constant double, usable boolean")
    got = features.level_summary(rolls, fits).first()
    assert (got["n"], got["constant"], got["spread"], got["most"], got["worth"]) == (210, 2.0, 9.0, 5.0, True)


def test_framed_clip_follows_the_subject(spark):
    rows = [("a", i / 5, 0.3 + 0.4 * (i > 100) if i % 10 else None, 0.5) for i in range(200)]
    track = spark.createDataFrame(rows, "content_hash string, t double, u double, v double")
    cut = spark.createDataFrame([("a", 7, 15.0, 27.0), ("a", 8, 2.0, 5.0)], "content_hash string, clip int, t_in double, t_out double")
    got = framing.framed(track, cut, (1000, 600), 400).toPandas().sort_values(["clip", "t"])
    moved, still = got[got["clip"] == 7], got[got["clip"] == 8]
    assert moved["t"].min() == pytest.approx(15) and moved["t"].max() == pytest.approx(27) and len(moved) == 121
    # the subject goes from pixel 300 to 700: a crop of 400 follows it from about 100 to about 500, within the dead zone
    assert abs(moved["x"].iloc[0] - 100) <= 400 * framing.DEAD * 1.2 and abs(moved["x"].iloc[-1] - 500) <= 400 * framing.DEAD * 1.2
    assert still["x"].between(0, 600).all() and still["pan_p95"].iloc[0] < 0.05 and 0.85 < still["hits"].iloc[0] < 0.95


def test_ride_chapters_of_names(spark):
    got = spark.createDataFrame([("GX010603.MP4",)], "n string").select(ride_chapter(F.col("n")).alias("p")).first()["p"]
    assert (got["ride"], got["chapter"]) == ("0603", 1) and schema.segment().fieldNames()[0] == "id"
