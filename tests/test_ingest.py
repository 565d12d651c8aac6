"""Reading many files at once: parts of files, pushed filters, odd names, broken files, old catalogues, and checks of what was read."""

import struct
import warnings

import pytest
from pyspark.sql import functions as F

from ridgeline.__main__ import main
from ridgeline.library import Library
from ridgeline.operators import catalogue, checks, extraction
from ridgeline.sources import files, payloads

from .test_extraction import atom, gps5, gps9, item, motion, movie, nested


def seven(i, n=3):
    """A position stream of a number of fields that has no names."""
    return nested(item("STMP", "J", 8, 1, struct.pack(">Q", 10**6 * i)), item("SCAL", "l", 4, 1, struct.pack(">i", 10)), item("GPS5", "l", 24, n, struct.pack(">6i", *range(6)) * n))


@pytest.fixture(scope="module")
def long_movie(tmp_path_factory):
    """Layout and scales are told by the first payload only."""
    folder = tmp_path_factory.mktemp("parts")
    return movie(folder / "one, two.mp4", [[gps9(i, scale=i == 0, layout=i == 0), motion("ACCL", i)] for i in range(40)], 1000)


def test_parts_of_a_file_give_what_the_whole_gives(spark, long_movie):
    whole = extraction.read_payloads(spark, [long_movie])
    size = len(open(long_movie, "rb").read())
    for split in (1_000, 7_777, size + 1):
        parts = extraction.read_payloads(spark, [long_movie], sizes=[size], split=split)
        assert parts.rdd.getNumPartitions() == -(-size // split)
        assert sorted(parts.collect(), key=repr) == sorted(whole.collect(), key=repr)
    assert whole.count() == 80 and {r["content_hash"] for r in whole.collect()} == {long_movie}


def test_filters_go_into_the_reader(spark, long_movie, tmp_path):
    other = movie(tmp_path / "other.mp4", [[gps5(i)] for i in range(3)], 1000)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = extraction.read_payloads(spark, [long_movie, other])
        assert rows.where(F.col("content_hash") == other).count() == 3 and rows.where("key = 'ACCL'").count() == 40
        assert rows.where(F.col("key").isin("GPS5", "GPS9")).count() == 43 and rows.where("key = 'NONE'").count() == 0 and rows.where("n > 5").count() == 80
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    own = payloads.PushingReader([("a", None), ("b", None)], ["X", "Y"], 10, False)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(own.pushFilters([EqualTo(("path",), "b"), In(("key",), ("Y", "Z")), GreaterThan(("n",), 1)]))
    assert left == [GreaterThan(("n",), 1)] and [p.path for p in own.partitions()] == ["b"] and own.keys == ["Y"]


def test_durations_from_the_container(spark, tmp_path):
    def with_header(name, body):
        (tmp_path / name).write_bytes(atom(b"ftyp", b"mp41") + atom(b"moov", atom(b"mvhd", body)))
        return str(tmp_path / name)

    short = with_header("short.mp4", struct.pack(">IIIII", 0, 0, 0, 600, 7_500) + b"\0" * 80)
    wide = with_header("wide.mp4", struct.pack(">IQQIQ", 1 << 24, 0, 0, 1000, 90_500) + b"\0" * 80)
    none = with_header("none.mp4", struct.pack(">IIIII", 0, 0, 0, 0, 0))
    (tmp_path / "cut.mp4").write_bytes(atom(b"ftyp", b"mp41") + struct.pack(">I4s", 10_000, b"mdat") + b"x" * 50)
    df = spark.createDataFrame([(short,), (wide,), (none,), (str(tmp_path / "cut.mp4"),), (str(tmp_path / "gone.mp4"),)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: (r["container_s"], r["error"]) for r in files.probed(df).collect()}
    assert got["short.mp4"] == (12.5, None) and got["wide.mp4"] == (90.5, None) and got["none.mp4"] == (None, None)
    assert "no movie box" in got["cut.mp4"][1] and "gone.mp4" in got["gone.mp4"][1] and got["cut.mp4"][0] is None


def test_a_broken_file_fails_alone_and_is_tried_again(spark, tmp_path, capsys):
    videos = tmp_path / "videos"
    videos.mkdir()
    good = [[gps9(i), motion("ACCL", i), motion("GYRO", i)] for i in range(30)]
    movie(videos / "GX010001.MP4", good, 1000)
    movie(videos / "GX010002, copy.MP4", [[gps5(i)] for i in range(30)], 1000)
    broken = videos / "GX010003.MP4"
    movie(broken, [[gps9(i, n=11)] for i in range(30)], 1000)
    whole = broken.read_bytes()
    broken.write_bytes(whole[: len(whole) - 600])  # the index is gone
    bad = videos / "GX010004.MP4"
    body = bytearray(movie(bad, [[gps9(i, n=9)] for i in range(5)], 1000) and bad.read_bytes())
    at = body.find(b"stsz")
    body[at + 16 : at + 20] = struct.pack(">I", 1 << 30)  # the first payload is longer than the file
    bad.write_bytes(bytes(body))
    movie(videos / "GX010005.MP4", [[seven(i)] for i in range(5)], 1000)
    own = Library(spark, str(tmp_path / "root"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert own.ingest(str(videos)) == 3
    assert any("GPS5 has 6 fields in 1 file" in str(w.message) for w in said)
    failed = {r["filename"]: r["error"] for r in own.errors().collect()}
    assert set(failed) == {"GX010003.MP4", "GX010004.MP4"} and "no movie box" in failed["GX010003.MP4"] and "bytes" in failed["GX010004.MP4"]
    assert own.table("telemetry").select("content_hash").distinct().count() == 3
    assert {r["filename"]: r["has_gpmd"] for r in own.table("assets").collect()} == {"GX010001.MP4": True, "GX010002, copy.MP4": True, "GX010003.MP4": None, "GX010004.MP4": None, "GX010005.MP4": True}
    assert {r["filename"] for r in own.pending("telemetry").collect()} == set(failed)
    assert own.ingest(str(videos)) == 0 and own.errors().count() == 2
    broken.write_bytes(whole)  # it is another content now: read, and the old one stays failed
    assert own.ingest(str(videos)) == 1
    timing = {r["stage"]: r for r in own.timing().collect()}
    assert (timing["telemetry"]["runs"], timing["telemetry"]["failed"]) == (6, 2)
    # checks and moves of what was read
    found = {(r["filename"], r["metric"]): r["verdict"] for r in own.verify().collect()}
    assert found["GX010001.MP4", "gps_fix"] == "ok" and found["GX010001.MP4", "GRAV"] == "missing" and found["GX010005.MP4", "GPS"].startswith("the stream is there")
    assert found["GX010004.MP4", "telemetry"].startswith("no telemetry") and own.verify("GX010001").select("filename").distinct().count() == 1
    elsewhere = tmp_path / "elsewhere"
    videos.rename(elsewhere)
    states = {r["state"] for r in own.relink(str(elsewhere)).collect()}
    assert states == {"found", "missing"} and all("/elsewhere/" in r["source_path"] for r in own.table("assets").where("filename = 'GX010001.MP4'").collect())
    assert own.retime().where("recorded_at_gps is not null").count() >= 1
    for command in (["verify", own.root], ["verify", own.root, "GX010001"], ["errors", own.root], ["timing", own.root], ["relink", own.root, str(elsewhere)], ["retime", own.root], ["level", own.root], ["migrate", own.root]):
        assert main(command) == 0
    assert "was at version 2" in capsys.readouterr().out


def test_an_old_catalogue_is_brought_up_to_date(spark, tmp_path):
    own = Library(spark, str(tmp_path))
    old = spark.createDataFrame([("h1", "GX020603.MP4", None, None, 10), ("h2", "holiday.mp4", None, None, 11), ("h3", "GX010604.MP4", "by hand", 7, 12)], "content_hash string, filename string, ride_id string, chapter int, bytes int")
    own.replace("assets", old.withColumn("gone", F.lit(1)))
    assert own.migrate() == 0 and own.migrate() == 2
    rows = {r["content_hash"]: r for r in own.table("assets").collect()}
    assert (rows["h1"]["ride_id"], rows["h1"]["chapter"]) == ("0603", 2) and rows["h2"]["ride_id"] is None and (rows["h3"]["ride_id"], rows["h3"]["chapter"]) == ("by hand", 7)
    assert dict(own.table("assets").dtypes)["bytes"] == "bigint" and "horizon_locked" in own.table("assets").columns and "gone" not in own.table("assets").columns
    assert Library(spark, str(tmp_path / "new")).migrate() == 0


def test_two_tables_take_their_places_together(spark, tmp_path):
    path = str(tmp_path / "calibration")
    one, two = spark.range(3), spark.range(5)
    files.save_calibration(one, two, path)
    assert [x.count() for x in files.load_calibration(spark, path)] == [3, 5]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division by zero"):
        files.save_calibration(two, spark.range(1).select(F.expr("raise_error('Division by zero')")), path)
    assert [x.count() for x in files.load_calibration(spark, path)] == [3, 5]


@pytest.mark.parametrize(
    ("metric", "value", "verdict"),
    [("accl_mean", 9.81, "ok"), ("accl_mean", 9.0, "suspect"), ("accl_mean", 13.0, "suspect"), ("grav_mean", 1.0, "ok"), ("grav_mean", 1.1, "suspect"), ("gps_fix", 0.81, "ok"), ("gps_fix", 0.8, "sparse"),
     ("gps_lock", 0.9, "ok"), ("gps_lock", 0.5, "partial"), ("speed_p95", 8.0, "ok"), ("speed_p95", 0.5, "suspect"), ("speed_p95", 20.0, "suspect"), ("roll_suppression", 0.6, "levelled in"), ("roll_suppression", 0.3, "partly"), ("roll_suppression", 0.15, "not levelled")],
)
def test_thresholds(spark, metric, value, verdict):
    assert spark.createDataFrame([(metric, value)], "metric string, value double").select(checks.verdict()).first()[0].startswith(verdict)


def test_measures(spark):
    rows = [("a", 3.0, 4.0, 0.0, 0.0, 1.0, 0.0, 51.5 if i % 2 else None, -0.1, float(i), 3.0 if i else 0.0) for i in range(10)] + [("b", None, None, None, float("nan"), 1.0, 0.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "content_hash string, accl_0 double, accl_1 double, accl_2 double, grav_0 double, grav_1 double, grav_2 double, gps_lat double, gps_lon double, gps_speed2d double, gps_fix double")
    got = {(r["content_hash"], r["metric"]): r["value"] for r in checks.measures(df).collect()}
    assert got == pytest.approx({("a", "accl_mean"): 5.0, ("a", "grav_mean"): 1.0, ("a", "gps_fix"): 0.5, ("a", "gps_lock"): 0.9, ("a", "speed_p50"): 4.5, ("a", "speed_p95"): 8.55})
    assert catalogue.in_schema(df.limit(0), df.schema).columns == df.columns
