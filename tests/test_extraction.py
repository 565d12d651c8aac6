"""From a file's bytes to tables: the choice of stream, names, times, fallbacks, the grid and the motion sensors."""

import struct

import numpy as np
import pytest

from ridgeline.operators import extraction
from ridgeline.sources import payloads


def item(key, kind, size, repeat, body):
    return key.encode() + struct.pack(">cBH", kind.encode() if kind else b"\0", size, repeat) + body + b"\0" * (-len(body) % 4)


def atom(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def nested(*items):
    body = b"".join(items)
    return item("STRM", None, 1, len(body), body)


def movie(path, devices, seconds=1001):
    """A file whose telemetry track has one payload for each list of streams."""
    chunks = [item("DEVC", None, 1, len(b"".join(s)), b"".join(s)) for s in devices]
    ftyp, data = atom(b"ftyp", b"mp41\0\0\0\0"), b"".join(chunks)
    at = len(ftyp) + 8
    n = len(chunks)
    stbl = atom(b"stsd", struct.pack(">II", 0, 1) + atom(b"gpmd", b"\0" * 8))
    stbl += atom(b"stsz", struct.pack(f">III{n}I", 0, 0, n, *map(len, chunks))) + atom(b"stco", struct.pack(">III", 0, 1, at))
    stbl += atom(b"stts", struct.pack(">IIII", 0, 1, n, seconds)) + atom(b"stsc", struct.pack(">IIIII", 0, 1, 1, n, 1))
    moov = atom(b"moov", atom(b"trak", atom(b"mdia", atom(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 1000, 0, 0)) + atom(b"minf", atom(b"stbl", stbl)))))
    path.write_bytes(ftyp + atom(b"mdat", data) + moov)
    return str(path)


def gps9(i, n=10, scale=True, layout=True):
    fields = [(515000000 + 100 * (n * i + j), -1000000, 12345, 2500, 2600, 9000, 3600000 + 100 * (n * i + j), 150, 3) for j in range(n)]
    body = b"".join(struct.pack(">7i2h", *f) for f in fields)
    scales = struct.pack(">9i", 10**7, 10**7, 1000, 1000, 1000, 1, 1000, 100, 1)
    said = [item("TYPE", "c", 1, 9, b"lllllllss")] if layout else []
    return nested(item("STMP", "J", 8, 1, struct.pack(">Q", 10**6 * i)), *said, *([item("SCAL", "l", 4, 9, scales)] if scale else []), item("GPS9", "?", 32, n, body))


def gps5(i, n=5):
    body = b"".join(struct.pack(">5i", 10**7, 2 * 10**7, 1000, 2000, 300) for _ in range(n))
    return nested(item("STMP", "J", 8, 1, struct.pack(">Q", 10**6 * i)), item("SCAL", "l", 20, 1, struct.pack(">5i", 10**7, 10**7, 1000, 1000, 100)), item("GPS5", "l", 20, n, body))


def motion(key, i, n=20):
    body = b"".join(struct.pack(">3h", 100 * i + j, -j, 50) for j in range(n))
    return nested(item("SCAL", "s", 2, 1, struct.pack(">h", 10)), item(key, "s", 6, n, body))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("movies")
    both = movie(folder / "both.mp4", [[gps5(i), gps9(i), motion("ACCL", i), motion("GYRO", i, 10)] for i in range(4)], 1000)
    old = movie(folder / "old.mp4", [[gps5(i)] for i in (0, 1, 2, 9)], 1000)
    shut = movie(folder / "shut.mp4", [[nested(item("SHUT", "f", 4, 30, struct.pack(">30f", *[i / 100] * 30)))] for i in range(2)], 1000)
    read = extraction.read_payloads(spark, [both, old, shut])
    return {"both": both, "old": old, "shut": shut}, [t.toPandas() for t in extraction.extract(read)]


def test_first_position_stream_is_chosen_and_named(tables):
    paths, (grid, _, streams) = tables
    both = grid[grid["content_hash"] == paths["both"]].sort_values("t").reset_index(drop=True)
    assert set(streams[streams["content_hash"] == paths["both"]]["key"]) == {"GPS9", "ACCL", "GYRO"}
    assert both["gps_fix"].dropna().eq(3).all() and both["gps_dop"].dropna().round(6).eq(1.5).all()
    assert both["gps_lat"][5] == pytest.approx(51.5 + 5e-5) and both["gps_secs"][12] == pytest.approx(3600 + 1.2)
    old = grid[grid["content_hash"] == paths["old"]]
    assert old["gps_speed3d"].dropna().round(6).eq(3.0).all() and old["gps_fix"].isna().all()
    assert dict(zip(streams["key"], streams["rate"], strict=True))["GPS9"] == pytest.approx(40 / 3.9, abs=0.05)


def test_position_is_not_drawn_across_gaps(tables):
    paths, (grid, _, _) = tables
    old = grid[grid["content_hash"] == paths["old"]].sort_values("t")
    missing = old[old["gps_lat"].isna()]["t"]
    # stamps 0, 1, 2 and 9: samples of the third payload are spread over seven seconds, so no gap is above five
    assert missing.empty and old["t"].max() > 9


def test_other_streams_have_the_tracks_times(tables):
    paths, (grid, imu, _) = tables
    own = imu[imu["content_hash"] == paths["both"]].sort_values("t").reset_index(drop=True)
    assert np.allclose(own["t"], np.arange(80) / 20)
    assert own["accl_0"][25] == pytest.approx((100 + 5) / 10) and own["accl_2"].eq(5).all()
    assert own["gyro_0"][22] == pytest.approx((100 + 1) / 10) and own["gyro_0"].notna().all()
    shut = grid[grid["content_hash"] == paths["shut"]].sort_values("t").reset_index(drop=True)
    assert shut["shut"][5] == 0 and shut["shut"][15] == pytest.approx(0.01) and shut["accl_0"].isna().all()


def test_fallbacks_of_layout_scale_and_width(tmp_path):
    rows = list(payloads.payload_rows(movie(tmp_path / "bare.mp4", [[gps9(0, scale=False, layout=False)], [gps9(1, layout=False)]]), ["GPS9"]))
    assert [r[4] for r in rows] == [10, 10] and rows[0][5][1] == pytest.approx([51.50001, -0.1, 12.345, 2.5, 2.6, 9000, 3600.1, 1.5, 3])
    assert payloads.read_scales(("l", 20, 1, struct.pack(">5i", 1, 2, 3, 4, 5))) == [1, 2, 3, 4, 5]
    assert payloads.read_scales(("s", 2, 3, struct.pack(">3h", 7, 8, 9))) == [7, 8, 9] and payloads.read_scales(("l", 4, 1, b"\0" * 4)) == []
    assert payloads.struct_format("?", 20, "wrong", "GPS5") == ">iiiii" and payloads.struct_format("l", 20, "zz") == ">iiiii"
    for bad in (("?", 21, None, "GPS5"), ("?", 12, None, "ACCL")):
        with pytest.raises(ValueError):
            payloads.struct_format(*bad)
    assert payloads.divisors([5.0, 6.0], 5, "GPS5").tolist() == [1e7, 1e7, 1000, 1000, 100]
    with pytest.raises(ValueError):
        payloads.divisors([5.0, 6.0], 3, "ACCL")


def test_unknown_numbers_of_fields_get_numbers(spark):
    rows = [("a", "CORI", 0, 0.0, None, 2, [[1.0, 2.0, 3.0], [1.0, float("nan"), 3.0]]), ("a", "GPS5", 0, 0.0, 0, 1, [[1.0] * 7])]
    df = spark.createDataFrame(rows, "content_hash string, key string, payload int, seconds double, stmp_us long, n int, samples array<array<double>>")
    got = {(r["name"], round(r["t"], 3)) for r in extraction.fields(df).collect()}
    assert {n for n, _ in got} == {"cori_0", "cori_1", "cori_2", *extraction.NAMES["GPS5", 7]} and ("cori_1", 0.5) not in got
