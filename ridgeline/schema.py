"""Schemas of the engine's tables. Series have one superset schema; absent streams are NULL columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()])


def _many(kind: str, *names: str) -> dict[str, str]:
    return dict.fromkeys(names, kind)


def asset() -> T.StructType:
    return _struct(
        **_many("string", "content_hash", "filename", "source_path", "host", "ride_id"),
        chapter="int",
        bytes="bigint",
        duration_s="double",
        **_many("string", "container", "vcodec"),
        **_many("int", "width", "height"),
        aspect="string",
        fps="double",
        pix_fmt="string",
        **_many("int", "bit_depth", "rotation"),
        bitrate_bps="bigint",
        camera_model="string",
        **_many("timestamp", "recorded_at", "recorded_at_gps"),
        clock_drift_s="double",
        **_many("string", "style", "mount"),
        has_gpmd="boolean",
        streams="array<string>",
        **_many("double", "gps_lat", "gps_lon", "sun_elevation"),
        **_many("string", "lighting", "lighting_source"),
        horizon_locked="boolean",
        air_events="int",
        **_many("double", "air_total_s", "air_longest_s"),
        **_many("string", "proxy_path", "telemetry_path", "imu_path", "scores_path", "track_path", "archived_path"),
        **_many("timestamp", "archived_at", "first_seen"),
    )


def segment() -> T.StructType:
    return _struct(
        id="bigint",
        content_hash="string",
        **_many("double", "t_in", "t_out"),
        rank="int",
        score="double",
        dominant="string",
        features="map<string,double>",
        **_many("string", "status", "reason"),
        **_many("double", "t_in_user", "t_out_user"),
        decided_at="timestamp",
        stage_version="int",
    )


def render_job() -> T.StructType:
    return _struct(
        id="bigint",
        name="string",
        segment_ids="array<bigint>",
        level="boolean",
        frame="string",
        fps="double",
        **_many("string", "status", "step"),
        **_many("double", "done_s", "total_s"),
        **_many("string", "out_path", "error"),
        **_many("timestamp", "created_at", "started_at", "finished_at"),
    )


def stage_run() -> T.StructType:
    return _struct(content_hash="string", stage="string", stage_version="int", status="string", started_at="timestamp", finished_at="timestamp", error="string")


def telemetry() -> T.StructType:
    vectors = [f"{s}_{i}" for s in ("accl", "gyro", "grav") for i in range(3)]
    turns = [f"{s}_{i}" for s in ("cori", "iori") for i in "wxyz"]
    rest = ["shut", "isoe", "tmpc", "gps_lat", "gps_lon", "gps_alt", "gps_speed2d", "gps_speed3d", "gps_days", "gps_secs", "gps_dop", "gps_fix"]
    return _struct(content_hash="string", **_many("double", "t", *vectors, *turns, *rest))


def scores() -> T.StructType:
    return _struct(content_hash="string", **_many("double", "t", "yaw_rate", "speed_ms", "grade", "lat_accel", "rough", "air_s"))


def track() -> T.StructType:
    return _struct(content_hash="string", t="double", n_boxes="int", n_rejected="int", **_many("double", "x0", "y0", "x1", "y1", "score", "area"), track_id="int", pass2="int", u="double", v="double")
