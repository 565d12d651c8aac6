"""Streaming forms: extensions over the batch engine, which has no stream of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ridgeline.kernels.tracker import SCHEMA, Tracker

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values by type in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


FRAME = "at long, t double, boxes array<struct<x0:double,y0:double,x1:double,y1:double,score:double>>, rejected int"
SUBJECT = "track int, seen_at double, u double, v double, du double, dv double, width double, last long"
#: Where Spark keeps the state of processors like this one.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Following(StatefulProcessor):
    """One asset's tracker between batches. Frames wait until the watermark has passed them, and are then taken in order of
    time, whatever order they came in; an asset that is silent for long enough is forgotten."""

    def __init__(self, asset: str, hz: float, idle_s: float):
        self.asset, self.hz, self.idle_ms = asset, hz, int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.subject, self.waiting = handle.getValueState("subject", SUBJECT), handle.getListState("waiting", FRAME)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for g in rows:
            for ts, t, boxes, rejected in g[["ts", "t", "boxes", "rejected"]].itertuples(index=False):
                own = [tuple(float(b[k]) for k in ("x0", "y0", "x1", "y1", "score")) for b in (boxes if boxes is not None else [])]
                new.append((int(pd.Timestamp(ts).timestamp() * 1000), float(t), own, int(rejected)))
        if new:
            self.waiting.appendList(new)
            for at in {min(x[0] for x in new), max(x[0] for x in new)}:  # what lies between them waits for the later one
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(((at, t, [tuple(b) for b in boxes], n) for at, t, boxes, n in self.waiting.get()), key=lambda x: (x[0], x[1])) if self.waiting.exists() else []
        ready, rest = [x for x in held if x[0] <= mark], [x for x in held if x[0] > mark]
        if not ready:
            if not rest and self.subject.exists() and self.subject.get()[7] + self.idle_ms <= mark:
                self.subject.clear()  # silent for long enough: forgotten
            return
        own = Tracker(self.hz)
        if self.subject.exists():
            track, seen, u, v, du, dv, width, _ = self.subject.get()
            own = Tracker(self.hz, track, seen, [] if u is None else [u, v], [du, dv], width)
        out = [own.step(t, boxes, rejected) for _, t, boxes, rejected in ready]
        at = own.at or [None, None]
        self.subject.update((own.track, own.seen_at, at[0], at[1], own.speed[0], own.speed[1], own.width, ready[-1][0]))
        if rest:
            self.waiting.clear()
            self.waiting.appendList(rest)
        else:
            self.waiting.clear()
        self.handle.registerTimer(ready[-1][0] + self.idle_ms)
        table = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        table.insert(0, self.asset, key[0])
        yield table

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, asset: str = "asset", hz: float = 5.0, late: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """The tracker over a stream of frames(asset, ts, t, boxes, rejected): ts is a frame's time on the stream's clock, t its second.

    A row a frame, once the watermark has passed it; frames later than that are dropped. An asset without frames for idle_s
    is forgotten with its state: what comes after is a new recording, whose tracks count from 1. State is bounded by the frames
    between two watermarks. The session needs the settings in ROCKS.
    """
    kind = dict(frames.dtypes)[asset]
    own = frames.select(asset, "ts", "t", "boxes", "rejected").withWatermark("ts", late)
    return own.groupBy(asset).transformWithStateInPandas(Following(asset, hz, idle_s), f"{asset} {kind}, {SCHEMA}", "append", "EventTime")
