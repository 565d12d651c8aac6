"""One subject through frames of detections: constant velocity, corrected by an alpha-beta filter.

Confident boxes are matched first, weak ones only if no confident one is inside the gate. After a gap the subject
counts as a new one. The state is small and serialisable, so the same code runs over a group or over a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

GATE, GAP = 0.25, 2.0
ALPHA, BETA = 0.6, 0.25
CONFIDENT, SCORE_BONUS, SIZE_PENALTY = 0.30, 0.20, 0.35
SIZE_KEPT = 0.6

SCHEMA = "t double, n_boxes int, n_rejected int, x0 double, y0 double, x1 double, y1 double, score double, area double, track_id int, pass2 int, u double, v double"


@dataclass
class Tracker:
    hz: float = 5.0
    track: int = 0
    seen_at: float | None = None
    at: list[float] = field(default_factory=list)  # u, v; empty without a subject
    speed: list[float] = field(default_factory=lambda: [0.0, 0.0])
    width: float = 0.0

    def step(self, t: float, boxes: list, rejected: int = 0) -> tuple:
        """A row of SCHEMA for the boxes (x0, y0, x1, y1, score) of one frame."""
        since = None if self.seen_at is None else t - self.seen_at
        if since is not None and since > GAP:
            self.at, since = [], None
        known = bool(self.at) and since is not None
        match = self._match(boxes, since) if known else self._strongest(boxes)
        if match is None:
            return (t, len(boxes), rejected, *[None] * 6, self.track, 0, None, None)
        (x0, y0, x1, y1, score), second = match
        u, v, w, h = (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0
        if known:
            gone = since or 1 / self.hz
            ahead = [p + s * since for p, s in zip(self.at, self.speed, strict=True)]
            miss = [u - ahead[0], v - ahead[1]]
            self.at = [a + ALPHA * m for a, m in zip(ahead, miss, strict=True)]
            self.speed = [s + BETA * m / gone for s, m in zip(self.speed, miss, strict=True)]
            self.width = SIZE_KEPT * self.width + (1 - SIZE_KEPT) * w
        else:
            self.track += 1
            self.at, self.speed, self.width = [u, v], [0.0, 0.0], w
        self.seen_at = t
        return (t, len(boxes), rejected, x0, y0, x1, y1, score, w * h, self.track, second, u, v)

    @staticmethod
    def _strongest(boxes: list) -> tuple | None:
        return (max(boxes, key=lambda b: b[4]), 0) if boxes else None

    def _match(self, boxes: list, since: float) -> tuple | None:
        gate = GATE * (1 + min(since, GAP) / GAP)
        ahead = [p + s * since for p, s in zip(self.at, self.speed, strict=True)]
        inside = []
        for b in boxes:
            gap = math.hypot((b[0] + b[2]) / 2 - ahead[0], (b[1] + b[3]) / 2 - ahead[1])
            if gap <= gate:
                change = abs(math.log(max(b[2] - b[0], 1e-6) / max(self.width, 1e-6)))
                inside.append((gap / gate - SCORE_BONUS * b[4] + SIZE_PENALTY * change, b))
        if sure := [x for x in inside if x[1][4] >= CONFIDENT]:
            return min(sure, key=lambda x: x[0])[1], 0
        return (min(inside, key=lambda x: x[0])[1], 1) if inside else None


def follow(frames: Iterable[tuple[float, list, int]], hz: float = 5.0) -> Iterator[tuple]:
    own = Tracker(hz)
    return (own.step(*f) for f in frames)


def track(frames: DataFrame, asset: str = "content_hash", hz: float = 5.0) -> DataFrame:
    """Tracks from frames(asset, t, boxes array<struct<x0,y0,x1,y1,score>>, rejected)."""
    kind = dict(frames.dtypes)[asset]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def kernel(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        boxes = [[tuple(float(b[k]) for k in ("x0", "y0", "x1", "y1", "score")) for b in (x if x is not None else [])] for x in g["boxes"]]
        out = pd.DataFrame(list(follow(zip(g["t"].astype(float), boxes, g["rejected"].astype(int), strict=True), hz)), columns=names)
        out.insert(0, asset, key[0])
        return out

    return frames.select(asset, "t", "boxes", "rejected").groupBy(asset).applyInPandas(kernel, f"{asset} {kind}, {SCHEMA}")


