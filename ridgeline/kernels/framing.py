"""Smooth crop paths: a penalised path that moves only when the subject leaves a dead zone.

A path z of a clip minimises the half of

    dt * sum(weight * (gap(z, target - dead, target + dead)**2 + ANCHOR * (z - target)**2))
    + z' P z + BOUND * sum(gap(z, low, high)**2),

gap(x, a, b) being how far x is from [a, b] and P the penalty on velocity and acceleration. Its gradient is linear in
pieces, so Newton's method ends when no sample changes its piece. The Hessian is P, which is pentadiagonal, plus a
diagonal. Clips of like lengths are stacked, and one factorisation goes through all of them at once; short ones are
filled up with rows of the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.numbers import rotate_offset

DEAD, VELOCITY, ACCELERATION = 0.12, 0.02, 0.01
ANCHOR, BOUND, ROUNDS, SETTLED = 1e-5, 1.0e4, 24, 1e-5
HZ, PAD = 10.0, 2.0
#: Numbers of one stack at most, unless a single clip has more; and how much longer than its shortest clip a stack's longest may be.
STACK, ALIKE = 1 << 20, 1.5


def stacked_penalties(sizes: np.ndarray, dt: float, velocity: float, acceleration: float) -> np.ndarray:
    """Diagonals 0, 1, 2 of velocity D1'D1 / dt + acceleration D2'D2 / dt**3 for paths of those sizes, as (3, longest, paths)."""
    n = int(sizes.max(initial=0))
    out = np.zeros((3, n, len(sizes)))
    for stencil, scale in ((np.array([-1.0, 1.0]), velocity / dt), (np.array([1.0, -2.0, 1.0]), acceleration / dt**3)):
        width = len(stencil)
        if n < width:
            continue
        whole = np.arange(n - width + 1)[:, None] + width <= sizes  # differences within the path
        for i in range(width):
            for j in range(i, width):
                out[j - i, i : i + len(whole)] += scale * stencil[i] * stencil[j] * whole
    return out


def penalty_bands(n: int, dt: float, velocity: float = VELOCITY, acceleration: float = ACCELERATION) -> np.ndarray:
    """The diagonals of one path of n samples."""
    return stacked_penalties(np.array([n]), dt, velocity, acceleration)[:, :, 0]


def solve_banded(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """x with A x = rhs for symmetric positive definite A of those three diagonals, along the first axis; others are stacked."""
    n = len(rhs)
    pivots, x = np.empty_like(rhs, dtype=float), np.array(rhs, dtype=float)
    below = np.zeros((2, n + 2, *rhs.shape[1:]))  # the factor's diagonals: row i to rows i - 1 and i - 2
    for i in range(n):
        pivots[i] = bands[0, i]
        if i > 1:
            below[1, i] = bands[2, i - 2] / pivots[i - 2]
            pivots[i] -= below[1, i] * bands[2, i - 2]
            x[i] -= below[1, i] * x[i - 2]
        if i > 0:
            across = bands[1, i - 1] - below[0, i - 1] * (bands[2, i - 2] if i > 1 else 0.0)
            below[0, i] = across / pivots[i - 1]
            pivots[i] -= below[0, i] * across
            x[i] -= below[0, i] * x[i - 1]
    x /= pivots
    for i in range(n - 2, -1, -1):
        x[i] -= below[0, i + 1] * x[i + 1]
        if i + 2 < n:
            x[i] -= below[1, i + 2] * x[i + 2]
    return x


@dataclass
class Path:
    z: np.ndarray
    rounds: int
    violation: float
    saturated: float


def stacked_paths(targets: list[np.ndarray], weights: list[np.ndarray], dt: float, low: float, high: float, dead: float, velocity: float, acceleration: float) -> list[Path]:
    """The paths of several clips, none of them empty, within finite or infinite bounds."""
    sizes = np.array([len(x) for x in targets])
    shape = (int(sizes.max()), len(sizes))
    inside = np.arange(shape[0])[:, None] < sizes
    target, pull = np.zeros(shape), np.zeros(shape)
    target.T[inside.T] = np.concatenate(targets)
    pull.T[inside.T] = np.concatenate(weights) * dt
    fixed = stacked_penalties(sizes, dt, velocity, acceleration)
    z = np.clip(target, low, high)
    rounds, going = np.zeros(len(sizes), dtype=int), np.arange(len(sizes))
    while len(going):
        own, aim, p = z[:, going], target[:, going], pull[:, going]
        far, beyond = own - np.clip(own, aim - dead, aim + dead), own - np.clip(own, low, high)
        bands = fixed[:, :, going]
        slope = bands[0] * own + p * (far + ANCHOR * (own - aim)) + BOUND * beyond
        for k in (1, 2):
            slope[:-k] += bands[k][:-k] * own[k:]
            slope[k:] += bands[k][:-k] * own[:-k]
        bands[0] += p * ((far != 0) + ANCHOR) + BOUND * (beyond != 0) + ~inside[:, going]
        step = solve_banded(bands, np.where(inside[:, going], -slope, 0.0))
        z[:, going] = own + step
        rounds[going] += 1
        going = going[(np.abs(step).max(axis=0) >= SETTLED) & (rounds[going] < ROUNDS)]
    out = []
    for i, n in enumerate(sizes):
        free = z[:n, i]
        kept = np.clip(free, low, high)
        at_edge = np.isclose(kept, low) | np.isclose(kept, high)
        out.append(Path(kept, int(rounds[i]), float(np.abs(kept - free).max()), float(at_edge.mean())))
    return out


def solve_paths(targets: list[np.ndarray], weights: list[np.ndarray], dt: float, low: float = -np.inf, high: float = np.inf, dead: float = DEAD, velocity: float = VELOCITY, acceleration: float = ACCELERATION) -> list[Path]:
    """The crop's path in each clip, in its target's units. Bounds count if both are finite; equal ones leave no choice."""
    if not (np.isfinite(low) and np.isfinite(high)):
        low, high = -np.inf, np.inf
    elif high <= low:
        return [Path(np.full(len(x), low), 0, 0.0, float(len(x) > 0)) for x in targets]
    out = [Path(np.zeros(0), 0, 0.0, 0.0) for _ in targets]
    stack: list[int] = []
    for i in [*sorted((i for i, x in enumerate(targets) if len(x)), key=lambda i: len(targets[i])), None]:
        if stack and (i is None or len(targets[i]) > ALIKE * len(targets[stack[0]]) or len(targets[i]) * (len(stack) + 1) > STACK):
            for j, path in zip(stack, stacked_paths([targets[j] for j in stack], [weights[j] for j in stack], dt, low, high, dead, velocity, acceleration), strict=True):
                out[j] = path
            stack = []
        stack.append(i)
    return out


def solve_path(target: np.ndarray, weight: np.ndarray, dt: float, low: float = -np.inf, high: float = np.inf, **penalties: float) -> Path:
    """The path of a single clip."""
    return solve_paths([target], [weight], dt, low, high, **penalties)[0]


def by_clip(frames: Iterator[pd.DataFrame], clip: str) -> Iterator[list[pd.DataFrame]]:
    """The rows of whole clips, some at a time, from frames that are sorted by clip."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame[clip]
        first = key.iloc[0]
        if held and not (first == (last := held[-1][clip].iloc[0]) or (pd.isna(first) and pd.isna(last))):
            yield [pd.concat(held)]
            held = []
        new = (key != key.shift()) & ~(key.isna() & key.shift().isna())
        parts = [x for _, x in frame.groupby(new.cumsum().to_numpy(), sort=False)]
        if len(parts) > 1:
            yield [pd.concat([*held, parts[0]]), *parts[1:-1]]
            held = []
        held.append(parts[-1])
    if held:
        yield [pd.concat(held)]


def crop_paths(aims: DataFrame, clip: str, low: float, high: float, hz: float = HZ) -> DataFrame:
    """(clip, t, z, rounds, saturated, violation) from aims(clip, t, target, weight), on an even grid of hz.

    A task reads its clips in order and solves those of a batch together. A clip's rows are held at once; nulls are refused.
    """
    kind = dict(aims.dtypes)[clip]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for clips in by_clip(frames, clip):
            paths = solve_paths([g["target"].to_numpy(float) for g in clips], [g["weight"].to_numpy(float) for g in clips], 1 / hz, low, high)
            sizes = [len(g) for g in clips]
            more = {"z": np.concatenate([p.z for p in paths])} | {name: np.repeat([getattr(p, name) for p in paths], sizes) for name in ("rounds", "saturated", "violation")}
            yield pd.concat(clips)[[clip, "t"]].reset_index(drop=True).assign(**more)

    own = aims.select(clip, F.col("t").cast("double").alias("t"), "target", "weight").repartition(clip).sortWithinPartitions(clip, "t")
    return own.mapInPandas(kernel, f"{clip} {kind}, t double, z double, rounds int, saturated double, violation double")


def framed(track: DataFrame, clips: DataFrame, frame: tuple[int, int], crop: int, asset: str = "content_hash", applied_deg: float = 0.0) -> DataFrame:
    """(clip, t, x, hits, n, rejected, held, pan_p50, pan_p95, saturated, violation_px): where the crop's left edge stands in each clip.

    track(asset, t, u, v) has box centres as shares of the frame, null where there is none; clips(asset, clip, t_in, t_out). Each
    clip is solved with two seconds around it, which are then left out, in crop widths, and given in pixels. hits is the share
    of its n frames with a box, rejected the boxes that were none (track's n_rejected, if it has it), held that of path points within the dead zone of their aim, pan the speed in crop widths a second.
    """
    from ridgeline.operators import intervals, series

    width, height = frame
    du, dv = (F.col("u") - 0.5) * width, (F.coalesce("v", F.lit(0.5)) - 0.5) * height
    at = width / 2 + (rotate_offset(du, dv, F.lit(applied_deg)) if applied_deg else du)
    spans = clips.select(asset, "clip", F.col("t_in").cast("double").alias("t_in"), F.col("t_out").cast("double").alias("t_out"))
    rejected = (F.col("n_rejected") if "n_rejected" in track.columns else F.lit(None)).cast("long").alias("n_rejected")
    seen = intervals.slices(track.select(asset, "t", ((at - crop / 2) / crop).alias("z"), rejected), spans, asset, "t", "clip", "t_in", "t_out", PAD)
    seen = seen.join(spans.select("clip", "t_in", "t_out"), "clip")
    hits = seen.where(F.col("t").between(F.col("t_in"), F.col("t_out"))).groupBy("clip").agg(F.avg(F.col("z").isNotNull().cast("double")).alias("hits"), F.count("*").alias("n"), F.sum("n_rejected").alias("rejected"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.round((F.col("t_out") - F.col("t_in") + 2 * PAD) * HZ).cast("long")))
    grid = spans.select("clip", (F.col("t_in") - PAD).alias("__from"), step.alias("__i")).select("clip", (F.col("__from") + F.col("__i") / HZ).alias("t"))
    # a sighting counts for the grid point that is nearest, within a step
    known = seen.where("z is not null").select("clip", "t", "z")
    centre = (width - crop) / 2 / crop
    aims = series.hold_then_ease(series.nearest(grid, known, "clip", "z", 1 / HZ), "clip", "t", "z", centre)
    solved = crop_paths(aims, "clip", 0.0, (width - crop) / crop).join(aims.select("clip", "t", "target"), ["clip", "t"]).join(spans.drop(asset), "clip")
    inside = solved.where((F.col("t") >= F.col("t_in") - 1e-9) & (F.col("t") <= F.col("t_out") + 1e-9))
    speed = F.abs(F.col("z") - F.lag("z").over(W.partitionBy("clip").orderBy("t"))) * HZ
    paths = inside.withColumn("__pan", speed)
    report = paths.groupBy("clip").agg(
        F.avg((F.abs(F.col("z") - F.col("target")) <= DEAD + 1e-9).cast("double")).alias("held"), F.percentile("__pan", F.lit(0.5)).alias("pan_p50"), F.percentile("__pan", F.lit(0.95)).alias("pan_p95"),
    )
    out = paths.join(report, "clip").join(hits, "clip", "left")
    return out.select("clip", "t", (F.col("z") * crop).alias("x"), F.coalesce("hits", F.lit(0.0)).alias("hits"), F.coalesce("n", F.lit(0)).alias("n"), "rejected", "held", "pan_p50", "pan_p95", "saturated", (F.col("violation") * crop).alias("violation_px"))


def command_script(t: np.ndarray, x: np.ndarray, start: float, stop: float, what: str, hz: float = 50.0) -> str:
    """One line a step of 1/hz: the even-valued path, sampled at the middle of the step."""
    at = np.arange(start, stop, 1 / hz)
    values = np.rint(np.interp(at + 0.5 / hz, t, x)).astype(int) & ~1
    return "".join(f"{a - start:.3f} {what} {v};\n" for a, v in zip(at, values, strict=True))
