"""How far a picture is tilted, from its own edges.

A turned picture turns all its gradients. Their directions at four times the angle, summed with their lengths as weights,
point at what the picture is built on; four times, since upright and level edges say the same. Only the strongest fifth
of the gradients counts, and the picture is smoothed first, since differences of pixels bend angles of fine structure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA, SHARE, LEAST, SMALLEST = 1.0, 80.0, 200, 8


def smoothed(pictures: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Pictures (n, height, width) under a Gaussian cut at three sigma, along rows and then columns; beyond the edge is nothing."""
    reach = int(3 * sigma)
    if sigma <= 0 or not reach:
        return pictures
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    out = pictures
    for axis in (2, 1):
        wide = np.pad(out, [(reach, reach) if i == axis else (0, 0) for i in range(3)])
        out = sum(w * np.take(wide, np.arange(k, k + out.shape[axis]), axis=axis) for k, w in enumerate(bell / bell.sum()))
    return out


def tilts(pictures: np.ndarray, least: int = LEAST, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """(degrees, strength 0..1) of grey pictures (n, height, width) of one size: NaN and 0 for those that are too low or have too few edges."""
    n, height, width = pictures.shape
    if height < SMALLEST or width < 2:
        return np.full(n, np.nan), np.zeros(n)
    down, across = np.gradient(smoothed(pictures.astype(np.float64), sigma), axis=(1, 2))
    length = np.hypot(down, across).reshape(n, -1)
    strong = length >= np.percentile(length, SHARE, axis=1, keepdims=True)
    weight = np.where(strong, length, 0.0)
    total = weight.sum(axis=1)
    usable = (strong.sum(axis=1) >= least) & (total > 0)
    spun = (weight * np.exp(4j * np.arctan2(down, across).reshape(n, -1))).sum(axis=1) / np.where(total > 0, total, 1.0)
    return np.where(usable, np.degrees(np.angle(spun)) / 4, np.nan), np.where(usable, np.abs(spun), 0.0)


def tilt_column(pixels: Column, width: int, least: int = LEAST, sigma: float = SIGMA) -> Column:
    """struct(tilt, strength) of pictures as arrays of grey values or as bytes, row by row; null for null ones.

    tilt is null where a picture tells none. Pixels that don't fill a last row are left out. Pictures of a batch that
    have one size are worked on together.
    """

    @F.pandas_udf("tilt double, strength double")
    def found(batch: pd.Series) -> pd.DataFrame:
        own = [None if x is None else np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.asarray(x, dtype=np.float64) for x in batch]
        heights = np.array([-1 if x is None else len(x) // width for x in own])
        tilt, strength = np.full(len(own), np.nan), np.full(len(own), np.nan)
        for height in np.unique(heights[heights >= 0]).tolist():
            at = np.flatnonzero(heights == height)
            pictures = np.stack([own[i][: height * width] for i in at]).reshape(len(at), height, width)
            tilt[at], strength[at] = tilts(pictures, least, sigma)
        return pd.DataFrame({"tilt": tilt, "strength": strength})

    out = found(pixels)
    none = F.lit(None).cast("double")
    given = F.struct(F.when(~F.isnan(out["tilt"]), out["tilt"]).otherwise(none).alias("tilt"), out["strength"].alias("strength"))
    return F.when(pixels.isNotNull(), given)


def frame_tilts(frames: DataFrame, pixels: str, width: int, least: int = LEAST, sigma: float = SIGMA) -> DataFrame:
    """frames with tilt and strength in place of their pixels."""
    own = frames.withColumn("__tilt", tilt_column(F.col(pixels), width, least, sigma)).drop(pixels)
    return own.select("*", "__tilt.tilt", "__tilt.strength").drop("__tilt")
