"""Zero-phase Butterworth filters without scipy, roughness and turn rate per second, and spectral bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def butterworth(order: int, edges: float | tuple[float, float], rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a low-pass (one edge) or band-pass (two) filter.

    Analogue prototype poles on the unit circle, moved to the prewarped edges, through the bilinear transform.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if np.isscalar(edges):
        analogue, zeros = poles * warp(edges), np.full(order, -1.0)
        at = 1.0  # unit gain at rest
    else:
        lo, hi = map(warp, edges)
        half = poles * (hi - lo) / 2
        root = np.sqrt(half**2 - lo * hi)
        analogue, zeros = np.r_[half + root, half - root], np.r_[np.ones(order), -np.ones(order)]
        at = np.exp(2j * np.arctan(np.sqrt(lo * hi) / (2 * rate)))  # unit gain at the centre
    digital = (2 * rate + analogue) / (2 * rate - analogue)
    upper = sorted((p for p in digital if p.imag > 1e-12), key=lambda p: -abs(p))
    real = sorted(p.real for p in digital if abs(p.imag) <= 1e-12)
    pairs = [(p, p.conjugate()) for p in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    ones, minus = int((zeros > 0).sum()), int((zeros < 0).sum())
    sections = []
    for pair in pairs:
        own = [1.0] * min(ones, 1) + [-1.0] * min(minus, 1)
        ones, minus = ones - min(ones, 1), minus - min(minus, 1)
        while len(own) < len(pair) and minus:
            own, minus = [*own, -1.0], minus - 1
        own = own[: len(pair)]
        b, a = np.real(np.poly(own)), np.real(np.poly(pair))
        b, a = np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))
        gain = np.polyval(a, at) / np.polyval(b, at) if len(pair) == 2 else (a[0] * at + a[1]) / (b[0] * at + b[1])
        sections.append(np.r_[b * abs(gain), a])
    return np.array(sections)


def _settled(section: np.ndarray) -> np.ndarray:
    """The state of a section that has long been fed ones."""
    b, a = section[:3], section[3:]
    y = b.sum() / a.sum()
    z1 = b[2] - a[2] * y
    return np.array([b[1] - a[1] * y + z1, z1])


def _run(section: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 64) -> np.ndarray:
    """One section over x, block by block: inside a block the response is a matrix product."""
    b, a = section[:3], section[3:]
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(powers[-1] @ step)
    free = np.array([p[0] for p in powers[:block]])  # output of a unit state
    impulse = np.r_[b[0], [(powers[k] @ into)[0] for k in range(block - 1)]]
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    drive = np.array([powers[block - 1 - k] @ into for k in range(block)])
    out, whole = np.empty(len(x)), len(x) // block * block
    for i in range(0, whole, block):
        part = x[i : i + block]
        out[i : i + block] = response @ part + free @ state
        state = powers[block] @ state + part @ drive
    for i in range(whole, len(x)):
        out[i] = b[0] * x[i] + state[0]
        state = step @ state + into * x[i]
    return out


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards, with odd extension at the ends and settled initial states."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    for _ in range(2):
        for s in sections:
            y = _run(s, y, _settled(s) * y[0])
        y = y[::-1]
    return y[pad : len(y) - pad]


def rate_of(t: np.ndarray) -> float:
    return (len(t) - 1) / max(t[-1] - t[0], 1e-6) if len(t) > 1 else 0.0


def per_second(t: np.ndarray, v: np.ndarray, least: int, how: str) -> pd.DataFrame:
    second = np.floor(t).astype(np.int64)
    table = pd.DataFrame({"second": second, "v": v * v if how == "rms" else np.abs(v)}).groupby("second")["v"].agg(["mean", "size"])
    table = table[table["size"] >= least]
    return pd.DataFrame({"t": table.index.to_numpy(float), "value": np.sqrt(table["mean"]).to_numpy() if how == "rms" else table["mean"].to_numpy()})


def roughness_of(t: np.ndarray, accl: np.ndarray) -> pd.DataFrame:
    """RMS per second of the 5 to 40 Hz band of the acceleration's magnitude."""
    none = pd.DataFrame({"t": [], "value": []})
    mag = np.sqrt((accl**2).sum(axis=1))
    bad = ~np.isfinite(mag)
    if len(t) < 64 or (rate := rate_of(t)) < 80 or bad.mean() > 0.02:
        return none
    if bad.any():
        mag[bad] = np.interp(t[bad], t[~bad], mag[~bad])
    return per_second(t, zero_phase(butterworth(4, (5.0, 40.0), rate), mag - mag.mean()), 9, "rms")


def turn_rate_of(t: np.ndarray, gyro: np.ndarray, grav: np.ndarray) -> pd.DataFrame:
    """Mean absolute rate of turn about the vertical per second: projected, low-passed at 1 Hz, and only then rectified."""
    ok = np.isfinite(gyro).all(axis=1) & np.isfinite(grav).all(axis=1)
    if ok.sum() < 64:
        return pd.DataFrame({"t": [], "value": []})
    t, gyro, grav = t[ok], gyro[ok], grav[ok]
    length = np.sqrt((grav**2).sum(axis=1))
    up = np.divide(grav, length[:, None], out=np.zeros_like(grav), where=length[:, None] > 1e-9)
    yaw = (gyro * up).sum(axis=1)
    if (rate := rate_of(t)) > 2.5:
        yaw = zero_phase(butterworth(2, 1.0, rate), yaw)
    return per_second(t, yaw, 1, "abs")


def roughness(imu: DataFrame, asset: str = "content_hash") -> DataFrame:
    """(asset, t, value) from imu(asset, t, accl_0..2)."""

    def kernel(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        out = roughness_of(g["t"].to_numpy(float), g[["accl_0", "accl_1", "accl_2"]].to_numpy(float))
        out.insert(0, asset, key[0])
        return out

    own = imu.select(asset, "t", "accl_0", "accl_1", "accl_2")
    return own.groupBy(asset).applyInPandas(kernel, f"{asset} {dict(own.dtypes)[asset]}, t double, value double")


def turn_rate(imu: DataFrame, asset: str = "content_hash") -> DataFrame:
    """(asset, t, value) from imu(asset, t, gyro_0..2, grav_0..2), the gravity being on the gyroscope's clock."""

    def kernel(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        out = turn_rate_of(g["t"].to_numpy(float), g[[f"gyro_{i}" for i in range(3)]].to_numpy(float), g[[f"grav_{i}" for i in range(3)]].to_numpy(float))
        out.insert(0, asset, key[0])
        return out

    own = imu.select(asset, "t", *[f"{s}_{i}" for s in ("gyro", "grav") for i in range(3)])
    return own.groupBy(asset).applyInPandas(kernel, f"{asset} {dict(own.dtypes)[asset]}, t double, value double")


def band_power(t: np.ndarray, v: np.ndarray, bands: list[tuple[float, float]]) -> list[float]:
    """Power of a Hann-windowed spectrum within each band [lo, hi)."""
    n = len(v)
    if n < 8:
        return [float("nan")] * len(bands)
    spectrum = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(n))) ** 2
    f = np.fft.rfftfreq(n, 1 / rate_of(t))
    return [float(spectrum[(f >= lo) & (f < hi)].sum()) for lo, hi in bands]


def bands(df: DataFrame, asset: str, value: str, edges: list[tuple[float, float]]) -> DataFrame:
    """(asset, band, power, share) of df(asset, t, value)."""

    def kernel(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").dropna()
        p = np.array(band_power(g["t"].to_numpy(float), g[value].to_numpy(float), edges)) if len(g) else np.full(len(edges), np.nan)
        total = np.nansum(p)
        return pd.DataFrame({asset: key[0], "band": range(len(edges)), "power": p, "share": p / total if total > 0 else np.nan})

    own = df.select(asset, "t", value)
    return own.groupBy(asset).applyInPandas(kernel, f"{asset} {dict(own.dtypes)[asset]}, band int, power double, share double")
