"""The queries that SQL cannot express, against plain versions of their own: direct sums, dense matrices, simple loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import plans
from ridgeline.kernels import filters, framing, tracker
from ridgeline.operators import decisions, series
from ridgeline.plans import mapping, selection

#: test_oracles.py asks that every query without SQL is named here.
COVERED = {"sampled_hash", "spectral_bands", "roughness", "turn_rate", "track_follow", "deadzone_path", "fit_evaluate"}


def samples(spark, sf_dir):
    """{asset: (t, value, k)} in the order of t."""
    rows = mapping.samples(spark, sf_dir).select("asset", "t", "value", "k").toPandas().sort_values(["asset", "t"])
    return {a: tuple(g[c].to_numpy(float) for c in ("t", "value", "k")) for a, g in rows.groupby("asset")}


def test_sampled_hash(spark, sf_dir):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in plans.QUERIES["sampled_hash"](spark, sf_dir).collect():
        x, n = texts[r["doc_id"]], len(texts[r["doc_id"]])
        body = x if n <= 300 else x[:100] + x[(n - 100) // 2 : (n - 100) // 2 + 100] + x[-100:]
        assert r["hash"] == "s3b2_" + hashlib.blake2b(str(n).encode() + body, digest_size=16).hexdigest()


def test_spectral_bands(spark, sf_dir):
    got = {(r["asset"], r["band"]): (r["power"], r["share"]) for r in plans.QUERIES["spectral_bands"](spark, sf_dir).collect()}
    edges, seen = [(0.5, 3.0), (3.0, 12.0), (12.0, 45.0)], 0
    for asset, (t, v, _) in samples(spark, sf_dir).items():
        n = len(v)
        if n < 8:
            continue
        rate = (n - 1) / ((t[-1] - t[0]) / 100)
        window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
        x = [(a - sum(v) / n) * w for a, w in zip(v, window, strict=True)]
        power = [0.0, 0.0, 0.0]
        for k in range(n // 2 + 1):
            re, im = (sum(a * f(2 * math.pi * k * i / n) for i, a in enumerate(x)) for f in (math.cos, math.sin))
            for b, (lo, hi) in enumerate(edges):
                power[b] += (re * re + im * im) * (lo <= k * rate / n < hi)
        for b in range(3):
            assert got[asset, b] == pytest.approx((power[b], power[b] / sum(power)), rel=1e-6)
        seen += 1
    assert seen > 10


def slow_filter(sections, x):
    """Forwards and backwards by the difference equation of the whole filter, after a long run of the first value."""
    b, a = np.array([1.0]), np.array([1.0])
    for s in sections:
        b, a = np.polymul(b, s[:3]), np.polymul(a, s[3:])
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.r_[[2 * x[0] - x[i] for i in range(pad, 0, -1)], x, [2 * x[-1] - x[-1 - i] for i in range(1, pad + 1)]]
    for _ in range(2):
        before = 400
        long, out = np.r_[np.full(before, y[0]), y], []
        rest = y[0] * b.sum() / a.sum()
        for n in range(len(long)):
            past_x = [long[n - k] if n >= k else y[0] for k in range(len(b))]
            past_y = [out[n - k] if n >= k else rest for k in range(1, len(a))]
            out.append((np.dot(b, past_x) - np.dot(a[1:], past_y)) / a[0])
        y = np.array(out[before:])[::-1]
    return y[pad : len(y) - pad]


def by_second(t, v, least):
    return {s: v[np.floor(t) == s] for s in np.unique(np.floor(t)) if (np.floor(t) == s).sum() >= least}


def test_roughness(spark, sf_dir):
    got = {(r["asset"], r["t"]): r["value"] for r in plans.QUERIES["roughness"](spark, sf_dir).collect()}
    want = {}
    for asset, (t, v, k) in list(samples(spark, sf_dir).items()):
        if len(t) < 64:
            continue
        t, size = t / 100, np.sqrt((v / 50) ** 2 + (k / 10) ** 2 + 9.8**2)
        y = slow_filter(filters.butterworth(4, (5.0, 40.0), (len(t) - 1) / (t[-1] - t[0])), size - size.mean())
        want |= {(asset, s): math.sqrt((x**2).mean()) for s, x in by_second(t, y, 9).items()}
    assert want and got == pytest.approx(want, rel=1e-5)


def test_turn_rate(spark, sf_dir):
    got = {(r["asset"], r["t"]): r["value"] for r in plans.QUERIES["turn_rate"](spark, sf_dir).collect()}
    up, want = np.array([0.1, 0.95, 0.2]) / math.sqrt(0.1**2 + 0.95**2 + 0.2**2), {}
    for asset, (t, v, _) in samples(spark, sf_dir).items():
        if len(t) < 64:
            continue
        t, yaw = t / 30, sum((v - 245) / (100 + 50 * i) * up[i] for i in range(3))
        y = slow_filter(filters.butterworth(2, 1.0, (len(t) - 1) / (t[-1] - t[0])), yaw)
        want |= {(asset, s): np.abs(x).mean() for s, x in by_second(t, y, 1).items()}
    assert want and got == pytest.approx(want, rel=1e-5)


def slow_track(frames):
    """One subject: the nearest plausible box to where it should be; (track, second pass, u, v) of each frame."""
    out, pos, vel, width, last, number = [], None, None, None, None, 0
    for t, boxes in frames:
        if last is not None and t - last > 2.0:
            pos = None
        chosen, weak = None, 0
        if pos is None:
            chosen = max(boxes, key=lambda b: b[4], default=None)
        else:
            due, gate = pos + vel * (t - last), 0.25 * (1 + min(t - last, 2.0) / 2.0)
            cost = {}
            for b in boxes:
                far = np.linalg.norm([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2] - due)
                if far <= gate:
                    cost[b] = far / gate - 0.2 * b[4] + 0.35 * abs(math.log(max(b[2] - b[0], 1e-6) / max(width, 1e-6)))
            sure = {b: c for b, c in cost.items() if b[4] >= 0.3}
            chosen, weak = min(sure or cost, key=(sure or cost).get, default=None), int(not sure)
        if chosen is None:
            out.append((number, 0, None, None))
            continue
        here = np.array([(chosen[0] + chosen[2]) / 2, (chosen[1] + chosen[3]) / 2])
        if pos is None:
            number, pos, vel, width, weak = number + 1, here, np.zeros(2), chosen[2] - chosen[0], 0
        else:
            miss = here - due
            pos, vel, width = due + 0.6 * miss, vel + 0.25 * miss / (t - last), 0.6 * width + 0.4 * (chosen[2] - chosen[0])
        last = t
        out.append((number, weak, *here))
    return out


def test_track_follow(spark, sf_dir):
    got = plans.QUERIES["track_follow"](spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", "embedding").toPandas().sort_values(["label", "vec_id"])
    for label, g in rows.groupby("label"):
        frames = [((i + 1) / 5.0, [(0.4 + float(e[0]), 0.4 + float(e[1]), 0.45 + float(e[0]), 0.5 + float(e[1]), abs(float(e[2]) * 4))]) for i, e in enumerate(g["embedding"])]
        own = got[got["label"] == label].sort_values("t")
        for r, (number, weak, u, v) in zip(own.itertuples(), slow_track(frames), strict=True):
            assert (r.track_id, r.pass2) == (number, weak)
            assert (np.isnan(r.u) and u is None) or (r.u, r.v) == pytest.approx((u, v))
    rng = np.random.default_rng(4)
    frames = [(i / 5, [(*c, *(c + rng.uniform(0.02, 0.2, 2)), float(rng.uniform())) for c in rng.uniform(0, 0.9, (rng.integers(0, 4), 2))]) for i in range(400)]
    for row, (number, weak, u, v) in zip(tracker.follow([(t, b, 0) for t, b in frames]), slow_track(frames), strict=True):
        assert (row[9], row[10]) == (number, weak) and ((row[11] is None and u is None) or (row[11], row[12]) == pytest.approx((u, v)))


def dense_path(target, weight, dt, low, high):
    """The same guesses as solve_path's, with whole matrices and numpy's solver."""
    n = len(target)
    d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), 2, axis=0)
    still = framing.VELOCITY / dt * d1.T @ d1 + framing.ACCELERATION / dt**3 * d2.T @ d2
    z, out, held = np.clip(target, low, high), None, np.zeros(n)
    out = np.abs(z - target) > framing.DEAD
    for _ in range(framing.ROUNDS):
        edge = target + framing.DEAD * np.sign(z - target)
        pull = weight * dt
        a = still + np.diag(pull * (out + framing.ANCHOR) + framing.BOUND * (held != 0))
        b = pull * (out * edge + framing.ANCHOR * target) + framing.BOUND * np.where(held < 0, low, np.where(held > 0, high, 0))
        new = np.linalg.solve(a, b)
        now_out, now_held = np.abs(new - target) > framing.DEAD, np.where(new < low - 1e-12, -1, np.where(new > high + 1e-12, 1, 0))
        done = (now_out == out).all() and ((now_held != 0) == (held != 0)).all() and np.abs(new - z).max() < framing.SETTLED
        z, out, held = new, now_out, now_held
        if done:
            break
    return np.clip(z, low, high)


def test_deadzone_path(spark, sf_dir):
    got = plans.QUERIES["deadzone_path"](spark, sf_dir).toPandas()
    own = mapping.gappy(spark, sf_dir).select("asset", (F.col("t") / 10).alias("t"), (F.col("v") / 500).alias("z"))
    aims = series.hold_then_ease(own, "asset", "t", "z", 0.5).toPandas()
    assert got["asset"].nunique() == aims["asset"].nunique() > 10
    for asset, g in aims.groupby("asset"):
        g = g.sort_values("t")
        want = dense_path(g["target"].to_numpy(float), g["weight"].to_numpy(float), 0.1, 0.1, 0.9)
        assert np.allclose(got[got["asset"] == asset].sort_values("t")["z"], want, atol=1e-6)


def slow_auc(rows):
    """The share of (positive, negative) pairs of (score, label) in order, and how many there are."""
    pairs = [(p, q) for p, a in rows for q, b in rows if a == 1 and b == 0]
    return sum(0.5 if p == q else float(p > q) for p, q in pairs), len(pairs)


def test_fit_evaluate(spark, sf_dir):
    got = plans.QUERIES["fit_evaluate"](spark, sf_dir).first()
    rows = selection.log(spark, sf_dir).toPandas()
    x = np.c_[np.log1p(rows["n_chars"]), rows["t_in"]]
    x, y = (x - x.mean(axis=0)) / x.std(axis=0), rows["label"].to_numpy(float)
    fold = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        order = sorted(np.flatnonzero(y == label), key=lambda i: hashlib.md5(f"0:{rows['id'][i]}".encode()).hexdigest())
        fold[order] = np.arange(len(order)) % 5
    p, weights = np.zeros(len(y)), []
    for k in range(5):
        a, b, w = np.c_[np.ones((fold != k).sum()), x[fold != k]], y[fold != k], np.zeros(3)
        for _ in range(50):  # Newton's steps on the sum of log losses and the squared weights
            q = 1 / (1 + np.exp(-a @ w))
            free = np.diag([0.0, 2.0, 2.0])
            w -= np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + free, a.T @ (q - b) + free @ w)
        p[fold == k] = 1 / (1 + np.exp(-np.c_[np.ones((fold == k).sum()), x[fold == k]] @ w))
        weights.append(w[1:])
    won, n = slow_auc(list(zip(p, y, strict=True)))
    # probabilities within the solver's tolerance of each other may be in another order
    assert got["fit"] == pytest.approx(won / n, abs=2e-3)
    inside = [slow_auc([(p[i], y[i]) for i in g.index]) for _, g in rows.groupby("grp")]
    assert got["pairs"] == sum(n for _, n in inside) and got["within"] == pytest.approx(sum(w for w, _ in inside) / got["pairs"], abs=5e-3)
    won, n = slow_auc(list(zip(rows["score"], y, strict=True)))
    assert got["incumbent"] == pytest.approx(won / n)
    assert got["stable"] == all(len(set(np.sign(w))) == 1 for w in zip(*weights, strict=True))
    case = decisions.verdict(*[F.lit(got[c]) for c in ("fit", "within", "pairs", "incumbent", "incumbent")], F.lit(0.05))
    assert got["verdict"] == spark.range(1).select(case.alias("v")).first()["v"]

