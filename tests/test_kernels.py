"""Planted answers for clip selection, path solving, tracking and filtering."""

import numpy as np
import pandas as pd
import pytest

from ridgeline.kernels import filters, framing, tracker

@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 12, 50])
def test_banded_matrix_and_solver_equal_dense_ones(n):
    dt, lv, la = 0.1, 3.0, 12.0
    w = np.random.default_rng(n).uniform(0.1, 1, n)
    bands = framing.penalty_bands(n, dt, lv, la)
    bands[0] += w
    d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), 2, axis=0)
    dense = np.diag(w) + lv / dt * d1.T @ d1 + la / dt**3 * d2.T @ d2
    built = np.diag(bands[0])
    for k in (1, 2):
        if n > k:
            built += np.diag(bands[k][: n - k], k) + np.diag(bands[k][: n - k], -k)
    assert np.allclose(built, dense, rtol=1e-12)
    rhs = np.arange(n) + 1.0
    assert np.allclose(framing.solve_banded(bands, rhs), np.linalg.solve(dense, rhs), rtol=1e-8)


def test_path_rests_inside_the_dead_zone_and_follows_beyond_it():
    t = np.arange(0, 20, 0.1)
    still = framing.solve_path(1.5 + 0.5 * framing.DEAD * np.sin(t), np.ones(len(t)), 0.1)
    assert np.ptp(still.z) < 0.02 * framing.DEAD * 10
    step = np.where(t < 10, 1.0, 1.0 + 3 * framing.DEAD)
    moved = framing.solve_path(step, np.ones(len(t)), 0.1)
    assert abs(moved.z[-1] - step[-1]) <= framing.DEAD * 1.1 and moved.rounds < 24


def test_path_keeps_to_its_bounds():
    t = np.arange(0, 10, 0.1)
    path = framing.solve_path(np.full(len(t), -0.5), np.ones(len(t)), 0.1, 0.0, 2.0)
    assert path.z.min() >= 0 and path.violation < 1e-2 and path.saturated > 0.5
    assert framing.solve_path(np.ones(5), np.ones(5), 0.1, 1.0, 1.0).saturated == 1.0
    assert len(framing.solve_path(np.zeros(0), np.zeros(0), 0.1).z) == 0


def box(u, score=0.6, size=0.06):
    return (u - size / 2, 0.47, u + size / 2, 0.53, score)


def test_tracker_prefers_the_blurred_subject_to_a_distant_distractor():
    frames = []
    for i in range(25):
        t, boxes = i / 5, [box(0.4)]
        if 2.0 <= t <= 2.6:
            boxes = [box(0.41, 0.30), box(0.95, 0.85)]
        frames.append((t, boxes, 0))
    rows = list(tracker.follow(frames))
    assert max(r[11] for r in rows) < 0.6 and rows[-1][9] == 1


@pytest.mark.parametrize(("gap", "tracks"), [(3.0, 2), (0.4, 1)])
def test_tracker_gaps(gap, tracks):
    frames = [(i / 5, [] if 2 <= i / 5 < 2 + gap else [box(0.5)], 0) for i in range(40)]
    rows = list(tracker.follow(frames))
    assert rows[-1][9] == tracks and any(r[3] is None for r in rows)


def test_butterworth_edges_and_zero_phase():
    rate = 200.0
    for order, edges, probes in ((4, (5.0, 40.0), (5.0, 40.0)), (2, 1.0, (1.0,))):
        sections = filters.butterworth(order, edges, rate)
        for f in probes:
            z = np.exp(2j * np.pi * f / rate)
            gain = np.prod([abs(np.polyval(s[:3], z) / np.polyval(s[3:], z)) for s in sections])
            assert gain == pytest.approx(2**-0.5, rel=1e-6)
    t = np.arange(0, 20, 1 / rate)
    slow, fast = np.sin(2 * np.pi * 0.2 * t), 0.5 * np.sin(2 * np.pi * 30 * t)
    out = filters.zero_phase(filters.butterworth(2, 1.0, rate), slow + fast)
    assert np.abs(out - slow)[400:-400].max() < 0.02


def test_roughness_and_turn_rate():
    t = np.arange(0, 10, 0.005)
    accl = np.c_[9.8 + 2 * np.sin(2 * np.pi * 15 * t), 0 * t, 0 * t]
    r = filters.roughness_of(t, accl)
    assert np.allclose(r["value"][2:-2], 2**0.5, rtol=0.02)
    assert len(filters.roughness_of(t[:50], accl[:50])) == 0
    gyro = np.c_[0 * t, 0.5 + 3 * np.sin(2 * np.pi * 20 * t), 0 * t]
    turn = filters.turn_rate_of(t, gyro, np.c_[0 * t, 9.8 + 0 * t, 0 * t])
    assert np.allclose(turn["value"][2:-2], 0.5, atol=0.02)  # rectified after the filter: the shake is gone
    band = filters.band_power(t, np.sin(2 * np.pi * 15 * t), [(0, 10), (10, 20)])
    assert band[1] > 100 * band[0]
