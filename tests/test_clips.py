"""Planted answers for clip selection, each curve an asset of one table."""

import numpy as np
import pytest

from ridgeline.operators import clips


def bursts():
    y = np.full(300, 0.25)
    for c in (50, 150, 250):
        y[c - 6 : c + 7], y[c] = 0.85, 0.97
    return y


def plateau(peak):
    y = np.full(200, 0.30)
    y[40:140], y[peak] = 0.80, 0.99
    return y


CURVES = {
    "long": plateau(95),
    "end": plateau(139),
    "last": np.r_[np.random.default_rng(1).uniform(0.2, 0.4, 60), [0.6] * 8, 0.95],
    "bursts": bursts(),
    "dull": 0.42 + np.random.default_rng(2).normal(0, 0.01, 300),
    "nothing": np.full(50, np.nan),
    "one": np.array([0.9]),
    "flight": bursts(),
}
EVENTS = [("flight", 42.0, 43.0), ("flight", 41.2, 42.8), ("flight", 156.5, 158.2), ("flight", 158.4, 159.0), ("gone", 1.0, 2.0)]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, float(t), float(v), 0.9 if t < 200 else 0.1, 0.1 if t < 200 else 0.9) for name, y in CURVES.items() for t, v in enumerate(y)]
    scores = spark.createDataFrame(rows, "asset string, t double, composite double, s_turn double, s_rough double")
    events = spark.createDataFrame(EVENTS, "asset string, t_start double, t_end double")
    out = {}
    for r in clips.clip_candidates(scores, events, "asset").orderBy("asset", "rank").collect():
        out.setdefault(r["asset"], []).append(r)
    return out


def test_long_plateau_keeps_the_peak_near_the_start(found):
    best = next(c for c in found["long"] if c["peak_t"] == 95)
    assert best["t_in"] <= 95 <= best["t_out"] and best["t_out"] - 95 >= 4
    assert abs(95 - best["t_in"] - 1.5) <= 1.5 and best["t_out"] - best["t_in"] <= 30


def test_peak_at_the_end_of_a_stretch_keeps_its_tail(found):
    assert next(c for c in found["end"] if c["peak_t"] == 139)["t_out"] - 139 >= 4


def test_last_second_is_a_peak(found):
    assert [c["peak_t"] for c in found["last"]] == [68.0] and found["last"][0]["t_out"] == 69


def test_bursts_and_dull_rides(found):
    out = found["bursts"]
    assert len(out) == 3 and all(8 <= c["t_out"] - c["t_in"] <= 30 for c in out) and [c["rank"] for c in out] == [1, 2, 3]
    assert not {"dull", "nothing", "one", "gone"} & set(found)


def test_edges_leave_chained_events(found):
    for c in found["flight"]:
        assert not any(a < edge < b for name, a, b in EVENTS if name == "flight" for edge in (c["t_in"], c["t_out"]))
    plain = {c["peak_t"]: c for c in found["bursts"]}
    assert any((c["t_in"], c["t_out"]) != (plain[c["peak_t"]]["t_in"], plain[c["peak_t"]]["t_out"]) for c in found["flight"])


def test_repeated_kinds_count_less(found):
    out = found["bursts"]
    assert sorted(c["dominant"] for c in out) == ["rough", "turn", "turn"]
    assert min(c["adjusted"] / c["score"] for c in out) == pytest.approx(0.75)
    assert out[0]["features"] == {"speed": None, "turn": 0.9, "rough": 0.1, "jump": None}
