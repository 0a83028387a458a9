"""The Parzen search against random search, its pruning, and its going on after a break."""

import json
import math

import numpy as np
import pytest
from test_training import planted

from prismflow import storage
from prismflow.plans import dataset, tuning

SPACE = {"x": ("float", -5.0, 5.0), "rate": ("log", 1e-4, 1.0), "n": ("int", 0, 40, 5), "kind": ("choice", ["a", "b", [1, 2]])}


def hill(p, report=None):
    return -((p["x"] - 1.3) ** 2) - (math.log10(p["rate"]) + 2.2) ** 2 - ((p["n"] - 25) / 10) ** 2 - (0 if p["kind"] == "b" else 2)


def test_better_than_random_in_equal_trials(spark, tmp_path):
    own, blind = [], []
    for seed in range(6):
        own.append(tuning.search(spark, SPACE, 40, seed, hill, f"file://{tmp_path}/own{seed}")["score"])
        blind.append(max(hill(dataset.suggestion(SPACE, seed, t)) for t in range(40)))
    assert np.mean(own) > np.mean(blind) and sum(a >= b for a, b in zip(own, blind, strict=True)) >= 5


def test_points_stay_inside_their_space():
    rng = np.random.default_rng(1)
    points = [dataset.suggestion(SPACE, 3, t) for t in range(30)]
    for _ in range(60):
        p = tuning.proposal(SPACE, points[:3], points[3:], rng)
        assert -5 <= p["x"] <= 5 and 1e-4 <= p["rate"] <= 1 and p["n"] in range(0, 41, 5) and p["kind"] in SPACE["kind"][1]
    assert tuning.proposal(SPACE, [], [], rng).keys() == SPACE.keys()


def test_density_integrates_to_one():
    for seen in ([], [0.5], [-1.0, -1.0, 2.0, 3.0]):
        p = tuning.Parzen(seen, -1.0, 3.0)
        x = np.linspace(-1, 3, 40_001)
        assert abs(np.trapezoid(np.exp(p.log_density(x)), x) - 1) < 1e-3
        drawn = p.draw(500, np.random.default_rng(2))
        assert drawn.min() >= -1 and drawn.max() <= 3


def test_a_broken_search_goes_on(spark, tmp_path):
    whole = tuning.search(spark, SPACE, 25, 7, hill, f"file://{tmp_path}/whole")
    calls = []

    def fails(p, report):
        calls.append(p)
        if len(calls) == 15:
            raise OSError("lost")
        return hill(p)

    with pytest.raises(OSError):
        tuning.search(spark, SPACE, 25, 7, fails, f"file://{tmp_path}/torn")
    assert tuning.search(spark, SPACE, 25, 7, lambda p, report: calls.append(p) or hill(p), f"file://{tmp_path}/torn") == whole
    assert len(calls) == 26


def test_trials_that_fall_behind_are_pruned(spark, tmp_path):
    steps = []

    def slow(p, report):
        for step in range(10):
            steps.append(step)
            report(step, hill(p) * (1 + 1 / (1 + step)))
        return hill(p)

    best = tuning.search(spark, SPACE, 30, 5, slow, f"file://{tmp_path}/p", pruner=tuning.Median())
    rows = [json.loads(storage.read_text(spark, f"file://{tmp_path}/p/trial={t}.json")) for t in range(30)]
    pruned = [r for r in rows if r["state"] == "pruned"]
    assert len(pruned) >= 8 and len(steps) < 300 and best["state"] == "complete"
    assert all(r["trial"] >= 5 and len(r["values"]) < 10 for r in pruned)
    assert best["score"] >= max(r["score"] for r in rows if r["state"] == "complete")


def test_search_over_networks(spark, tmp_path):
    rows, val = planted(spark, 90, 3), planted(spark, 30, 4, shift=500)
    space = {"batch": ("choice", [10, 20]), "layers": ("int", 1, 2, 1), "rate": ("log", 1e-3, 5e-2), "dropout": ("float", 0.0, 0.3), "dense": ("choice", [[8, 6], [12, 8]])}
    space |= {f"{n}_{k}": v for k in range(2) for n, v in (("channels", ("choice", [2, 4])), ("kernel", ("int", 3, 5, 1)), ("pool", ("int", 2, 3, 1)), ("padding", ("int", 1, 2, 1)))}
    best = tuning.network_search(rows, val, 20, 3, 4, 1, f"file://{tmp_path}/n", space, epochs=3, workers=2, start=2)
    assert 0.3 < best["score"] <= 1 and tuning.design_of(best["params"], 20, 3).flattened() > 0
    assert tuning.design_of({k: v[1][0] if v[0] == "choice" else v[1] for k, v in tuning.NETWORK_SPACE.items()}, 4501, 10).flattened() > 0
