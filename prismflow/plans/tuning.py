"""Search for parameters: random start, a tree-structured Parzen estimator after it, pruning of trials that fall behind.

A space names its parameters: ("choice", values), ("int", low, high, step), ("float", low, high) or ("log", low, high). After ``start`` random trials, the
finished ones are parted into the best tenth and the rest. Per parameter two densities are estimated, one of each part, and of some draws from the first
the one is taken whose ratio of densities is largest. A pruned trial counts with the last value that it reported.

Every trial is a small file below a path that Spark can reach, with its parameters, values and score; a search that finds files goes on after them,
and the draws of a trial depend on seed, number and earlier trials alone, so a search that was broken off ends as if it had not been.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from prismflow import storage
from prismflow.operators import training
from prismflow.plans.dataset import suggestion

#: Random trials before the estimator, draws it compares, and the share and most trials that count as good.
START, DRAWS, GOOD, MOST_GOOD = 10, 24, 0.1, 25


class Pruned(Exception):
    """Raised by ``report`` to end a trial that falls behind."""


@dataclass(frozen=True)
class Median:
    """Prunes a trial whose value at a step is below the median of the earlier trials at that step: not before ``trials`` of them, nor before ``steps``."""

    trials: int = 5
    steps: int = 0

    def prunes(self, step: int, value: float, earlier: list[dict]) -> bool:
        seen = [t["values"][str(step)] for t in earlier if str(step) in t["values"]]
        return step >= self.steps and len(seen) >= self.trials and value < median(seen)


class Parzen:
    """A mixture of normal densities cut off at ``low`` and ``high``: one for each observation, as wide as the gaps beside it, and a wide one for the range."""

    def __init__(self, seen: list[float], low: float, high: float):
        self.low, self.high = low, high
        span = high - low
        self.centre = np.sort(np.array([*seen, (low + high) / 2]))
        edges = np.concatenate(([low], self.centre, [high]))
        gap = np.maximum(edges[2:] - edges[1:-1], edges[1:-1] - edges[:-2])
        self.width = np.clip(gap, span / min(100, len(self.centre) + 1), span)
        self.width[np.argmin(np.abs(self.centre - (low + high) / 2))] = span
        phi = lambda x: 0.5 * (1 + np.vectorize(math.erf)((x - self.centre) / (self.width * math.sqrt(2))))
        self.inside = np.maximum(phi(high) - phi(low), 1e-12)

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        out = np.zeros(0)
        while len(out) < n:
            k = rng.integers(0, len(self.centre), 2 * n)
            x = rng.normal(self.centre[k], self.width[k])
            out = np.concatenate((out, x[(x >= self.low) & (x <= self.high)]))
        return out[:n]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centre) / self.width
        return np.log((np.exp(-0.5 * z**2) / (self.width * self.inside * math.sqrt(2 * math.pi))).mean(axis=1) + 1e-300)


def proposal(space: dict[str, tuple], good: list[dict], rest: list[dict], rng: np.random.Generator) -> dict:
    """A point that is likelier among the ``good`` points than among the ``rest``, parameter by parameter."""
    out = {}
    for name, (kind, *of) in space.items():
        if kind == "choice":
            places = {json.dumps(v): k for k, v in enumerate(of[0])}
            chances = []
            for points in (good, rest):
                counts = np.ones(len(of[0]))
                for p in points:
                    counts[places[json.dumps(p[name])]] += 1
                chances.append(counts / counts.sum())
            drawn = rng.choice(len(of[0]), DRAWS, p=chances[0])
            out[name] = of[0][int(drawn[np.argmax(np.log(chances[0][drawn]) - np.log(chances[1][drawn]))])]
            continue
        low, high, step = (*of, 1)[:3] if kind == "int" else (*of, None)
        turn, back = (math.log, math.exp) if kind == "log" else (float, float)
        half = step / 2 if kind == "int" else 0
        best, other = (Parzen([turn(p[name]) for p in points], turn(low) - half, turn(high) + half) for points in (good, rest))
        drawn = best.draw(DRAWS, rng)
        x = back(float(drawn[np.argmax(best.log_density(drawn) - other.log_density(drawn))]))
        out[name] = int(min(max(low + step * round((x - low) / step), low), low + (high - low) // step * step)) if kind == "int" else min(max(x, low), high)
    return out


def parted(done: list[dict]) -> tuple[list[dict], list[dict]]:
    """Parameters of the best and of the other trials; equal scores keep the order of the trials, trials without any value are last."""
    value = lambda t: -math.inf if t["score"] is None else t["score"]
    order = sorted(done, key=lambda t: (-value(t), t["trial"]))
    n = min(math.ceil(GOOD * len(order)), MOST_GOOD)
    return [t["params"] for t in order[:n]], [t["params"] for t in order[n:]]


def search(spark: SparkSession, space: dict[str, tuple], trials: int, seed: int, score: Callable[[dict, Callable[[int, float], None]], float], path: str, start: int = START, pruner: Median | None = None) -> dict:
    """The best finished trial, the first among equals. ``score`` gets parameters and ``report(step, value)``, which may end the trial."""
    done: list[dict] = []
    for number in range(trials):
        at = f"{path}/trial={number}.json"
        found = storage.read_text(spark, at)
        if found is None:
            params = suggestion(space, seed, number) if number < start else proposal(space, *parted(done), np.random.default_rng([seed, number]))
            row = {"trial": number, "params": params, "values": {}, "state": "complete"}

            def report(step: int, value: float, row: dict = row) -> None:
                row["values"][str(step)] = value
                if pruner and pruner.prunes(step, value, done):
                    raise Pruned

            try:
                row["score"] = score(params, report)
            except Pruned:
                row |= {"state": "pruned", "score": list(row["values"].values())[-1]}
            found = json.dumps(row)
            storage.write_text(spark, at, found)
        done.append(json.loads(found))
    finished = [t for t in done if t["state"] == "complete"] or done
    return max(finished, key=lambda t: (t["score"], -t["trial"]))


#: The reference's kinds of parameters for the network; kernels and widths as given there, for vectors of 4501 values.
NETWORK_SPACE = {
    "batch": ("choice", [32, 64, 128]),
    "layers": ("int", 3, 4, 1),
    **{f"channels_{k}": ("choice", [32, 64, 128]) for k in range(4)},
    **{f"kernel_{k}": ("int", 10, 40, 5) for k in range(4)},
    **{f"pool_{k}": ("int", 2, 3, 1) for k in range(4)},
    **{f"padding_{k}": ("int", 5, 20, 1) for k in range(4)},
    "rate": ("log", 1e-4, 1e-1),
    "dropout": ("float", 0.3, 0.6),
    "dense": ("choice", [[256, 128], [512, 256], [1024, 512]]),
}


def design_of(params: dict, length: int, classes: int) -> training.Design:
    conv = tuple((params[f"channels_{k}"], params[f"kernel_{k}"], params[f"padding_{k}"], params[f"pool_{k}"]) for k in range(params["layers"]))
    return training.Design(length, classes, conv, tuple(params["dense"]), params["dropout"])


def network_search(rows: DataFrame, validation: DataFrame, length: int, classes: int, trials: int, seed: int, path: str, space: dict[str, tuple] = NETWORK_SPACE, epochs: int = 10, workers: int = 4, pruner: Median | None = Median(), start: int = START) -> dict:
    """The best trial over designs and rates: each trains a network, reports its validation accuracy by epoch, and scores the best one."""

    def score(params: dict, report: Callable[[int, float], None]) -> float:
        _, history = training.train(rows, validation, design_of(params, length, classes), epochs, params["batch"], workers, params["rate"], seed, patience=3, report=report)
        return max((h["val_acc"] for h in history), default=0.0)

    return search(rows.sparkSession, space, trials, seed, score, path, start, pruner)
