"""Training of the network by distributed gradients.

Rows are dealt once, in a seeded order, into batches of ``batch`` rows; ``workers`` batches make a step. Every batch is stored as one row and
partition, so a step is one stage over its own partitions and shuffles nothing. A task makes the gradient of its batches: convolutions, pooling, dense layers, batch
normalisation over the batch's own rows, dropout by seed, epoch and batch. A vector the size of the weights (checked
against ``MOST``) reaches the driver from each of the ``workers`` batches or, where those are more than ``TOLD`` bytes, one that a tree of tasks added; the driver makes Adam's step and hands the weights out again. So results do not depend on how the
table is partitioned, and a step's work grows with ``workers`` on as many tasks.

After each epoch the validation rows are scored; the best weights are kept, and training stops when ``patience`` epochs did not raise the
accuracy by ``delta``. A last batch that is not full is left out (``drop_last``), unless it is the only one.
Defined results: rows with a null id, label or vector take no part; labels outside the classes and vectors of another length are errors; without
training rows the initial weights come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.operators import network, split, sums

#: Most numbers that a network may have: 512 MB of weights.
MOST = 1 << 26
#: Most bytes of a step's gradients that the driver adds up itself.
TOLD = 64 << 20
#: Share of the old running statistics that a step keeps.
KEEP = 0.9


@dataclass(frozen=True)
class Design:
    """Shape of a network: convolutions (channels, kernel, padding, pool width), dense widths, and share of units dropped in training."""

    length: int
    classes: int
    conv: tuple[tuple[int, int, int, int], ...] = ((32, 15, 7, 2), (32, 15, 7, 2), (32, 15, 7, 2))
    dense: tuple[int, ...] = (256, 128)
    dropout: float = 0.3

    def flattened(self) -> int:
        length, channels = self.length, 1
        for channels, kernel, padding, width in self.conv:  # noqa: B007
            length = length + 2 * padding - kernel + 1
            length = (length - width) // 2 + 1
            if length < 1:
                raise ValueError("the vectors are too short for these convolutions")
        return length * channels


def initial(design: Design, seed: int) -> dict[str, np.ndarray]:
    """Named weights, uniform within one over the root of a unit's inputs."""
    rng = np.random.default_rng(seed)
    draw = lambda shape, inputs: rng.uniform(-1, 1, shape) / np.sqrt(inputs)
    state: dict[str, np.ndarray] = {}
    channels = 1
    for k, (out, kernel, padding, width) in enumerate(design.conv):
        state |= {f"conv.{k}.weight": draw((out, channels, kernel), channels * kernel), f"conv.{k}.bias": draw(out, channels * kernel)}
        state |= {f"conv.{k}.padding": np.array(padding), f"conv.{k}.pool": np.array(width)}
        channels = out
    inputs = design.flattened()
    for k, out in enumerate(design.dense):
        state |= {f"dense.{k}.weight": draw((out, inputs), inputs), f"dense.{k}.bias": draw(out, inputs)}
        state |= {f"dense.{k}.gain": np.ones(out), f"dense.{k}.offset": np.zeros(out), f"dense.{k}.mean": np.zeros(out), f"dense.{k}.var": np.ones(out)}
        inputs = out
    state |= {"last.weight": draw((design.classes, inputs), inputs), "last.bias": draw(design.classes, inputs)}
    if sum(v.size for v in state.values()) > MOST:
        raise ValueError(f"a network of more than {MOST} numbers is too large to hand to every task")
    return state


def learned(state: dict) -> list[str]:
    """Names of the weights that gradients change, in a fixed order."""
    return sorted(k for k in state if k.rsplit(".", 1)[1] in ("weight", "bias", "gain", "offset"))


def running(state: dict) -> list[str]:
    return sorted(k for k in state if k.rsplit(".", 1)[1] in ("mean", "var"))


def gradients(state: dict, x: np.ndarray, y: np.ndarray, dropout: float, rng: np.random.Generator) -> tuple[dict, dict, float, int]:
    """(gradient of the mean cross-entropy by weight, statistics of the batch, mean cross-entropy, right answers) of one batch in training."""
    n = len(x)
    layers, h = [], x[:, None, :]
    weights = network.from_state(state)
    for weight, bias, padding, width in weights["conv"]:
        z = network.conv1d(h, weight, bias, padding)
        out, at = network.pooled(np.maximum(z, 0), width)
        layers.append((h, z > 0, at))
        h = out
    shape, h = h.shape, h.reshape(n, -1)
    stats, dense = {}, []
    for k, (weight, bias, gain, offset, _, _) in enumerate(weights["dense"]):
        z = h @ weight.T + bias
        mean, var = z.mean(axis=0), z.var(axis=0)
        unit = (z - mean) / np.sqrt(var + network.EPS)
        out = unit * gain + offset
        kept = (rng.random(out.shape) >= dropout) / (1 - dropout) if dropout else np.ones(out.shape)
        dense.append((h, unit, var, (out > 0) * kept))
        stats |= {f"dense.{k}.mean": mean, f"dense.{k}.var": var * n / max(1, n - 1)}
        h = out * dense[-1][3]
    weight, bias = weights["last"]
    logits = h @ weight.T + bias
    power = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = power / power.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean())
    right = int((logits.argmax(axis=1) == y).sum())

    d = p.copy()
    d[np.arange(n), y] -= 1
    d /= n
    grads = {"last.weight": d.T @ h, "last.bias": d.sum(axis=0)}
    d = d @ weight
    for k in range(len(dense) - 1, -1, -1):
        h, unit, var, kept = dense[k]
        weight, _, gain, *_ = weights["dense"][k]
        d = d * kept
        grads |= {f"dense.{k}.gain": (d * unit).sum(axis=0), f"dense.{k}.offset": d.sum(axis=0)}
        d = d * gain
        d = (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0)) / np.sqrt(var + network.EPS)
        grads |= {f"dense.{k}.weight": d.T @ h, f"dense.{k}.bias": d.sum(axis=0)}
        d = d @ weight
    d = d.reshape(shape)
    for k in range(len(layers) - 1, -1, -1):
        h, positive, at = layers[k]
        weight, _, padding, width = weights["conv"][k]
        full = np.zeros(positive.shape)
        for t in range(width):
            full[:, :, t : t + 2 * d.shape[2] - 1 : 2] += d * (at == t)
        full *= positive
        padded = np.pad(h, ((0, 0), (0, 0), (padding, padding)))
        back, slope = np.zeros(padded.shape), np.zeros(weight.shape)
        length = full.shape[2]
        for t in range(weight.shape[2]):
            slope[:, :, t] = (full @ padded[:, :, t : t + length].transpose(0, 2, 1)).sum(axis=0)
            back[:, :, t : t + length] += weight[:, :, t].T @ full
        grads |= {f"conv.{k}.weight": slope, f"conv.{k}.bias": full.sum(axis=(0, 2))}
        d = back[:, :, padding : back.shape[2] - padding]
    return grads, stats, loss, right


@dataclass
class Adam:
    """Adam's moments and step for named weights."""

    rate: float
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)
    steps: int = 0

    def __call__(self, state: dict, grads: dict) -> dict:
        self.steps += 1
        out = dict(state)
        for name, g in grads.items():
            m = self.first[name] = 0.9 * self.first.get(name, 0.0) + 0.1 * g
            v = self.second[name] = 0.999 * self.second.get(name, 0.0) + 0.001 * g * g
            out[name] = state[name] - self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return out


class Stop:
    """True once ``patience`` values in a row were below the best one plus ``delta``."""

    def __init__(self, patience: int, delta: float = 0.001):
        self.patience, self.delta, self.best, self.waited = patience, delta, None, 0

    def __call__(self, value: float) -> bool:
        if self.best is None or value >= self.best + self.delta:
            self.best, self.waited = value, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")


def dealt(rows: DataFrame, design: Design, batch: int, seed: int, drop_last: bool) -> tuple[DataFrame, int]:
    """(batch, labels, x), each batch one row and one partition, in a cut table; and their number."""
    wrong = rows.where((F.size("v") != design.length) | ~F.col("label").between(0, design.classes - 1)).limit(1).collect()
    if wrong:
        raise ValueError(f"row {wrong[0].id} has {len(wrong[0].v)} values and label {wrong[0].label}; wanted {design.length} values and a label below {design.classes}")
    ranks = split.spread_ranks(rows.select("id", F.lit(0).alias("all")), "all", split.ticket(seed, "id"), "id")
    n = rows.count()
    batches = max(1, n // batch) if drop_last else max(1, -(-n // batch))
    placed = rows.join(ranks.select("id", F.floor((F.col("rank") - 1) / batch).alias("batch")).where(F.col("batch") < batches), "id")

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        x = sums.flat(table["v"].combine_chunks())[order]
        return pa.table({"batch": table["batch"][:1], "labels": pa.array([table["label"].to_numpy()[order].tolist()], pa.list_(pa.int32())), "x": pa.array([x.tobytes()], pa.binary())})

    packed = placed.groupBy("batch").applyInArrow(pack, "batch long, labels array<int>, x binary")
    return storage.cut(packed.repartitionById(batches, F.col("batch").cast("int"))), batches if n else 0


def step_gradient(batches: RDD | DataFrame, own: range, state: dict, design: Design, seed: int, epoch: int) -> tuple[dict, dict, float, float, int]:
    """(gradients, statistics, loss, accuracy, rows) of the step of the batches ``own``, each by its number of rows. Of an RDD only their partitions are read, by one stage,
    and a vector of each reaches the driver; the rows of a table are added in a tree."""
    names, kept = learned(state), running(state)
    context = batches.sparkSession.sparkContext if isinstance(batches, DataFrame) else batches.context
    shared = context.broadcast(state)

    def flat(number: int, labels: list, raw: bytes) -> np.ndarray:
        y = np.array(labels)
        n = len(y)
        grads, stats, loss, right = gradients(shared.value, np.frombuffer(raw).reshape(n, -1), y, design.dropout, np.random.default_rng([seed, epoch, number]))
        return np.concatenate([[n, n * loss, right], *(n * grads[k].ravel() for k in names), *(n * stats[k].ravel() for k in kept)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([network.as_lists(flat(*row)[None, :])], ["v"])

    if isinstance(batches, DataFrame):
        total = sums.tree_sum(batches.select("batch", "labels", "x").mapInArrow(run, "v array<double>"))
    else:
        total = sum(np.frombuffer(v) for v in context.runJob(batches, lambda rows: (flat(*row).tobytes() for row in rows), list(own)))
    shared.unpersist()
    n, at, out = int(total[0]), 3, {}
    for name in (*names, *kept):
        out[name] = total[at : at + state[name].size].reshape(state[name].shape) / n
        at += state[name].size
    return {k: out[k] for k in names}, {k: out[k] for k in kept}, total[1] / n, total[2] / n, n


def scored(rows: DataFrame, state: dict, flat: bool = False) -> DataFrame:
    """(id, label, logits, features) of (id, label, v); with ``flat`` also the flattened output of the convolutions."""
    return rows.select("id", "label").join(network.predicted(rows, network.from_state(state), "id", "v", flat=flat), "id")


def accuracy(rows: DataFrame, state: dict) -> float:
    """Share of (id, label, v) whose largest logit is their label's; 0 without rows."""
    right = F.col("label") == F.array_position("logits", F.array_max("logits")) - 1
    return float(scored(rows, state).agg(F.coalesce(F.count_if(right) / F.count("*"), F.lit(0.0))).first()[0]) if rows.limit(1).count() else 0.0


def train(rows: DataFrame, validation: DataFrame, design: Design, epochs: int, batch: int = 64, workers: int = 4, rate: float = 1e-3, seed: int = 42, patience: int = 10, drop_last: bool = True, report=None) -> tuple[dict, list[dict]]:
    """(weights, history): the weights of the epoch with the best validation accuracy, the first among equals, and per epoch loss and accuracies.

    Both tables are (id, label, v) as ``usable`` gives them. ``report`` is told (epoch, accuracy) and may raise to end a run.
    """
    spark = rows.sparkSession
    scratch = storage.Scratch()
    path = storage.fresh_path(spark, "batches")
    validation = scratch.cut(validation)
    state = initial(design, seed)
    best, best_accuracy, history, optimizer, stop = state, -1.0, [], Adam(rate), Stop(patience)
    try:
        dealt_, batches = dealt(scratch.cut(rows), design, batch, seed, drop_last)
        scratch.tables.append(dealt_)
        parts, steps = dealt_.rdd, -(-batches // workers)
        if large := steps and 8 * workers * sum(v.size for v in state.values()) > TOLD:
            dealt_.withColumn("step", F.floor(F.col("batch") / workers)).write.partitionBy("step").parquet(path)
        for epoch in range(epochs if steps else 0):
            order = np.random.default_rng([seed, epoch]).permutation(steps)
            total = np.zeros(3)
            for step in order.tolist():
                of = spark.read.parquet(f"{path}/step={step}") if large else parts
                grads, stats, loss, right, n = step_gradient(of, range(step * workers, min(batches, (step + 1) * workers)), state, design, seed, epoch)
                state = optimizer(state, grads) | {k: KEEP * state[k] + (1 - KEEP) * v for k, v in stats.items()}
                total += [n, n * loss, n * right]
            reached = accuracy(validation, state)
            history.append({"epoch": epoch, "train_loss": float(total[1] / total[0]), "train_acc": float(total[2] / total[0]), "val_acc": reached})
            if reached > best_accuracy:
                best, best_accuracy = state, reached
            if report:
                report(epoch, reached)
            if stop(reached):
                break
    finally:
        storage.remove(spark, path)
        scratch.close()
    return best, history


def long_logits(found: DataFrame) -> DataFrame:
    """(id, label, class, logit) of ``scored`` rows, as ``evaluate.top_k`` takes them."""
    return found.select("id", "label", F.posexplode("logits").alias("class", "logit"))
