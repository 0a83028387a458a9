"""Forward pass of a one-dimensional convolutional network; see ``training`` for its weights.

Layers: convolution, ReLU and pooling (stride 2, width 2 unless given) any number of times; dense layers with batch
normalisation and ReLU; a last dense layer.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.operators import sums


#: Added to a variance before its root is taken.
EPS = 1e-5


def conv1d(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, padding: int = 0) -> np.ndarray:
    """x (rows, channels, length), weight (out, channels, width); one tap of the kernel after the other, so memory follows the output."""
    x = np.pad(x, ((0, 0), (0, 0), (padding, padding)))
    width = weight.shape[2]
    length = x.shape[2] - width + 1
    out = np.broadcast_to(bias[None, :, None], (len(x), len(bias), length)).copy()
    for t in range(width):
        out += weight[:, :, t] @ x[:, :, t : t + length]
    return out


def pooled(y: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of windows of ``width`` at every second place, and where in its window it stands."""
    windows = np.lib.stride_tricks.sliding_window_view(y, width, axis=2)[:, :, ::2]
    return windows.max(axis=3), windows.argmax(axis=3)


def forward(weights: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, flattened convolution output, activation after the second ReLU)."""
    y = x[:, None, :]
    for weight, bias, padding, *width in weights["conv"]:
        y = pooled(np.maximum(conv1d(y, weight, bias, padding), 0), *width)[0]
    flat = y.reshape(len(y), -1)
    z = flat
    for weight, bias, gain, offset, mean, var in weights["dense"]:
        z = np.maximum((z @ weight.T + bias - mean) / np.sqrt(var + EPS) * gain + offset, 0)
    weight, bias = weights["last"]
    return z @ weight.T + bias, flat, z


def from_state(state: dict[str, np.ndarray], padding: int = 0) -> dict:
    """Weights for ``forward`` out of named arrays: conv.K.weight and .bias (with .padding and .pool where they differ from the rule), dense.K.weight, .bias, .gain, .offset, .mean and .var, last.weight and .bias.

    A common prefix (``model.`` and the like) is dropped; names that the network does not have are ignored, missing ones are an error.
    """
    plain = {re.sub(r"^.*?(?=(?:conv|dense|last)\.)", "", k): v for k, v in state.items()}
    numbers = lambda part: sorted({int(m[1]) for k in plain if (m := re.match(rf"{part}\.(\d+)\.weight$", k))})
    return {
        "conv": [(plain[f"conv.{k}.weight"], plain[f"conv.{k}.bias"], int(plain.get(f"conv.{k}.padding", padding)), int(plain.get(f"conv.{k}.pool", 2))) for k in numbers("conv")],
        "dense": [tuple(plain[f"dense.{k}.{n}"] for n in ("weight", "bias", "gain", "offset", "mean", "var")) for k in numbers("dense")],
        "last": (plain["last.weight"], plain["last.bias"]),
    }


def load_weights(spark: SparkSession, path: str, padding: int = 0) -> dict:
    """Weights of one checkpoint, an archive of named arrays that Spark can read; pickled arrays are refused."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    if content is None:
        raise FileNotFoundError(path)
    with np.load(io.BytesIO(content[0]), allow_pickle=False) as arrays:
        return from_state(dict(arrays), padding)


def as_lists(x: np.ndarray) -> pa.Array:
    """A matrix as a column of lists, without a Python object per number."""
    edges = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(x).ravel()))


def predicted(patterns: DataFrame, weights: dict, id_col: str, vector_col: str, batch: int = 128, flat: bool = False) -> DataFrame:
    """(id, logits, features): logits and deep features in one pass over the patterns; with ``flat`` also the flattened output of the convolutions."""
    storage.bounded_batches(patterns.sparkSession)
    shared = patterns.sparkSession.sparkContext.broadcast(weights)
    names = ["id", "logits", "features", *(["flattened"] if flat else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                logits, inner, deep = forward(shared.value, sums.flat(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(as_lists, (logits, deep, *([inner] if flat else [])))], names)

    chosen = patterns.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>"))
    return chosen.mapInArrow(run, "id long, " + ", ".join(f"{n} array<double>" for n in names[1:]))
