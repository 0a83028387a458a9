"""Quality classifier: random Fourier features over document statistics, ridge fit, isotonic calibration.

Every text is described by ``N_STATS`` statistics of its bytes and words. Standardised statistics x become
cos(xW + b) with Gaussian W, whose inner products approximate a Gaussian kernel. Ridge weights come from
normal equations summed per partition and then in a tree, so the driver receives a few small matrices
whatever the number of rows. Folds are crc32(id as text) mod 4: fold 2 is held out, folds 0 and 1 fit the
weights, fold 3 calibrates them by isotonic regression on scores counted in ``BINS`` bins.

Defined results for odd input: null text counts as empty; a null id is not held out and not learned from; rows whose
label is null or neither 0 nor 1 are not learned from; several labels of a document count as several rows; with no
label of one class every score is the share of label 1, and 1 if there are no labels at all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import textkit as tk

N_FOURIER, RIDGE, WIDTH, CLIP, BINS, SEED = 384, 1e-3, 4.0, 6.0, 2048, 20240
THRESHOLD = 0.7
N_STATS = 22
#: Byte classes of the statistics: every other byte is in class 0.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "|", "#$%&*@^~=+", "'\"()[]{}-_/\\<>`")
HIGH = len(CLASSES) + 1


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, letters in enumerate(CLASSES, 1):
        table[np.frombuffer(letters.encode(), np.uint8)] = k
    table[128:] = HIGH
    return table


def statistics(hasher: tk.WordHasher, column: pa.Array) -> np.ndarray:
    """Rows x ``N_STATS`` finite numbers."""
    raw, offsets = tk.text_bytes(column)
    n = len(offsets) - 1
    width = HIGH + 1
    row = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(offsets))
    count = np.bincount(row + _classes()[raw], minlength=n * width).reshape(n, width).astype(float)
    size = np.maximum(count.sum(axis=1), 1)
    share = count / size[:, None]
    starts, ends, first = tk.word_spans(raw, offsets, tk.separators("space"))
    words = hasher(raw, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    total = np.maximum(np.diff(first), 1).astype(float)
    length = np.minimum(ends - starts, 64).astype(float)
    mean = np.bincount(of, length, n) / total
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / total - mean**2, 0))
    order = np.lexsort((words, of))
    w, o = words[order], of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate((at, [len(w)])))
    most = np.zeros(n)
    np.maximum.at(most, o[at], times)
    same = np.zeros(len(words), bool)
    if len(words):
        same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    lone = ends - starts == 1
    capital = _classes()[raw[starts]] == 2 if len(starts) else np.zeros(0, bool)
    lines = count[:, 5] + 1
    columns = [
        *(np.sqrt(share[:, k]) for k in range(width)),
        np.log1p(total),
        mean,
        spread,
        np.bincount(o[at], minlength=n) / total,
        np.sqrt(most / total),
        np.sqrt(np.bincount(of, same, n) / total),
        np.sqrt(np.bincount(of, lone, n) / total),
        np.sqrt(np.bincount(of, capital, n) / total),
        np.log1p(size / lines),
        np.log1p(lines),
    ]
    return np.column_stack(columns)


def stats_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats as packed doubles)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher(quick=True)
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1), 1 << 20):
                found = statistics(hasher, batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "stats"])

    return storage.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(tk.tidy(emit), "id long, stats binary")


def _matrix(column: pa.Array, width: int = N_STATS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` numbers, added per partition and then in a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in table["total"].to_pylist():
            total += np.frombuffer(x)
        return pa.table({"part": table["part"].combine_chunks()[:1] if table.num_rows else pa.array([], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(tk.tidy(add), "part long, total binary")
    for parts in (256, 8):
        sums = sums.groupBy(F.pmod("part", F.lit(parts)).alias("group")).applyInArrow(tk.tidy_group(merge), "part long, total binary")
    return sum((np.frombuffer(r.total) for r in sums.select("total").collect()), np.zeros(size))


class Model:
    """A fitted scorer; plain arrays, so it travels in closures."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(N_STATS, N_FOURIER)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, N_FOURIER)
        self.beta = np.zeros(N_FOURIER + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        return np.column_stack((np.sqrt(2 / N_FOURIER) * np.cos(x @ self.w + self.b), np.ones(len(x))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x: block centres and block means."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fold(id_col: str):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    rows = storage.cut(stats.join(known.where(fold("id") != 2), "id").select("stats", "label", fold("id").alias("fold")), known.count(), 50_000)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        y = batch.column(1).to_numpy()
        return np.concatenate(([len(y), y.sum()], x.sum(axis=0), (x**2).sum(axis=0)))

    sums = _summed(rows, 2 + 2 * N_STATS, moments)
    n, ones = sums[:2]
    mean = sums[2 : 2 + N_STATS] / max(n, 1)
    model = Model(mean, np.sqrt(np.maximum(sums[2 + N_STATS :] / max(n, 1) - mean**2, 1e-6)))
    if not 0 < ones < n:
        model.constant = float(ones / n) if n else 1.0
        return model
    d = N_FOURIER + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    train = rows.where("fold <> 3")
    sums = _summed(train, d * d + d, equations)
    gram = sums[: d * d].reshape(d, d)
    model.beta = np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1) * np.eye(d) / N_FOURIER, sums[d * d :])

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(), BINS))).astype(float)

    sums = _summed(rows.where("fold = 3"), 2 * BINS, counts)
    weight, total = sums[:BINS], sums[BINS:]
    full = np.flatnonzero(weight)
    if len(full):
        model.knots, model.values = isotonic((full + 0.5) / BINS * 2 - 0.5, total[full] / weight[full], weight[full])
    return model


def _score_columns(stats: DataFrame, model: Model, id_col: str) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["id", "score"])

    scored = stats.mapInArrow(tk.tidy(emit), "id long, score double")
    held_out = F.coalesce(fold("id") == 2, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: id, held_out, score (higher: label 1 likelier), predicted."""
    storage.bounded_batches(docs.sparkSession)
    stats = storage.cut(stats_table(docs, id_col, text_col))
    return _score_columns(stats, fit(stats, labels, id_col, label_col), id_col)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1."""
    storage.bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col)).where(fold(id_col) != 2).distinct()
    model = fit(stats_table(docs.join(known, id_col, "left_semi"), id_col, text_col), labels, id_col, label_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher(quick=True)
        for batch in batches:
            for a, b in tk.text_slices(batch.column(at), 1 << 20):
                rows = batch.slice(a, b - a)
                yield rows.filter(pa.array(model.score(statistics(hasher, rows.column(at))) >= THRESHOLD))

    return storage.spread(docs).mapInArrow(tk.tidy(keep), docs.schema)
