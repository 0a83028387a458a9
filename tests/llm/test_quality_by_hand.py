"""The quality classifier against plain Python: statistics word by word, one system of equations, means of blocks."""

import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from prismflow.llm import quality, queries

SF = "/root/testdata/sf0.001"


def described(text):
    raw = text.encode()
    classes = [0] * 256
    for k, letters in enumerate(quality.CLASSES, 1):
        for letter in letters.encode():
            classes[letter] = k
    count = [0] * (quality.HIGH + 1)
    for byte in raw:
        count[quality.HIGH if byte >= 128 else classes[byte]] += 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size, lines = max(len(words), 1), max(len(raw), 1), count[5] + 1
    length = [min(len(w), 64) for w in words]
    mean = sum(length) / n
    times = {w: words.count(w) for w in set(words)}
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        *(np.sqrt(c / size) for c in count), np.log1p(n), mean, np.sqrt(max(sum(x * x for x in length) / n - mean**2, 0)), len(times) / n, np.sqrt(max(times.values(), default=0) / n),
        np.sqrt(same / n), np.sqrt(sum(len(w) == 1 for w in words) / n), np.sqrt(sum(w[:1].isupper() and w[0] < 128 for w in words) / n), np.log1p(size / lines), np.log1p(lines),
    ]


def calibrated(points):
    """Isotonic means by their definition: at each point the largest of the smallest means of blocks around it."""
    x, y, w = (np.array(v, float) for v in zip(*points, strict=True))
    mean = lambda v, a, b: (v[a:b] * w[a:b]).sum() / w[a:b].sum()
    n = len(x)
    fitted = [max(min(mean(y, a, b) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]
    knots, values, a = [], [], 0
    for k in range(1, n + 1):
        if k == n or fitted[k] - fitted[a] > 1e-12:
            knots.append(mean(x, a, k))
            values.append(fitted[a])
            a = k
    return knots, values


def by_hand(documents, labels):
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    stats = {d: np.array(described(t or "")) for d, t in documents}
    known = [(stats[d], y, fold(d)) for d, y in labels if d in stats and fold(d) != 2]
    x = np.array([s for s, _, _ in known])
    mean = x.mean(axis=0)
    scale = np.sqrt(np.maximum((x**2).mean(axis=0) - mean**2, 1e-6))
    model = quality.Model(mean, scale)
    features = lambda s: np.append(np.sqrt(2 / quality.N_FOURIER) * np.cos(np.clip((s - mean) / scale, -quality.CLIP, quality.CLIP) @ model.w + model.b), 1.0)
    z = np.array([features(s) for s, _, f in known if f != 3])
    y = np.array([v for _, v, f in known if f != 3], float)
    ridge = quality.RIDGE * max(len(z), 1) / quality.N_FOURIER
    beta = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    bins = {}
    for s, v, f in known:
        if f == 3:
            at = int(np.clip((features(s) @ beta + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1))
            bins.setdefault(at, []).append(v)
    knots, values = calibrated([((k + 0.5) / quality.BINS * 2 - 0.5, np.mean(v), len(v)) for k, v in sorted(bins.items())])
    out = {}
    for d, s in stats.items():
        raw = features(s) @ beta
        out[d] = (fold(d) == 2, float(np.clip(0.999 * np.interp(raw, knots, values) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_plain_python(spark):
    documents = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] in (0, 1)]
    expected = by_hand(documents, labels)
    got = queries.op7_quality(spark, SF).collect()
    assert len(got) == len(expected)
    for r in got:
        held_out, score = expected[r.doc_id]
        assert r.held_out == held_out
        assert r.score == pytest.approx(score, abs=2e-3)
    assert np.mean([abs(r.score - expected[r.doc_id][1]) for r in got]) < 1e-5
    assert sum(r.predicted != (expected[r.doc_id][1] >= quality.THRESHOLD) for r in got) == 0


def test_statistics_of_odd_texts():
    import pyarrow as pa

    from prismflow.llm import textkit as tk

    texts = ["", " ", "a", "A a A", "é É \x00", "x" * 300 + " " + "x" * 300, "\n\n\n", "1 2 2 2|\t!?", "word " * 5000]
    got = quality.statistics(tk.WordHasher(quick=True), pa.array(texts))
    assert np.allclose(got, [described(t) for t in texts], atol=1e-7)
