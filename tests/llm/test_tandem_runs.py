"""Runs against a direct search over all periods; the steps of the method; odd input."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from prismflow.llm import queries, tandem_runs

SF = "/root/testdata/sf0.001"


def runs_by_hand(words, least=6, times=4):
    """{(start, length, period)}: every period's maximal stretches, smallest periods only."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, found = len(x), []
    for q in range(1, n // times + 1):
        same = np.concatenate(([0], x[q:] == x[:-q], [0])).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            length = b - a + q
            if length < max(least, times * q):
                continue
            if not any((x[a : a + length - p] == x[a + p : a + length]).all() for p in range(1, q) if q % p == 0):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest_by_hand(doc, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_hand(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None, None, None, None)
    if runs:
        s, length, q = min(runs, key=lambda r: (-1.0 * r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(frame):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[c] for c in names) for r in frame.collect()), key=repr)


def own_runs(sequence):
    return list(zip(*(x.tolist() for x in tandem_runs.runs_of(np.array(sequence, np.int64))), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 2), max_size=60), st.builds(lambda a, b, c, n: a + (b * n) + c, *[st.lists(st.integers(0, 2), max_size=7)] * 3, st.integers(1, 9))))
@example([0] * 40)
@example([0, 1] * 20 + [2] + [0, 1] * 5)
def test_runs_of_small_alphabets(sequence):
    assert own_runs(sequence) == runs_by_hand(sequence)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=6, max_size=40))
def test_vocabulary_holds_every_square_once(sequence):
    tree = tandem_runs.SuffixTree(np.array(sequence, np.int64))
    low, high, period = tandem_runs.vocabulary(tree)
    got = sorted(tuple(sequence[int(tree.order[a]) : int(tree.order[a]) + 2 * int(q)]) for a, q in zip(low, period, strict=True))
    n, kinds = len(sequence), {}
    for k in range(1, n // 2 + 1):
        for i in range(n - 2 * k + 1):
            w = sequence[i : i + k]
            if w == sequence[i + k : i + 2 * k] and not any(w == w[:d] * (k // d) for d in range(1, k) if k % d == 0):
                kinds.setdefault(tuple(w + w), []).append(i)
    assert got == sorted(kinds)
    where = {tuple(sequence[int(tree.order[a]) : int(tree.order[a]) + 2 * int(q)]): sorted(tree.order[a : b + 1].tolist()) for a, b, q in zip(low, high, period, strict=True)}
    assert where == kinds


def test_blocks_are_earlier_sequences():
    sequence = random.Random(2).choices("ab", k=200)
    tree = tandem_runs.SuffixTree(np.array([ord(c) for c in sequence], np.int64))
    line, at = "".join(sequence), 0
    for begin in tandem_runs.blocks(tree).tolist():
        assert begin == at
        size = max((k for k in range(1, len(line) - at + 1) if line.find(line[at : at + k], 0, at + k - 1) != -1), default=1)
        at += size
    assert at == len(line)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=6))
def test_many_texts_at_once(texts):
    words = np.array([ord(c) for t in texts for c in t], np.uint64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = list(zip(*(x.tolist() for x in tandem_runs.runs_in_texts(words, first)), strict=True))
    assert found == [(k, *r) for k, t in enumerate(texts) for r in runs_by_hand(t)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_all_periods(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = sorted((digest_by_hand(r["doc_id"], r["text"]) for r in table), key=repr)
    assert rows(queries.op12_tandem_runs(spark, sf)) == expected
    assert any(r[1] for r in expected)


def test_odd_rows(spark, monkeypatch):
    pick = random.Random(3)
    long = " ".join(f"w{pick.randrange(50)}" for _ in range(9000)) + " x y z" * 1000 + " end"
    nested = ("a a a a a a a b " * 6 + "c ") * 5
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ha " * 6), (5, "ha " * 5), (None, "la di " * 9), (7, nested), (7, nested), (8, long), (9, "é\x1cb ü\n" * 7 + "end"), (10, "word " * 70_000)]
    docs = spark.createDataFrame([(d, t, "r", 1, 2, 3, 4) for d, t in texts], "doc_id long, text string, runs string, h long, n long, period long, collapsed long")
    monkeypatch.setattr(tandem_runs, "SLICE", 5000)
    expected = sorted((digest_by_hand(d, t) for d, t in texts), key=repr)
    assert rows(tandem_runs.digests(tandem_runs.with_periods(docs))) == expected
    assert tandem_runs.digests(tandem_runs.with_periods(docs.limit(0))).count() == 0
    whole = {(r.doc_id, r.n_words, r.kept_words): r.collapsed for r in tandem_runs.collapsed(docs).collect()}
    assert whole[5, 6, 1] == "ha" and whole[5, 5, 5] == "ha ha ha ha ha" and whole[1, 0, 0] == ""
