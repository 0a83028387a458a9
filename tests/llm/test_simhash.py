"""SimHash components against all pairs by hand; the Golay keys' guarantee; odd input; crowded keys."""

import os
import random
import re
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from prismflow.llm import queries, simhash_dedup

SF = "/root/testdata/sf0.001"


def print_by_hand(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", small)
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components_by_hand(rows):
    """{(id, fingerprint, component)} of (id, print) rows."""
    distinct = sorted({p for _, p in rows})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    x = np.array(distinct, np.uint64)
    for k, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= 2).tolist():
            parent[root(distinct[k + 1 + j])] = root(p)
    names = {}
    for i, p in rows:
        names.setdefault(root(p), set()).add(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in names.items()}
    return sorted(((i, f"{p:016x}", least[root(p)]) for i, p in rows), key=repr)


def got(frame):
    return sorted(((r[0], r["fingerprint"], r["component_id"]) for r in frame.collect()), key=repr)


def test_code_words_are_shared_up_to_two_errors():
    code = simhash_dedup.Golay()
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 1 << 23, 500)
    at, words = code.keys(vectors)
    assert set(np.bincount(at, minlength=500).tolist()) <= {1, 6}
    own = [set(words[at == k].tolist()) for k in range(500)]
    for places in [(), *combinations(range(23), 1), *combinations(range(23), 2)]:
        at, words = code.keys(vectors ^ sum(1 << b for b in places))
        assert {a for a, w in zip(at.tolist(), words.tolist(), strict=True) if w in own[a]} == set(range(500))


def test_fingerprints_share_a_key_up_to_two_errors():
    code, rng = simhash_dedup.Golay(), np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40, dtype=np.uint64)
    at, keys = simhash_dedup.golay_keys(prints, code)
    assert np.bincount(at).max() <= 18
    own = [set(keys[at == k].tolist()) for k in range(40)]
    for places in [*combinations(range(64), 1), *combinations(range(64), 2)]:
        at, keys = simhash_dedup.golay_keys(prints ^ np.uint64(sum(1 << b for b in places)), code)
        assert {a for a, w in zip(at.tolist(), keys.tolist(), strict=True) if w in own[a]} == set(range(40))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    expected = components_by_hand([(r["doc_id"], print_by_hand(r["text"])) for r in rows])
    assert got(queries.op11_simhash_dedup(spark, sf)) == expected
    assert any(i != c for i, _, c in expected)


@pytest.mark.parametrize("crowd", [2, 64])
def test_chains_and_crowds_of_fingerprints(spark, monkeypatch, crowd):
    """Rows whose fingerprints are planted: a chain of two-bit steps, a dense ball, and far ones."""
    pick = random.Random(5)
    prints, p = [], pick.getrandbits(64)
    for _ in range(30):
        prints.append(p)
        p ^= sum(1 << b for b in pick.sample(range(64), 2))
    ball = pick.getrandbits(64)
    prints += [ball ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 3))) for _ in range(400)]
    prints += [pick.getrandbits(64) for _ in range(200)] + [0, 1, 3, 7, 1 << 63]
    rows = list(enumerate(prints))
    pick.shuffle(rows)
    planted = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "id long, print long")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, *_: docs)
    assert got(simhash_dedup.components(planted, "id", "print", crowd)) == components_by_hand(rows)


def test_odd_rows(spark):
    long = " ".join(random.Random(1).choices(["aa", "bb", "cc", "dé"], k=90_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (5, "two words"), (None, "two  WORDS"), (7, "ÀÉ b c d"), (8, "àé b c d"), (9, long), (10, long), (None, "alone here now"), (12, "x\x1cy\x85z\xa0 b c")]
    schema = "doc_id long, text string, print long, key long, component_id long, a long"
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in texts], schema)
    found = simhash_dedup.components(docs)
    assert got(found) == components_by_hand([(d, print_by_hand(t)) for d, t in texts])
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash_dedup.components(docs.limit(0)).count() == 0
