"""The fingerprint index over several sessions, and words that a weak hash would mistake."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import minhash_dedup, substring_dedup

WORDS = [f"w{k}" for k in range(3000)]


def documents(n):
    rng = random.Random(17)
    shared = [" ".join(rng.choices(WORDS, k=60)) for _ in range(6)]
    return [(k, " ".join(rng.choices(WORDS, k=80)) + "\n" + rng.choice(shared) + "  " + " ".join(rng.choices(WORDS, k=30))) for k in range(n)]


def by_hand(batches):
    """Words are cut if an earlier document, of this batch or one before, holds their window."""
    seen, out = set(), {}
    for batch in batches:
        for d, text in sorted(batch):
            words = text.split()
            windows = [tuple(words[k : k + 13]) for k in range(len(words) - 12)]
            gone = [False] * len(words)
            for k, w in enumerate(windows):
                if w in seen:
                    gone[k : k + 13] = [True] * 13
            seen.update(windows)
            out[d] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "GATHER", 3)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_three_sessions_equal_one(spark, tmp_path, small_steps):
    docs = documents(90)
    path = f"file://{tmp_path}/index"
    parts = [docs[60:], docs[:30], docs[30:60]]
    got = {}
    for part in parts:
        index = substring_dedup.FingerprintIndex(spark, path, 1 << 20)
        found = substring_dedup.digest_rows(index.add(frame(spark, part)))
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
        index.close()
    assert got == by_hand(parts) and sum(v[1] for v in got.values()) > 3000
    runs = lambda: storage.names_in(spark, f"{path}/runs/kind=run")
    assert len(runs()) == 3
    index = substring_dedup.FingerprintIndex(spark, path, 1 << 20)
    index.compact()
    assert runs() == ["step=4"] and index.state["runs"] == [4]
    more = [(1000 + d, t) for d, t in docs[::9]]
    again = {r.doc_id: r.n_removed for r in substring_dedup.digest_rows(index.add(frame(spark, more))).collect()}
    assert again == {d: len(t.split()) for d, t in more}
    index.close()


def test_an_unfinished_step_leaves_no_trace(spark, tmp_path, small_steps):
    docs = documents(40)
    path = f"file://{tmp_path}/index"
    index = substring_dedup.FingerprintIndex(spark, path, 1 << 20)
    index.add(frame(spark, docs[:20])).count()
    keep = storage.read_text(spark, f"{path}/state.json")
    index.add(frame(spark, docs[20:])).count()
    index.close()
    storage.write_text(spark, f"{path}/state.json", keep)
    index = substring_dedup.FingerprintIndex(spark, path, 1 << 20)
    got = {r.doc_id: r.n_removed for r in substring_dedup.digest_rows(index.add(frame(spark, docs[20:]))).collect()}
    assert got == {d: v[1] for d, v in by_hand([docs[:20], docs[20:]]).items() if d >= 20}
    index.close()


def test_history_does_not_move(spark, tmp_path, small_steps):
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", 1 << 20)
    index.add(frame(spark, documents(20))).count()
    earlier = index._kind("run", [1]).select("bucket", "marks", "chunks")
    marks = substring_dedup.marks_of(index._chunks([1]), index.buckets)
    joined = marks.groupBy("bucket").cogroup(earlier.groupBy("bucket")).applyInArrow(substring_dedup.merge_join, substring_dedup.RUN_SCHEMA)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    index.close()


def test_pipeline_form_against_an_index(spark, tmp_path, small_steps):
    docs = documents(30)
    path = f"file://{tmp_path}/index"
    table = frame(spark, docs).select(F.lit("x").alias("chunk"), "text", F.col("doc_id").alias("blob"), "doc_id")
    kept = {r.doc_id: r for r in substring_dedup.without_repeats(table, index_path=path).collect()}
    assert all(kept[d].blob == d and kept[d].chunk == "x" for d in kept)
    expected = by_hand([docs])
    assert {d: hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() for d, r in kept.items()} == {d: v[2] for d, v in expected.items() if v[1] < v[0]}
    assert substring_dedup.without_repeats(table, index_path=path).count() == 0


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_a_polynomial_hash_mistakes(spark):
    """Polynomial hashes modulo 2^64 with an odd base take these two words of 1024 letters for one."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([*WORDS[:6], w, *WORDS[6:12]])) for k, w in enumerate((one, two, one))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.digests(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 13}
    classes = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    assert classes == {0: 0, 1: 1, 2: 0}


def test_no_table_names_are_left_behind(spark):
    storage.clean(spark)
    docs = spark.createDataFrame([(k, f"{' '.join(map(str, range(20)))} {k}") for k in range(6)], "doc_id long, text string")
    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    substring_dedup.digests(docs)
    kept = substring_dedup.without_repeats(docs)
    assert kept.count() == 6
    storage.clean(spark)
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == before
