"""Each stage of the corpus pipeline on odd input, and its result against what the operator's rule says."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismflow import storage

WORDS = [f"w{k}" for k in range(500)]
STAGES = dict(corpus_pipeline.STAGES)


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, copies, near copies, shared passages, leaks and columns with clashing names."""
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    base, item = prose(1, 300), prose(50, 40)
    rows = [
        (1, base), (2, base), (3, base.replace(" w7 ", " other ")), (4, None), (5, ""), (6, " \n "), (None, prose(2, 80)), (None, None), (7, prose(3, 40_000)),
        (8, "one two"), (9, prose(4, 60) + " " + " ".join(base.split()[:60])), (10, prose(5, 50) + "\n" + item), (10, prose(6, 70)), (11, prose(7, 90)), (11, prose(7, 90)),
    ]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or ""), 1, "n", "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id int, node string, key string")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in (1, 3, 7, 11)] + [(None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_no_rows(spark, folder, docs, name):
    out = STAGES[name](spark, docs.limit(0), folder)
    assert out.count() == 0
    if name != "byte_bpe":
        assert out.columns == docs.columns


def test_quality_keeps_all_if_all_labels_are_good(spark, folder, docs):
    out = STAGES["quality"](spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == ids(docs)


def test_near_dedup_keeps_one_of_each_group(spark, folder, docs):
    out = STAGES["near_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    assert ids(out) == sorted([1, 4, 5, 6, 7, 8, 9, 10, 11, None, None], key=repr)


def test_substring_dedup_cuts_the_later_passage(spark, folder, docs):
    out = STAGES["substring_dedup"](spark, docs, folder)
    got = {r.doc_id: r for r in out.collect() if r.doc_id in (1, 2, 5, 7, 9)}
    assert out.columns == docs.columns and set(got) == {1, 5, 7, 9}
    assert got[1].text == prose(1, 300) and got[9].text == prose(4, 60) and got[9].n_chars == len(prose(4, 60))
    storage.clean(spark)


def test_decontamination_drops_leaks(spark, folder, docs):
    out = STAGES["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count() - 1
    assert not out.where(F.col("text").contains(prose(50, 40))).count()


def test_encoding_gives_back_every_text(spark, folder, docs):
    import hashlib

    out = STAGES["byte_bpe"](spark, docs, folder)
    expected = sorted((hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()))
    assert sorted(r.decoded_sha256 for r in out.collect()) == expected


def test_run_over_odd_tables(spark, folder):
    got = ids(corpus_pipeline.run(spark, folder))
    assert 2 not in got and {1, 4, 5, 7, 8, 9, 11} <= set(got)
