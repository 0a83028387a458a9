import base64
import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import duck, same_rows

from prismflow.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name])


def test_op2_against_all_alignments(spark, documents):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    number = collections.defaultdict(lambda: len(number))
    items = [(r["item_id"], np.array([number[w] for w in words(r["text"])])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    expected = set()
    for doc, text in documents:
        w = np.array([number[x] for x in words(text)])
        for item, t in items:
            if min(len(w), len(t)) < 13:
                continue
            same = w[:, None] == t[None, :]
            for shift in range(-(len(t) - 13), len(w) - 12):
                total = np.concatenate(([0], np.cumsum(np.diagonal(same, -shift))))
                if len(total) > 13 and (total[13:] - total[:-13]).max() >= 11:
                    expected.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, SF).collect()}
    assert got == expected and expected


def test_op4_against_tiktoken(spark, documents):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op4_byte_bpe(spark, SF).collect()}
    assert len(got) == len(documents)
    for doc, text in documents:
        ids = encoding.encode_ordinary(text)
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op6_against_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.op6_token_files(spark, SF).collect()}
    start = 0
    for doc, text in documents:
        ids = [*model.encode(text, add_special_tokens=False).ids, 1]
        assert (got[doc].start, got[doc].n_tokens) == (start, len(ids))
        assert got[doc].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op7_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.op7_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(x.held_out for x, _ in held) and all(0 <= x.score <= 1 for x in rows.values())
    assert all(x.predicted == (x.score >= 0.7) for x in rows.values())
    assert np.mean([x.predicted == y for x, y in held]) > 0.95


def test_op9_finds_each_licence_line(spark, documents):
    lines = {(d, i): line for d, t in documents for i, line in enumerate(t.split("\n")) if re.search("licensed under|under the mit license", line, re.I)}
    names = {"Apache": "apache-2.0", "MIT": "mit", "GNU": "gpl", "BY-NC": "cc-by-nc"}
    got = {(r.doc_id, r.paragraph): r.family for r in queries.op9_license_scan(spark, SF).collect() if r.family != "unknown"}
    assert got == {k: next(f for w, f in names.items() if w in line) for k, line in lines.items()} and got


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_op10_recall(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    got = collections.defaultdict(dict)
    verified = {}
    for r in queries.op10_neighbours(spark, sf).collect():
        verified[r.query_id] = r.verified
        got[r.query_id][r.rank] = (r.score, r.vec_id)
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [got[q][k] for k in range(1, 11)] == sorted(got[q].values())
        hits += len({ids[i] for i in best} & {v for _, v in got[q].values()})
    assert hits >= 0.95 * 10 * len(got)
    assert np.mean(list(verified.values())) < 0.6 * len(ids)


def test_pipeline_against_its_stages(spark, documents):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    good = {r.doc_id for r in queries.op7_quality(spark, SF).collect() if r.predicted}
    assert set(got) <= good
    leaks = {r.doc_id for r in queries.op2_decontamination(spark, SF).collect()}
    assert not set(got) & leaks
    assert len(got) > 0.5 * len(documents)
    texts = dict(documents)
    whole = [d for d, r in got.items() if r.decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest()]
    assert len(whole) > 0.5 * len(got)
