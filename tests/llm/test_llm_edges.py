"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns; brute-force checks on small fixtures."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismflow.llm import byte_bpe, chat_format, components, decontamination, license_scan, minhash_dedup, neighbours, pool, quality, substring_dedup, textkit, token_files, url_filter

WORDS = [f"w{k}" for k in range(400)]
EXTRA = "id long, node long, chunk string, band string, text_a string, label string"


def prose(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with columns that clash with names used inside the operators."""
    base = prose(1, 300)
    near = base.replace(" w7 ", " other ", 1)
    long = prose(2, 60_000)
    rows = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n"), (None, prose(3, 50)), (7, long), (8, "one two"), (9, "one two"), (10, prose(4, 40) + " " + " ".join(base.split()[:60])), (11, prose(5, 200))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), d, d, "c", "b", "x", "l") for d, t in rows], schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def removed_by_hand(rows):
    first = {}
    split = [(d, (t or "").split(), t) for d, t in rows]
    for d, w, _ in sorted(split, key=lambda r: (r[0] is None, r[0] or 0)):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), math.inf if d is None else d)
    out = []
    for d, w, _ in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (math.inf if d is None else d):
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup(odd, none, batches):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in substring_dedup.digests(odd, batches=batches).collect()), key=repr)
    assert got == removed_by_hand(rows)
    assert substring_dedup.digests(none, batches=batches).count() == 0
    kept = substring_dedup.without_repeats(odd, batches=batches)
    assert kept.columns == odd.columns
    assert 2 not in {r.doc_id for r in kept.collect()}
    assert substring_dedup.without_repeats(none).count() == 0


def test_near_duplicates(odd, none):
    found = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(odd).collect()}
    assert found[1] == found[2] == found[3] == 1
    assert found[8] == found[9] == 8
    assert all(found[d] == d for d in (4, 5, 6, 7, 10, 11)) and found[None] is None
    assert minhash_dedup.near_duplicate_classes(none).count() == 0
    kept = minhash_dedup.one_per_class(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 5, 6, 7, 8, 10, 11, None], key=repr)
    assert sorted(r.doc_id for r in minhash_dedup.one_per_class(odd.where("doc_id = 2")).collect()) == [2]


@pytest.mark.parametrize("dealing", ["one", "by_text", "by_id", "default"])
def test_near_duplicates_of_ids_with_several_texts(spark, dealing):
    """20 ids with two unrelated texts each, the second one near the text of another id: no link is lost, however the rows lie."""
    rows = []
    for k in range(20):
        a, b = prose(7000 + k, 120), prose(8000 + k, 120)
        rows += [(100 + k, b), (100 + k, a), (500 + k, b.replace(b.split()[60], "other", 1))]
    rows += [(900, prose(1, 90)), (901, prose(1, 90)), (902, prose(2, 90)), (902, prose(3, 90)), (902, prose(3, 90)), (None, prose(2, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = {"one": docs.coalesce(1), "by_text": docs.repartition(5, "text"), "by_id": docs.repartition(3, "doc_id").sortWithinPartitions("doc_id", "text"), "default": docs}[dealing]
    got = sorted(((r.doc_id, r.class_id) for r in minhash_dedup.near_duplicate_classes(docs).collect()), key=repr)
    expected = [(i, 100 + i % 100) for i in (*range(100, 120), *range(100, 120), *range(500, 520))] + [(900, 900), (901, 900), (902, 902), (902, 902), (902, 902), (None, None)]
    assert got == sorted(expected, key=repr)


def test_near_duplicates_around_one_text(spark):
    """Copies that are near their source but not each other are one class, whatever the ids; so is a chain."""
    rng = random.Random(9)
    base = prose(6, 300).split()
    rows = [(50, " ".join(base))]
    for k in range(40):
        copy = base[:]
        for at in rng.sample(range(300), 5):
            copy[at] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    chain = prose(7, 300).split()
    for k in range(4):
        rows.append((100 + k, " ".join(chain)))
        for at in rng.sample(range(300), 5):
            chain[at] = f"step{k}x{at}"
    found = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    top = {d: d for d in shingles}
    for _ in range(50):
        for a in shingles:
            for b in shingles:
                both = len(shingles[a] & shingles[b])
                if both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both):
                    top[a] = top[b] = min(top[a], top[b])
    assert found == top


@pytest.mark.parametrize("block", [256, 20])
def test_near_duplicates_inside_a_large_group_below_the_threshold(spark, monkeypatch, block):
    """Pairs of similarity 0.802 among texts of mutual similarity 0.75, where no hub is linked to either."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(4)
    notice = " ".join(f"n{k}" for k in range(262))
    tail = lambda name, n: [f"{name}x{k}" for k in range(n)]
    rows = []
    for k in range(150):
        own = tail(f"p{k // 2}", 10) + tail(f"q{k}", 33) if k < 40 else tail(f"q{k}", 43)
        rows.append((k, notice + " " + " ".join(own)))
    ids = rng.sample(range(1000), len(rows))
    rows = [(ids[k], t) for k, t in rows]
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    top = {d: d for d in shingles}
    for a in shingles:
        for b in shingles:
            both = len(shingles[a] & shingles[b])
            if both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both):
                top[a] = top[b] = min(top[a], top[b])
    assert sum(d != c for d, c in top.items()) == 20
    found = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == top


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 2**63, 500, dtype=np.uint64)
    a, b = rng.gamma(2.0, 1.0, 500), rng.gamma(2.0, 1.0, 500)
    row = np.repeat([0, 1], 500)
    signature = minhash_dedup.dart_signatures(2, row, np.concatenate((element, element)), np.concatenate((a, b)), 1024)
    assert (signature[0] == signature[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.06)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (None, 4), (3, 20), (20, 21), (21, 22)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 21: 1, 22: 1, 8: 8, 9: 8, 7: 7}


def test_decontamination(spark, odd, none):
    item = " ".join(prose(11, 40).split())
    changed = item.split()
    changed[5], changed[20] = "xx", "yy"
    docs = spark.createDataFrame([(1, prose(12, 80) + " " + item.upper() + "!"), (2, "a " + " ".join(changed) + " b"), (3, prose(13, 300)), (4, None), (None, item), (5, "short item of just nine words is here now")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "item of just nine words is here now"), (10, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in decontamination.overlaps(docs, items).collect()}
    assert set(found) == {(1, 7), (2, 7), (None, 7), (5, 9)}
    assert found[1, 7] == (40, 40) and found[2, 7] == (40, 38)
    assert [r.doc_id for r in decontamination.without_leaks(docs, items).orderBy("doc_id").collect()] == [3, 4]
    assert decontamination.overlaps(none, items).count() == 0 == decontamination.overlaps(docs, items.limit(0)).count()
    assert decontamination.without_leaks(odd, items).columns == odd.columns


@pytest.mark.parametrize("handed_out", [0, 200_000])
def test_decontamination_by_either_join(spark, monkeypatch, handed_out):
    """Few keys are handed out, many are joined after a filter: the same rows either way, copies and null ids included."""
    monkeypatch.setattr(decontamination, "HANDED_OUT", handed_out)
    items = spark.createDataFrame([(k, prose(20 + k, 30)) for k in (0, 1, 2, 3, 4, 4)], "item_id long, text string")
    rows = [(k, prose(90, 20) + " " + prose(20 + k, 30)) for k in range(5)] + [(None, prose(90, 20) + " " + prose(22, 30)), (7, prose(91, 50)), (8, None)]
    docs = spark.createDataFrame([(d, t, d, "k", 0) for d, t in rows * 2], "doc_id long, text string, item long, key string, may int")
    found = [(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, items).collect()]
    assert sorted(found, key=repr) == sorted([(k, k) for k in (0, 1, 2, 3, 4, 4)] * 2 + [(None, 2)] * 2, key=repr)
    kept = decontamination.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [7, 7, 8, 8]


def test_decontamination_of_repetitive_texts(spark):
    """Texts that repeat a few words are compared at every shift; ties go to the smallest shift."""
    item, text = "a b " * 400, "x " + "a b " * 3000 + "y"
    long = "so " * 30_000 + " ".join(prose(33, 20).split()) + " no" * 30_000
    docs = spark.createDataFrame([(1, text), (2, long), (3, "a c " * 4000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, prose(33, 20)), (3, "a b " * 7)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_equal) for r in decontamination.overlaps(docs, items).collect()}
    assert got == {(1, 1): (1, 800, 800), (1, 3): (1, 14, 14), (2, 2): (30_000, 20, 20)}


def test_byte_bpe_on_odd_texts(spark, odd, none):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = byte_bpe.read_ranks(path)
    table = byte_bpe.PerfectHash(tokens)
    assert sorted(table.rank.tolist()) == list(range(len(tokens)))
    assert table(tokens).tolist() == list(range(len(tokens)))
    assert (table([b"no such token at all", b""]) == -1).all()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    codec = byte_bpe.Codec(tokens, table, pattern)
    rng = random.Random(2)
    texts = ["", "a" * 5000, "aaab" * 700, " \n\n  x", "<|endoftext|>", "日本語🙂é"] + ["".join(rng.choice("ab é\n'st1!\U0001f642") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    rows = {r.doc_id: r.n_tokens for r in byte_bpe.digests(odd, path, pattern).collect()}
    assert rows[4] == rows[5] == 0
    assert byte_bpe.encoded(none, path, pattern).count() == 0


def test_pool_forgets_but_stays_right():
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return np.array([ord(c) for p in pieces for c in p], np.uint32), np.array([len(p) for p in pieces])

    memo = pool.Pool(encode, limit=3)
    for pieces in (["a", "bc", "a"], ["d", "e", "bc"], ["", "a"], []):
        ids, sizes = memo(pieces)
        assert "".join(map(chr, ids)) == "".join(pieces) and sizes.tolist() == [len(p) for p in pieces]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20), max_size=400), st.integers(1, 49408))
def test_segments_round_trip(values, high):
    ids = np.array(values, np.int64) % high if len(values) % 2 else np.array(values, np.int64)
    sizes = np.array([len(ids)])
    data = token_files.write_segment(np.array([token_files.NULL_ID]), sizes, ids)
    segment = token_files.Segment(data)
    assert segment.ids().tolist() == ids.tolist()
    for k in range(segment.blocks):
        assert segment.read_block(k).tolist() == ids[k * 128 : k * 128 + 128].tolist()


@pytest.mark.parametrize("control_as_text", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_equals_the_library(name, control_as_text):
    """Texts of one script, of several, and with control strings; a model that the encoder knows, and one that it does not."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = control_as_text
    encode = token_files.WordEncoder(path, control_as_text)
    assert encode.known == name.startswith("word")
    rng = random.Random(5)
    letters = list("abC éÉñ'.,!<|>_-= \n\t  ̸́★☆1²中🙂İΣσ’") + ["'s", "<|endoftext|>", "é.", "..."]
    narrow = list("abCdE éÉñßŒœŉſĸµªº'.,!<|>_-= \n\t\r\x0b\x0c\x00\x1b~¬¶÷×§12²½¼0") + ["'s", "'LL", "'Re", "<|endoftext", "é.", "...", "  "]
    more = [chr(c) for c in range(1, 0x180)]
    texts = ["".join(rng.choice(of) for _ in range(rng.randint(0, 50))) for of in (letters, narrow, more, letters[:9]) for _ in range(400)]
    ids, sizes = encode(texts)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_token_files_on_odd_rows(spark, odd, none, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(odd, path, f"file://{tmp_path}/a", shard_bytes=200)
    rows = token_files.digests(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])))[:-1].tolist()
    assert [r.n_tokens for r in rows if r.doc_id in (4, 5, 6)] == [1, 1, 1]
    token_files.write_token_files(none, path, f"file://{tmp_path}/b")
    assert token_files.digests(spark, f"file://{tmp_path}/b").count() == 0


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (7, 5), (None, 1)], "doc_id long, quality int")
    rows = quality.scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert quality.scores(none, labels).count() == 0
    assert {r.score for r in quality.scores(odd, labels.limit(0)).collect()} == {1.0}
    assert quality.accepted(odd, labels.limit(0)).count() == odd.count()


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3.5]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\\<|>s/[]INSTk\n", max_size=30), st.text(alphabet="us\n<|\\>", max_size=8))
def test_chat_turn_round_trip(text, role):
    formatted, start, end, _ = chat_format.format_turn(role, [{"type": "text", "text": text}])
    assert chat_format.parse_turn(formatted) == (role, [("text", text)] if text else [])
    inside = formatted[start:end]
    assert not any(c in inside for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]"))
    assert chat_format.unescape(inside) == text


def test_chat_attachments(spark):
    part = lambda kind, **more: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more
    parts = [part("text", text="see "), part("image", ref="i.png", width=57, height=28), part("audio", ref="a.wav", seconds=2.0), None, part("document", ref="d.pdf", pages=3), part("text", text="<|image 0|>")]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (None, None, None, [])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    turns = {r.role: r for r in chat_format.formatted_turns(rows).collect()}
    found = turns["user"].attachments
    assert [(a.kind, a.ordinal, a.ref, a.tokens) for a in found] == [("image", 0, "i.png", 3), ("audio", 1, "a.wav", 25), ("document", 2, "d.pdf", 3072)]
    assert [turns["user"].formatted[a.start : a.end] for a in found] == ["<|image 0|>", "<|audio 1|>", "<|document 2|>"]
    assert chat_format.parse_turn(turns["user"].formatted)[1][-1] == ("text", "<|image 0|>")
    assert chat_format.digests(chat_format.formatted_turns(rows)).count() == 2
    assert chat_format.digests(chat_format.formatted_turns(rows.limit(0))).count() == 0
    bad = rows.limit(1).withColumn("parts", F.transform("parts", lambda p: p.withField("type", F.lit("video"))))
    with pytest.raises(Exception, match="unknown content part"):
        chat_format.formatted_turns(bad).collect()


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/")]


def test_url_aliases(spark):
    rows = [
        (1, "http://a.org/es/1", '<link href="http://b.info/x" rel=canonical>'),
        (2, "HTTP://B.info/x#f", None),
        (3, "http://c.info/y", '<meta http-equiv="refresh" content="0; url=/z">'),
        (4, "http://c.info/z", '<LINK rel="canonical" href="//b.info/x">'),
        (5, None, "canonical"),
        (6, "nope", "http-equiv"),
        (7, "http://d.info/", "<link rel='canonical' href='http://q.example.com/en/70'>"),
        (8, "http://d.info/", "<link rel='canonical' href='http://q.com/en/'>"),
        (9, "http://q.com:80/en/?x", ""),
        (9, "http://q.com/en/?x", ""),
    ]
    pages = spark.createDataFrame([(*r, "n", "h") for r in rows], "page_id long, url string, html string, node string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, url_filter.link_edges(pages), RULES).orderBy("page_id", "host").collect()]
    assert [(g[0], g[3], g[4]) for g in got] == [
        (1, "org/es/", "block"), (2, None, "block"), (3, None, "block"), (4, None, "block"), (5, None, "allow"), (6, None, "allow"),
        (7, None, "allow"), (8, None, "allow"), (9, "com/en/", "block"), (9, None, "allow"),
    ]
    assert got[4][1:3] == got[5][1:3] == ("", "")
    assert url_filter.judged(pages.limit(0), url_filter.link_edges(pages.limit(0)), RULES).count() == 0


def test_joined_rules_equal_literal_rules(spark):
    urls = spark.createDataFrame([(h, p) for h in ("com", "a.com", "xcom", "example.com", "z.example.com", "") for p in ("/en/", "/en/7", "/", "")], "host string, path string")
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    joined = {(r.host, r.path): tuple(r.fit) for r in url_filter.rules_joined(urls, table).collect()}
    literal = {(r.host, r.path): tuple(r.fit) for r in urls.withColumn("fit", url_filter.rule_for(F.col("host"), F.col("path"), RULES)).collect() if r.fit}
    assert joined == literal and literal


def test_url_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x")], "page_id long, url string, html string")
    plan = url_filter.judged(pages, url_filter.link_edges(pages), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences(spark, odd, none):
    families = [f for f in license_scan.NOTICES for _ in license_scan.templates(f)]
    rows = list(enumerate(t for f in license_scan.NOTICES for t in license_scan.templates(f)))
    others = [(1000 + k, t) for k, t in enumerate(license_scan.OTHERS)]
    extra = [(2000, None), (2001, ""), (None, "x\nReleased under the MIT License.\ny"), (2002, "Mit dem Hund."), (2003, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")]
    found = license_scan.licences(spark.createDataFrame(rows + others + extra, "doc_id long, text string"))
    got = {(r.doc_id, r.paragraph): r.family for r in found.collect()}
    assert sum(got[k, 0] == f for k, f in enumerate(families)) >= 0.99 * len(families)
    assert all(got[k, 0] in (f, "unknown") for k, f in enumerate(families))
    assert all(got[d, 0] == "unknown" for d, _ in others)
    assert got[None, 1] == "mit" and got[2003, 0] == got[2003, 1] == "cc-by-nc"
    assert not {d for d, _ in got} & {2000, 2001, 2002}
    assert license_scan.licences(none).count() == 0
    clashing = odd.withColumn("lines", F.lit("l")).withColumn("x", F.lit(1))
    assert license_scan.licences(clashing).count() == license_scan.licences(odd).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_neighbours_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.8, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(d, v, d, 0) for d, v in rows], "vec_id long, embedding array<float>, id long, block int")
    got = neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (0, 4, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 2)]
    assert neighbours.nearest_neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def exact_neighbours(rows, k=10):
    """(query, rank, id, score) over all rows, for ids divisible by 100."""
    out = []
    for q in sorted({d for d, _ in rows if d % 100 == 0}):
        query = np.array(min(v for d, v in rows if d == q), float)
        near = sorted((float(np.sqrt(((np.array(v, float) - query) ** 2).sum())), d) for d, v in rows if d != q)
        out += [(q, r + 1, d, s) for r, (s, d) in enumerate(near[:k])]
    return out


def compared(got, expected):
    """Share of exact neighbours found; every score is checked."""
    scores = {}
    for q, _, d, s in expected:
        scores.setdefault(q, {})[d] = s
    hits = 0
    for r in got:
        if r.vec_id in scores.get(r.query_id, {}):
            hits += 1
            assert r.score == pytest.approx(scores[r.query_id][r.vec_id], rel=1e-12)
    return hits / len(expected)


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERY_GROUP", 5)
    x = np.random.default_rng(8).normal(size=(2000, 24)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0")).collect()
    assert len(got) == 200 and compared(got, exact_neighbours(rows)) >= 0.9
    assert sum(r.verified for r in got if r["rank"] == 1) < 0.4 * 20 * 2000


def test_neighbours_of_copies_and_clusters(spark, monkeypatch):
    """A third of all rows holds one vector, another third lies close together; copies come by id, nothing is lost among them."""
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 200)
    rng = np.random.default_rng(3)
    middle, x = rng.normal(size=16), rng.normal(size=(900, 16))
    rows = [(int(d), (x[0] if k < 300 else middle + x[k] * 0.01 if k < 600 else x[k]).tolist()) for k, d in enumerate(rng.permutation(900))]
    rows += [(100, rows[0][1])] * 3 + [(5000, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0")).collect()
    expected = [e for e in exact_neighbours([r for r in rows if r[0] != 5000])]
    assert not [r for r in got if r.query_id == 5000]
    assert len(got) == len(expected) and compared(got, expected) >= 0.9
    at_zero = {(q, r): d for q, r, d, s in expected if s == 0}
    assert at_zero and {(r.query_id, r["rank"]): r.vec_id for r in got if r.score == 0} == at_zero


def test_neighbours_with_a_vector_that_most_rows_share(spark):
    rows = [(k, [1.0, 0.0]) for k in range(3000)] + [(5, [1.0, 0.0])] * 400 + [(k, [1.0, float(k)]) for k in range(5000, 5030)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    asked = vectors.where("vec_id in (0, 5, 7, 2999, 5000)").distinct()
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(vectors, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hot = [0, 1, 2, 3, 4, *[5] * 10]
    assert got[0] == [(i, 0.0) for i in hot[1:11]] and got[5] == [(i, 0.0) for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10)]
    assert got[7] == got[2999] == [(i, 0.0) for i in hot[:10]]
    assert [i for i, _ in got[5000]] == list(range(5001, 5011))


def test_very_long_texts_and_clashing_columns(spark):
    """One line and one turn of a megabyte; columns called like those inside."""
    long = " ".join(random.Random(8).choices(WORDS, k=200_000))
    docs = spark.createDataFrame([(1, long + " Released under the MIT License", 5, 6), (2, "Released under the MIT License.", 7, 8)], "doc_id long, text string, id long, item_id long")
    assert 2 in {r.doc_id for r in license_scan.licences(docs).collect()}
    passage = " ".join(long.split()[1000:1030])
    items = spark.createDataFrame([(3, passage, 1, 2)], "item_id long, text string, doc_id long, id long")
    assert [(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, items).collect()] == [(1, 3)]
    turns = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", long, 2)], "conv_id long, turn long, role string, text string, parts long")
    row = chat_format.digests(chat_format.formatted_turns(chat_format.text_parts(turns.select("conv_id", "turn", "role", "text")))).first()
    assert row.loss_chars == len(long) and row.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_neighbours_among_few(spark):
    rows = [(100 * k, [float(k), 1.0]) for k in range(7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest_neighbours(vectors, vectors).collect()]
    assert sorted(got) == sorted(exact_neighbours(rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.\n\t\x0b,z", max_size=20)), min_size=1, max_size=8))
def test_word_kernel(texts):
    column = pa.array(["x", *texts], pa.string()).slice(1)
    raw, offsets = textkit.text_bytes(column)
    starts, ends, first = textkit.word_spans(raw, offsets, textkit.separators("space"))
    words = [[bytes(raw[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert words == [(t or "").split() if t is None or not any(c in t for c in "\x1c\x85") else None for t in texts]
    hashes = textkit.WordHasher()(raw, starts, ends)
    flat = [w for row in words for w in row]
    assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
