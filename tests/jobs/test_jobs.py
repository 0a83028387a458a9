"""The two jobs: equality with SQL, odd rows, reruns, failures between two writes, growing input, and the command line."""

import hashlib
import json
import logging
import os
import subprocess
import sys

import numpy as np
import pytest
from compare import duck, same_rows

from jobs import common, dataset_release, pattern_inbox, queries
from prismflow.operators import evaluate, split

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@given
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name])


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def written(spark, path):
    """Every row of every table of a release."""
    return {name: rows(dataset_release._table(spark, f"{path}/{name}", name) if name in dataset_release.SCHEMAS else spark.read.parquet(f"{path}/{name}")) for name in dataset_release.TABLES}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Paths of odd documents and labels; columns that clash with names used inside come along."""
    at = tmp_path_factory.mktemp("odd")
    docs = [(k, f"text {k}", "en" if k % 3 else None, "hot" if k % 4 else f"s{k % 8}") for k in range(60)]
    docs += [(None, "no id", "en", "hot"), (5, "text 5", "en", "hot"), (70, None, "en", "hot"), (71, " \n", "de", None), (72, "ok", "de", None), (73, "ok", "de", None)]
    labelled = [(k, str(k % 2)) for k in range(50) if k % 5] + [(72, "1"), (73, "1.0"), (7, "1"), (8, "1"), (9, "1"), (9, "1"), (10, "x"), (15, " "), (20, "-1"), (25, "2.5"), (None, "1"), (900, "0"), (5, "1")]
    spark.createDataFrame([(*d, 1, "r", 2) for d in docs], "doc_id long, text string, lang string, source string, rank int, class string, n int").write.parquet(f"{at}/documents")
    spark.createDataFrame([(*x, 3, "p") for x in labelled], "doc_id long, quality string, label int, problem string").write.parquet(f"{at}/labels")
    return str(at), docs, labelled


def release_by_hand(docs, labelled):
    ids = [d[0] for d in docs]
    fine = {d[0]: d for d in docs if d[0] is not None and ids.count(d[0]) == 1 and (d[1] or "").split()}
    bad = {("documents", None, "no id"), ("documents", 5, "repeated id"), ("documents", 70, "no word"), ("documents", 71, "no word")}
    seen = {}
    for d, raw in labelled:
        try:
            value = float(raw)
        except ValueError:
            bad.add(("labels", d, "not numeric" if raw.strip() else "empty"))
            continue
        if d is None or value < 0 or value != int(value):
            bad.add(("labels", d, "no id" if d is None else "negative" if value < 0 else "not whole"))
        else:
            seen.setdefault(d, set()).add(int(value))
    bad |= {("labels", d, "labels differ") for d, v in seen.items() if len(v) > 1}
    good = {d: min(v) for d, v in seen.items() if len(v) == 1}
    bad |= {("labels", d, "no document") for d in good if d not in fine}
    names = {d: f"{fine[d][2] or ''}|{v}" for d, v in good.items() if d in fine}
    order = sorted(set(names.values()))
    samples = []
    for source in {fine[d][3] for d in names}:
        group = sorted((d for d in names if fine[d][3] == source), key=lambda d: (hashlib.md5(f"42-{d}".encode()).hexdigest(), d))
        for k, d in enumerate(group, 1):
            n = len(group)
            where = "train" if k <= int(n * 0.8) else "val" if k <= int(n * (0.8 + 0.1)) else "test"
            samples.append((d, fine[d][1], fine[d][2], source, names[d], k, where, order.index(names[d])))
    return samples, {d for d in fine if d not in names}, bad


def test_release_of_odd_tables(spark, odd, tmp_path):
    at, docs, labelled = odd
    run = lambda **more: dataset_release.run(spark, f"{at}/documents", f"{at}/labels", str(tmp_path), dataset_release.CONFIG | more)
    done = run()
    path = f"{tmp_path}/release=current"
    samples, pool, bad = release_by_hand(docs, labelled)
    first = written(spark, path)
    assert rows(spark.read.parquet(f"{path}/samples").select("doc_id", "text", "lang", "source", "class", "rank", "split", "class_id")) == sorted(samples, key=repr)
    assert {r[0] for r in first["pool"]} == pool and set(first["rejected"]) == bad
    assert done == {name: len(first[name]) for name in dataset_release.TABLES}
    for source, total, chosen, *parts in spark.read.parquet(f"{path}/manifest").select("source", "total_available", "selected_count", "train_count", "val_count", "test_count").collect():
        mine = [s for s in samples if s[3] == source]
        if source is not None:
            assert (chosen, parts) == (len(mine), [sum(s[6] == w for s in mine) for w in ("train", "val", "test")]) and total >= chosen
    assert run() == done and written(spark, path) == first
    run(release="next", seed=1)
    assert written(spark, path) == first and written(spark, f"{tmp_path}/release=next")["samples"] != first["samples"]


def test_release_after_a_failure(spark, odd, tmp_path, monkeypatch):
    at, *_ = odd
    run = lambda where: dataset_release.run(spark, f"{at}/documents", f"{at}/labels", f"{tmp_path}/{where}", dataset_release.CONFIG)
    run("whole")
    write, calls = common.write, []

    def failing(*args, **more):
        calls.append(args[1])
        if len(calls) == 3:
            raise OSError("lost")
        return write(*args, **more)

    monkeypatch.setattr(common, "write", failing)
    with pytest.raises(OSError):
        run("torn")
    monkeypatch.setattr(common, "write", write)
    run("torn")
    assert written(spark, f"{tmp_path}/torn/release=current") == written(spark, f"{tmp_path}/whole/release=current")


def test_release_of_empty_tables(spark, odd, tmp_path):
    at, *_ = odd
    for name in ("documents", "labels"):
        spark.read.parquet(f"{at}/{name}").limit(0).write.parquet(f"{tmp_path}/{name}")
    done = dataset_release.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out", dataset_release.CONFIG)
    assert set(done.values()) == {0}


def test_ranks_of_one_group_over_many_partitions(spark):
    table = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, 'hot') as g", "id % 7 as o", "1 as _n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = split.spread_ranks(table, "g", "o", "id")
        got = {(r.g, r.id): (r["rank"], r["size"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.columns == ["id", "g", "o", "_n", "rank", "size"]
    for g in (None, "hot"):
        ids = sorted((i % 7, i) for i in range(5000) if (None if i % 3 == 0 else "hot") == g)
        assert all(got[g, i] == (k, len(ids)) for k, (_, i) in enumerate(ids, 1))


def patterns(spark, seed, ids, odd=()):
    pick = np.random.default_rng(seed)
    centre = np.eye(4)
    table = [(int(i), [float(x) for x in centre[i % 4] + pick.normal(0, 0.3, 4)], int(i % 4) if i % 5 else None) for i in ids]
    return spark.createDataFrame([*table, *odd], "vec_id long, embedding array<double>, label int").coalesce(1)


def judged_by_hand(reference, table, top, margin):
    means = {c: np.mean([v for _, v, label in reference if label == c], axis=0) for c in sorted({r[2] for r in reference} - {None})}
    out = {}
    for i, v, label in table:
        z = np.array([np.dot(v, m) for m in means.values()])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        order = sorted(zip((-np.round(p, 12)).tolist(), means, strict=True))
        best = [(c, round(-q, 6)) for q, c in order[:top]]
        ahead = round(order[1][0] - order[0][0], 6)
        out[i] = (label, *(x for pair in best for x in pair), None if label is None else label == best[0][0], "accept" if ahead >= margin else "review")
    return out


def judged(spark, path, config=pattern_inbox.CONFIG):
    table = pattern_inbox.predictions(spark, str(path), config).collect()
    assert len({r.vec_id for r in table}) == len(table)
    return {r.vec_id: (r.label, *(r[f"top{k}_{c}"] for k in range(1, config["top"] + 1) for c in ("class", "p")), r.correct, r.decision) for r in table}, {r.vec_id: r.batch for r in table}


ODD = [(None, [1.0] * 4, 1), (501, None, 1), (502, [], 1), (503, [1.0, float("nan"), 0.0, 0.0], 1), (504, [1.0], 1), (505, [1.0, None, 0.0, 0.0], 1), (506, [float("inf"), 0.0, 0.0, 0.0], None), (None, [1.0] * 4, 1)]


def test_inbox_over_growing_input(spark, tmp_path, caplog):
    reference, inbox, out = f"{tmp_path}/reference", f"{tmp_path}/inbox", f"{tmp_path}/out"
    patterns(spark, 1, range(1000, 1100)).write.parquet(reference)
    known = [tuple(r) for r in spark.read.parquet(reference).collect()]
    config = pattern_inbox.CONFIG | {"margin": 0.2}
    run = lambda where=out, **more: pattern_inbox.run(spark, reference, inbox, where, config | more)
    patterns(spark, 2, range(50), ODD).write.parquet(inbox)
    with caplog.at_level(logging.INFO, "prismflow.jobs"):
        assert run() == {"judged": 50, "problems": 8}
    assert "wrote 50 rows" in caplog.text and "reading new files of" in caplog.text
    first = [tuple(r) for r in spark.read.parquet(inbox).collect() if r.vec_id is not None and r.vec_id < 500]
    assert judged(spark, out)[0] == judged_by_hand(known, first, 3, 0.2)
    assert {d for *_, d in judged(spark, out)[0].values()} == {"accept", "review"}
    problems = {(r.vec_id, r.problem) for r in spark.read.parquet(f"{out}/problems").collect()}
    assert problems == {(None, "no id"), (501, "no values"), (502, "no values"), (503, "not a number"), (504, "another length"), (505, "not a number"), (506, "not a number")}

    assert run() == {"judged": 0, "problems": 0}  # nothing new
    before, batches = judged(spark, out)
    assert set(batches.values()) == {0}

    # New files: some ids again with other values, one id twice in a batch.
    patterns(spark, 3, range(40, 90)).write.mode("append").parquet(inbox)
    twice = patterns(spark, 4, [200]).unionByName(patterns(spark, 5, [200]))
    twice.coalesce(1).write.mode("append").parquet(inbox)
    assert run() == {"judged": 41, "problems": 0}
    after, batches = judged(spark, out)
    assert {i: after[i] for i in before} == before and {batches[i] for i in range(50, 90)} == {1}
    options = [judged_by_hand(known, [tuple(r)], 3, 0.2)[200] for r in twice.collect()]
    assert after[200] in options
    report = {r.batch: (r.n, r.known, r.right) for r in spark.read.parquet(f"{out}/report").collect()}
    assert report[0][0] == 50 and report[1][0] == 41 and report[None][0] == 91
    assert report[None][1:] == (sum(v[0] is not None for v in after.values()), sum(bool(v[-2]) for v in after.values()))

    # One run over everything judges the same ids; a file at a time as well.
    assert run(f"{tmp_path}/once")["judged"] == 91 and set(judged(spark, f"{tmp_path}/once")[0]) == set(after)
    assert run(f"{tmp_path}/by_file", files=1)["judged"] == 91
    assert len(set(judged(spark, f"{tmp_path}/by_file")[1].values())) >= 3


def test_inbox_after_a_failure(spark, tmp_path, monkeypatch):
    inbox, out = f"{tmp_path}/inbox", f"{tmp_path}/out"
    patterns(spark, 6, range(60), ODD).write.parquet(inbox)
    run = lambda where: pattern_inbox.run(spark, inbox, inbox, where, pattern_inbox.CONFIG)
    write = common.write

    def failing(table, path, *by, **more):
        if path.endswith("/problems"):
            raise OSError("lost")
        return write(table, path, *by, **more)

    monkeypatch.setattr(common, "write", failing)
    with pytest.raises(Exception, match="lost"):
        run(out)
    assert len(judged(spark, out)[0]) == 60  # written, but the batch is not marked as done
    monkeypatch.setattr(common, "write", write)
    assert run(out) == {"judged": 60, "problems": 8}
    run(f"{tmp_path}/whole")
    assert judged(spark, out) == judged(spark, f"{tmp_path}/whole")
    assert spark.read.parquet(f"{out}/problems").count() == 8


def test_inbox_refuses_what_it_cannot_use(spark, tmp_path):
    patterns(spark, 7, range(20)).selectExpr("vec_id", "embedding", "cast(null as int) as label").write.parquet(f"{tmp_path}/unlabelled")
    with pytest.raises(ValueError, match="no labelled pattern"):
        pattern_inbox.run(spark, f"{tmp_path}/unlabelled", f"{tmp_path}/unlabelled", f"{tmp_path}/out", pattern_inbox.CONFIG)
    with pytest.raises(ValueError, match="top"):
        pattern_inbox.run(spark, "", "", f"{tmp_path}/out", pattern_inbox.CONFIG | {"top": 1})


def test_best_classes_equal_the_ranked_ones(spark):
    table = patterns(spark, 8, range(40)).fillna({"label": 0})
    centre = evaluate.centroids(table, "embedding", "label")
    ranked = evaluate.top_k(evaluate.logits_to(table, centre, "vec_id", "embedding", "label"), 3)
    expected = {(r.id, r["rank"]): (r["class"], round(r.p, 9)) for r in ranked.collect()}
    own = table.join(centre).select("vec_id", evaluate.best_classes(table.embedding, centre.centroids, 3).alias("best")).collect()
    assert {(r.vec_id, k): (b["class"], round(b.p, 9)) for r in own for k, b in enumerate(r.best, 1)} == expected


@given
def test_command_lines(tmp_path):
    for name, job, inputs in (("release", "dataset_release", {"documents": "documents", "labels": "labels"}), ("inbox", "pattern_inbox", {"reference": "embeddings", "incoming": "embeddings"})):
        config = f"{ROOT}/jobs/{job}.json"
        with open(config) as file:
            json.load(file)
        paths = [x for k, v in inputs.items() for x in (f"--{k}", f"{SF}/{v}.parquet")]
        found = subprocess.run([sys.executable, "-m", f"jobs.{job}", *paths, "--output", f"{tmp_path}/{name}", "--config", config], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert found.returncode == 0, found.stderr[-2000:]
        assert "wrote" in found.stderr and "reading" in found.stderr
    assert os.path.isdir(f"{tmp_path}/release/release=current/samples/split=train") and os.path.isdir(f"{tmp_path}/inbox/predictions/batch=0")


def test_unknown_settings_are_refused(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"sed": 1}')
    with pytest.raises(ValueError, match="sed"):
        common.configured(spark, str(tmp_path / "c.json"), dataset_release.CONFIG)
