"""Hand-worked cases, error cases and properties."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismflow.functions import chemistry, peaks
from prismflow.operators import clusters, distances, evaluate, labels, network, render, split
from prismflow.plans import dataset
from prismflow.sources import patterns, sinks
from prismflow.streaming import incremental


@pytest.fixture(scope="module")
def line(spark):
    """Points 0, 1, 5, 7 in clusters {0, 1} and {5, 7}."""
    at = [0, 1, 5, 7]
    pairs = [(i, j, float(abs(at[i] - at[j]))) for i in range(4) for j in range(i + 1, 4)]
    return spark.createDataFrame(pairs, "i long, j long, d double"), spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, label int")


def test_cluster_metrics(line):
    assert clusters.calinski_harabasz(*line).first()[0] == pytest.approx(44 / 3)
    assert clusters.davies_bouldin(*line).first()[0] == pytest.approx(3 / 5.5)
    assert clusters.sse(*line).first()[0] == pytest.approx(5)
    assert clusters.separation(*line).first()[0] == pytest.approx(5.5 / 1.5)
    first = clusters.quality(*line).where("label = 0").first()
    assert (first.intra_mean, first.intra_std, first.inter_mean) == (1, 0, 5.5)
    assert first.inter_std == pytest.approx(5**0.5 / 2)


def test_one_cluster_and_singletons(spark, line):
    dist, _ = line
    one = spark.createDataFrame([(k, 0) for k in range(4)], "id long, label int")
    each = spark.createDataFrame([(k, k) for k in range(4)], "id long, label int")
    assert clusters.calinski_harabasz(dist, one).first()[0] == 0
    assert clusters.calinski_harabasz(dist, each).first()[0] == 0
    assert clusters.davies_bouldin(dist, one).first()[0] == 0
    assert clusters.separation(dist, each).first()[0] is None
    assert clusters.medoids(dist, each).count() == 4


def test_thresholds_and_strict_cut(line):
    dist, ids = line
    taus = clusters.thresholds(dist)
    found = {r.percentile: r.tau for r in taus.collect()}
    assert (found[5], found[20], found[80]) == (1.25, 2.0, 6.0)
    cut = clusters.complete_linkage(dist, ids, taus.where("percentile = 20"))
    assert cut.select("label").distinct().count() == 3


def test_grid_distance():
    prepare, distance = distances.grid_w1(1.0)
    x = prepare(np.array([[0.2, 0.3, 0.5], [0.1, 0.6, 0.3], [0, 0, 0]]))
    assert distance(x[:1], x[1:2])[0, 0] == pytest.approx(0.3)
    assert x[2].tolist() == pytest.approx([1 / 3, 2 / 3, 1])


def test_pairwise_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.random(6).tolist()) for k in range(41)]
    prepare, distance = distances.grid_w1(0.5)
    found = distances.pairwise(spark.createDataFrame([*rows, (99, None)], "id long, v array<double>"), "id", "v", prepare, distance, block=8)
    whole = prepare(np.array([v for _, v in rows]))
    got = {(r.i, r.j): r.d for r in found.collect()}
    assert len(got) == 41 * 40 // 2
    assert all(got[i, j] == pytest.approx(distance(whole[i : i + 1], whole[j : j + 1])[0, 0]) for i, j in got)


def test_empirical_distance(spark):
    rows = [("a", 0, x) for x in (0.0, 1.0, 3.0)] + [("a", 1, x) for x in (5.0, 6.0, 8.0)] + [("b", 0, 0.0), ("b", 0, 2.0), ("b", 1, 1.0), ("c", 0, 1.0)]
    found = distances.empirical_w1(spark.createDataFrame(rows, "k string, side int, x double"), ["k"], "side", "x")
    assert {r.k: r.w1 for r in found.collect()} == {"a": 5.0, "b": 1.0}


def test_macro_scores(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3)], "label int, predicted int")
    found = evaluate.macro_scores(rows).first()
    assert found == pytest.approx((0.5, 0.375, 0.375, 1 / 3))


def test_single_run_has_no_deviation(spark):
    runs = spark.createDataFrame([(1, 5, 0.5)], "round int, seed int, acc double")
    assert evaluate.round_summary(runs, ["acc"]).first().acc_std == 0
    assert evaluate.metric_statistics(runs, ["acc"]).first()["std"] is None


def test_masked_classes_fill_the_ranks(spark):
    logits = spark.createDataFrame([(1, 0, c, float(c)) for c in range(4)], "id int, label int, class int, logit double")
    allowed = spark.createDataFrame([(2,)], "class int")
    top = evaluate.top_k(evaluate.masked(logits, allowed), 3).orderBy("rank").collect()
    assert [r["class"] for r in top] == [2, 0, 1]
    assert top[0].p == 1 and top[1].p == 0


def test_masks(spark):
    row = spark.createDataFrame([("Ba2PrNbO6|14",)], "k string").select(chemistry.elements(F.col("k")).alias("e"))
    assert row.first().e == ["Ba", "Pr", "Nb", "O"]
    every, some = labels.allowed_all(F.col("e"), ["Ca", "Ti", "O"]), labels.allowed_any(F.col("e"), ["Ca", "Ti", "O"])
    assert row.select(every, some, labels.allowed_all(F.col("e"), [])).first() == (False, True, True)
    assert row.select(labels.allowed_any(F.col("e"), ["Ba", "Pr", "Nb", "O"], True)).first()[0]


def test_space_group_75_and_range(spark):
    row = spark.range(75, 76)
    assert row.select(chemistry.crystal_system(F.col("id")), chemistry.strain_class(F.col("id"))).first() == ("tetragonal", "orthorhombic")
    for bad in (0, 231):
        with pytest.raises(Exception, match="no space group"):
            spark.range(bad, bad + 1).select(chemistry.crystal_system(F.col("id"))).collect()


def test_peak_width(spark):
    row = spark.range(1).select(peaks.peak_width(F.lit(40.0), F.lit(25.0)), peaks.peak_width(F.lit(40.0), F.lit(25.0), True)).first()
    assert row == pytest.approx((0.143721, 0.349379), abs=1e-6)
    assert row[0] / peaks.CELL == pytest.approx(9.2413, abs=1e-4)


def test_grid_cell_and_edges(spark):
    angles = [10.0, 10 + 1.49 * peaks.STEP, 10 + 1.51 * peaks.STEP, 9.0, 95.0, 80.0]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in angles], "a double").select(peaks.grid_cell(F.col("a"))).collect()]
    assert got == [0, 1, 2, 0, 4500, 4500]


def test_rendered_mass_and_edges(spark):
    rows = spark.createDataFrame([("a", 45.0, 3.0, 4.0), ("b", 10.0, 1.0, 4.0)], "pattern string, two_theta double, intensity double, sigma_cells double")
    cells = render.rendered(rows)
    assert cells.where("pattern = 'a'").count() == 33
    assert cells.where("pattern = 'b'").count() == 17
    assert cells.groupBy("pattern").agg(F.max("value").alias("m")).where("m <> 100").count() == 0


def test_strict_and_lenient_labels(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("﻿name,id\nA,5000.04\nB, 2.0 \nA,5000\n".encode())
    found = {r.compound: r.label for r in patterns.strict_labels(spark, str(tmp_path / "good.csv"), "name", "id").collect()}
    assert found == {"A": 5000, "B": 2}
    for text, match in (("name,id\nA,3.5\n", "not whole"), ("name,id\nA,-1\n", "negative"), ("name,id\nA,x\n", "not numeric"), ("name,id\nA,1\nA,2\n", "several labels"), ("name,no\nA,1\n", "no column")):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError, match=match):
            patterns.strict_labels(spark, str(tmp_path / "bad.csv"), "name", "id")
    (tmp_path / "loose.csv").write_text("class_index,chem_name\n3.5,A\nx,B\n3, C \n")
    assert patterns.lenient_labels(spark, str(tmp_path / "loose.csv")).collect() == [(3, "C")]


def test_array_files(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    np.save(folder / "b_aug.npy", np.arange(10.0).reshape(2, 5, 1))
    np.save(folder / "a_aug.npy", np.arange(5.0))
    files = patterns.check_names(patterns.discovered(spark, str(folder), "_aug.npy"))
    assert [r.name for r in files.collect()] == ["a", "b"]
    rows = patterns.read_arrays(spark, str(folder), length=5)
    assert {(r.compound, r.sample_idx): r.spectrum[0] for r in rows.collect()} == {("a", 0): 0, ("b", 0): 0, ("b", 1): 5}
    with pytest.raises(Exception, match="instead of 4"):
        patterns.read_arrays(spark, str(folder), length=4).collect()
    with pytest.raises(ValueError, match="no file"):
        patterns.check_names(patterns.discovered(spark, str(folder), ".txt"))
    with pytest.raises(ValueError, match="suffix"):
        patterns.discovered(spark, str(folder), "")


def test_name_index(spark):
    good = spark.createDataFrame([(0, "a"), (1, "b")], "matrix_index int, name string")
    assert patterns.check_index(good) is good
    with pytest.raises(ValueError):
        patterns.check_index(spark.createDataFrame([(0, "a"), (2, "b")], "matrix_index int, name string"))


def test_split_is_disjoint_and_checks_sizes(spark):
    rows = spark.range(40).select("id", (F.col("id") % 2).alias("g"))
    found = split.split(rows, "g", [split.ticket(1, "id"), "id"], 10, 3, 2)
    assert found.groupBy("g", "split").count().count() == 6
    assert found.select("id").distinct().count() == 30
    with pytest.raises(Exception, match="too few rows"):
        split.split(rows, "g", ["id"], 20, 1, 0).collect()


def test_windows_drop_the_tail(spark):
    rows = spark.range(120).select("id", F.lit(1).alias("g"))
    found = [r.id for r in split.window_sample(rows, "g", "id", 3).collect()]
    assert len(found) == 40 and max(found) < 100


def test_neutral_and_formulas(spark):
    rows = spark.createDataFrame([(1, "Fe3O4"), (2, "Ca(TiO3)2"), (3, "KFe2"), (4, "Fe3O4Xx")], "id int, formula string").withColumn("counts", chemistry.formula_counts(F.col("formula")))
    assert rows.where("id = 2").first().counts == {"Ca": 1, "Ti": 2, "O": 6}
    states = spark.createDataFrame([("Fe", [2, 3]), ("O", [-2]), ("Ca", [2]), ("Ti", [4]), ("K", [1])], "element string, states array<int>")
    assert [r.id for r in labels.neutral(rows, states).collect()] == [1]


def test_convolution_against_loops(spark):
    rng = np.random.default_rng(2)
    weights = {
        "conv": [(rng.normal(size=(3, 1, 3)), rng.normal(size=3), 1)],
        "dense": [(rng.normal(size=(4, 12)), rng.normal(size=4), np.ones(4), np.zeros(4), np.zeros(4), np.ones(4))] * 1,
        "last": (rng.normal(size=(2, 4)), rng.normal(size=2)),
    }
    x = rng.normal(size=(5, 8))
    logits, flat, _ = network.forward(weights, x)
    w, b, _ = weights["conv"][0]
    padded = np.pad(x, ((0, 0), (1, 1)))
    slow = np.array([[[max(0, (padded[n, k : k + 3] * w[o, 0]).sum() + b[o]) for k in range(8)] for o in range(3)] for n in range(5)])
    assert flat == pytest.approx(slow.reshape(5, 3, 4, 2).max(axis=3).reshape(5, -1))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.logits for r in network.predicted(frame, weights, "id", "v").collect()}
    assert got[3] == pytest.approx(logits[3].tolist())


def test_build_dataset(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("compound"), F.col("id").cast("int").alias("sample_idx"), F.array(F.rand(1)).alias("spectrum"))
    known = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 2)], "compound string, label long")
    manifest = dataset.build_dataset(rows, known, str(tmp_path / "out"))
    assert {(r.total_available, r.train_count, r.val_count, r.test_count) for r in manifest.collect()} == {(20, 16, 2, 2)}
    with pytest.raises(ValueError, match="no label"):
        dataset.build_dataset(rows, known.where("label > 0"), str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="two outputs"):
        sinks.check_outputs(["a", "a"])


def test_sweep_and_rounds(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, k % 3, (np.eye(3)[k % 3] + 0.1 * rng.random(3)).tolist()) for k in range(30)], "id long, label int, v array<double>")
    names = rows.select("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"))
    sweep = dataset.cluster_sweep(rows, "id", "v", names, 1.0, [5, 50]).orderBy("percentile").collect()
    assert [r.percentile for r in sweep] == [5, 50] and sweep[0].n_clusters >= sweep[1].n_clusters
    rounds = dataset.learning_rounds(spark, rows, 3, 2, 2, 1).orderBy("round").collect()
    assert [r.n_samples for r in rounds] == [6, 12, 18] and rounds[-1].acc == 1


def test_predictions_in_one_row(spark):
    top = spark.createDataFrame([(1, 1, 7, "a,b", 0.9), (1, 2, 8, "c", 0.1)], "id int, rank int, class int, name string, p double")
    row = sinks.wide_predictions(top, 2).first()
    assert (row.top1_label, row.top1_name, row.top2_name, row.top2_p) == (7, "a b", "c", 0.1)


def test_stream_handles_each_key_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    work = lambda rows: rows.withColumn("twice", F.col("id") * 2)
    for _ in range(2):
        spark.range(5).write.mode("append").parquet(source)
        incremental.process_new(spark, source, "id long", target, state, "id", work).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]
    pd.testing.assert_frame_equal(spark.read.parquet(target).select((F.col("twice") / 2 - F.col("id")).alias("d")).distinct().toPandas(), pd.DataFrame({"d": [0.0]}))


def test_mixed_states_against_all_combinations(spark):
    rng = np.random.default_rng(6)
    cases = [([int(x) for x in rng.choice(np.arange(-5, 9), int(rng.integers(1, 5)), replace=False)], int(rng.integers(1, 9))) for _ in range(60)]
    rows = [(k, s, n, w) for k, (s, n) in enumerate(cases) for w in range(-50, 80, 3)]
    table = spark.createDataFrame(rows, "k int, states array<int>, n int, wanted int")
    reach = []
    for states, n in cases:
        sums = {0}
        for _ in range(n):
            sums = {a + b for a in sums for b in states}
        reach.append(sums)
    got = table.select("k", "wanted", labels.mixes_to(table.states, table.n, table.wanted).alias("ok")).collect()
    assert all(r.ok == (r.wanted in reach[r.k]) for r in got) and any(r.ok for r in got)
    large = spark.createDataFrame([([2, 3, 7], 120_000, 600_001), ([2, 4], 120_000, 300_001), ([2, 3], 120_000, 360_001)], "states array<int>, n int, wanted int")
    assert [r.ok for r in large.select(labels.mixes_to(large.states, large.n, large.wanted).alias("ok")).collect()] == [True, False, False]
