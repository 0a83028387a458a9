"""Hand-worked cases of formulas, stop rule, sampling, augmentation, structure files, matrices, checkpoints and search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.functions import chemistry, peaks
from prismflow.operators import active, clusters, distances, evaluate, labels, network, render, split, structures
from prismflow.plans import dataset
from prismflow.sources import patterns, sinks


def counted(spark, *formulas):
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(formulas)], "id int, f string")
    return [r.c for r in rows.select("id", chemistry.formula_counts(F.col("f")).alias("c")).orderBy("id").collect()]


def test_formulas_of_any_depth(spark):
    got = counted(spark, "Ca(OH)2(NO3)2(SO4)3", "Mg((Al(OH)2)3O)2", "BaTiO3", "((H2)2)2", "")
    assert got == [{"Ca": 1, "O": 20, "H": 2, "N": 2, "S": 3}, {"Mg": 1, "Al": 6, "O": 14, "H": 12}, {"Ba": 1, "Ti": 1, "O": 3}, {"H": 8}, {}]


@pytest.mark.parametrize("formula", ["Fe0.5O", "Ca(OH", "CaOH)2", "x", "Ca OH"])
def test_what_is_no_formula(spark, formula):
    with pytest.raises(Exception, match="no formula"):
        counted(spark, formula)


def test_rounding_only_with_several_states(spark):
    rows = spark.createDataFrame([("Na20000Cl20000",), ("Ti1234O2468",), ("Ti1235O1245",)], "f string").withColumn("c", chemistry.formula_counts(F.col("f")))
    found = rows.select("f", chemistry.rounded_counts(F.col("c"), chemistry.has_several_states(F.col("c"), ["Ti"])).alias("c"))
    assert {r.f: r.c for r in found.collect()} == {"Na20000Cl20000": {"Na": 20000, "Cl": 20000}, "Ti1234O2468": {"Ti": 123, "O": 247}, "Ti1235O1245": {"Ti": 1, "O": 1}}


def test_stop_rule_needs_a_whole_step(spark):
    def stop(values, patience, delta):
        rows = spark.createDataFrame([(7, k, v) for k, v in enumerate(values)], "seed int, round int, value double")
        return evaluate.learning_stop(rows, patience, delta).first().stop_round

    assert stop([0.5, 0.5005, 0.5012, 0.5013, 0.5014, 0.6], 3, 0.001) is None
    assert stop([0.5, 0.5005, 0.5009, 0.5009, 0.9], 3, 0.001) == 3
    assert stop([0.5, 0.4, 0.5, 0.4, 0.3, 0.2], 3, 0.0) == 5
    assert stop([0.5], 1, 0.1) is None


def test_draws_follow_squared_distances(spark):
    """After the first centre at 10, the points 0, 4 and 8 are drawn with odds 100 : 36 : 4."""
    rows = spark.createDataFrame([(k, [1.0], [float(x), 0.0]) for k, x in enumerate((10, 0, 4, 8))], "id long, p array<double>, h array<double>")
    many = rows.crossJoin(spark.range(1500).toDF("g")).select((F.col("g") * 4 + F.col("id")).alias("id"), "g", "p", "h")
    found = active.badge_select(many, "g", 2, 5)
    assert found.where("rank = 1 and id % 4 <> 0").count() == 0
    share = {r.at: r["count"] / 1500 for r in found.where("rank = 2").groupBy((F.col("id") % 4).alias("at")).count().collect()}
    assert share[1] == pytest.approx(100 / 140, abs=0.04) and share[2] == pytest.approx(36 / 140, abs=0.04) and share[3] == pytest.approx(4 / 140, abs=0.02)


def test_draws_among_equal_points(spark):
    rows = spark.createDataFrame([(k, 0, [1.0], [1.0]) for k in range(5)] + [(9, 1, [1.0], [2.0])], "id long, g int, p array<double>, h array<double>")
    found = active.badge_select(rows, "g", 3, 1)
    assert found.where("g = 0").select("id").distinct().count() == 3 and found.where("g = 1").count() == 1
    assert active.badge_select(rows, None, 4, 1).count() == 4


def test_class_checks(spark):
    rows = spark.createDataFrame([(1, 0), (2, 3)], "id int, label int")
    assert labels.check_range(rows, "label", 4) is rows
    for n, bad in ((3, rows), (5, rows.withColumn("label", F.col("label") - 1)), (5, rows.withColumn("label", F.lit(None).cast("int")))):
        with pytest.raises(ValueError, match="class labels"):
            labels.check_range(bad, "label", n)
    with pytest.raises(ValueError, match="no class"):
        labels.hard_mask(rows, F.lit(False))
    assert [(r.n_classes, r.gap) for r in labels.class_gaps(rows, "label").orderBy("gap").collect()] == [(4, 1), (4, 2)]
    assert labels.class_gaps(rows.limit(0), "label").count() == 0
    with pytest.raises(ValueError, match="1 samples and 0 labels"):
        split.aligned(rows, rows.where("id = 1"), "id")


def numpy_pattern(lines):
    """Peaks (angle, intensity, sigma in cells) on the grid: nearest cell, kernel of four deviations, maximum 100."""
    out = np.zeros(peaks.POINTS)
    for angle, intensity, sigma in lines:
        at = int(np.clip(math.ceil((angle - peaks.LOW) / peaks.STEP - 0.5), 0, peaks.POINTS - 1))
        k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
        kernel = np.exp(-(k**2) / (2 * sigma**2))
        use = (at + k >= 0) & (at + k < peaks.POINTS)
        np.add.at(out, at + k[use], intensity * (kernel / kernel.sum())[use])
    return 100 * out / out.max()


def test_fan_out_changes_what_each_effect_is_for(spark):
    rows = spark.createDataFrame([("a", 30.0, 50.0, [1, 0, 0]), ("a", 44.0, 100.0, [1, 1, 0]), ("a", 60.0, 20.0, [2, 1, 1])], "pattern string, two_theta double, intensity double, hkl array<int>")
    cubic = [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]
    rows = rows.withColumn("lattice", F.array(*(F.array(*map(F.lit, r)) for r in cubic))).withColumn("symmetry", F.lit("cubic"))
    rows = rows.withColumn("two_theta", peaks.bragg_angle(F.col("hkl"), F.col("lattice")))
    base = {tuple(r.hkl): (r.two_theta, r.intensity) for r in rows.collect()}
    assert base[1, 0, 0][0] == pytest.approx(2 * math.degrees(math.asin(1.54184 / 8)))
    effects = spark.createDataFrame([(e, 0) for e in render.EFFECTS], "effect string, k int")
    made = render.augmented(rows, effects, "1").collect()
    by = {e: sorted((r.two_theta, r.intensity, r.sigma_cells) for r in made if r.effect == e) for e in render.EFFECTS}
    plain = sorted(base.values())
    ratio = {e: {round(math.sin(math.radians(p[0] / 2)) / math.sin(math.radians(q[0] / 2)), 9) for p, q in zip(by[e], plain, strict=True)} for e in by}
    assert len(ratio["strain"]) == 1 and ratio["strain"] != {1.0}
    assert len({round(p[0] - q[0], 9) for p, q in zip(by["shift"], plain, strict=True)}) == 1 and by["shift"][0][0] != plain[0][0]
    assert [p[1] for p in by["strain"]] == [q[1] for q in plain] and [p[1] for p in by["texture"]] != [q[1] for q in plain]
    assert [p[0] for p in by["texture"]] == [p[0] for p in by["impurity"]] == [p[0] for p in by["broadening"]] == [q[0] for q in plain]
    assert [p[1] for p in by["mixed"]] != [q[1] for q in plain] and [p[0] for p in by["mixed"]] != [q[0] for q in plain]
    with pytest.raises(Exception, match="unknown effect"):
        render.augmented(rows, spark.createDataFrame([("melt", 0)], "effect string, k int"), "1").collect()


def test_finished_patterns_against_numpy(spark):
    lines = [(30.0, 50.0, 5.0), (44.0, 100.0, 6.0)]
    made = spark.createDataFrame([(f"a|{e}|0", "a", e, *x) for e in ("shift", "mixed") for x in lines], "pattern string, source string, effect string, two_theta double, intensity double, sigma_cells double")
    other = [(52.0, 10.0, 4.0)]
    impurities = render.rendered(spark.createDataFrame([("b", *x) for x in other], "pattern string, two_theta double, intensity double, sigma_cells double")).withColumnRenamed("pattern", "reference")
    picks = render.picked_reference(spark.createDataFrame([("a", "b")], "structure string, reference string"), "3")
    quiet = {(r.pattern, r.cell): r.value for r in render.finished(made, impurities, picks, "3", deviation=0.0).collect()}
    assert len(quiet) == 2 * peaks.POINTS
    clean = numpy_pattern(lines)
    share = spark.range(1).select(peaks.pick("3-impurity", F.lit("a|mixed|0"), n=100)).first()[0] * 70 / 99
    mixed = clean + share * numpy_pattern(other) / 100
    assert np.allclose([quiet["a|shift|0", c] for c in range(peaks.POINTS)], clean, atol=1e-9)
    assert np.allclose([quiet["a|mixed|0", c] for c in range(peaks.POINTS)], 100 * mixed / mixed.max(), atol=1e-9)
    loud = render.finished(made, impurities, picks, "3").collect()
    rest = np.array([r.value - quiet[r.pattern, r.cell] for r in loud])
    assert rest.mean() == pytest.approx(0, abs=0.01) and rest.std() == pytest.approx(0.25, abs=0.01)


def test_cells_that_keep_their_symmetry(spark):
    strains = F.array(*(F.lit(0.01 * k) for k in range(1, 7)))
    found = {}
    for system in ("cubic", "tetragonal", "orthorhombic", "monoclinic", "triclinic"):
        cell = peaks.strained_cell(F.lit(system), F.array(*[F.lit(4.0)] * 3), F.array(*[F.lit(90.0)] * 3), strains)
        found[system] = tuple(map(tuple, spark.range(1).select(cell.alias("c")).first().c))
    for system, lengths in (("cubic", (4.04, 4.04, 4.04)), ("tetragonal", (4.04, 4.04, 4.12)), ("orthorhombic", (4.04, 4.08, 4.12))):
        assert np.allclose(found[system], (lengths, (90, 90, 90)))
    assert found["monoclinic"][1] == pytest.approx((90, 94.5, 90)) and found["triclinic"][1] == pytest.approx((93.6, 94.5, 95.4))
    square = spark.range(1).select(peaks.cell_matrix(F.array(*map(F.lit, (3.0, 4.0, 5.0))), F.array(*[F.lit(90.0)] * 3)).alias("m")).first().m
    assert np.allclose(square, np.diag([3.0, 4.0, 5.0]))


CIF = """# a comment
data_x
_cell_length_a 4.00(1)
_cell_length_b 4.0
_cell_length_c 4.1
_cell_angle_alpha 90
_cell_angle_beta 90.0
_cell_angle_gamma 90
_symmetry_Int_Tables_number {sg}
_chemical_formula_sum 'Ba1 Ti1 O3'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
Ba1 Ba 0 0 0 {occ}
Ti1 Ti 0.5 0.5 0.5 1
O1 O 0.5 0.5 0 1
"""


def test_structure_files(spark, tmp_path):
    source = tmp_path / "cifs"
    source.mkdir()
    for name, text in (("a", CIF.format(sg=221, occ=1)), ("b", CIF.format(sg=221, occ=0.5)), ("c_99", CIF.format(sg="?", occ=1)), ("d", "data_y\n"), ("e", CIF.format(sg=1, occ=2))):
        (source / f"{name}.cif").write_text(text)
    rows = patterns.read_cifs(spark, str(source)).cache()
    got = {r.name: r for r in rows.collect()}
    assert (got["a"].formula, got["a"].sg, got["a"].lengths, got["a"].ordered, len(got["a"].sites)) == ("BaTiO3", 221, [4.0, 4.0, 4.1], True, 3)
    assert not got["b"].ordered and got["c_99"].sg == 99 and got["d"].problem and "tolerance" in got["e"].problem
    fine = rows.where("problem is null")
    kept, repeated = structures.unique_structures(fine, "name")
    assert sorted((r.formula, r.sg, r.name) for r in kept.collect()) == [("BaTiO3", 99, "c_99"), ("BaTiO3", 221, "b")]
    assert [(r.n, r.members) for r in repeated.collect()] == [(2, ["a", "b"])]
    assert structures.ordered_only(fine).count() == 2 and structures.ordered_only(fine, False).count() == 3
    structures.write_cifs(kept, str(tmp_path / "out"))
    again = patterns.parse_cif(next((tmp_path / "out" / "file=BaTiO3_99.cif").glob("part-*.txt")).read_text())
    assert (again["formula"], again["sg"], again["lengths"], again["sites"][0]["element"]) == ("BaTiO3", 99, [4.0, 4.0, 4.1], "Ba")
    with pytest.raises(ValueError, match="no structure"):
        structures.write_cifs(kept.where("sg = 5"), str(tmp_path / "none"))
    sinks.duplicate_report(repeated, str(tmp_path / "report"))
    assert "a, b" in next((tmp_path / "report").glob("part-*.txt")).read_text()
    single = spark.createDataFrame([(["Fe"],), (["Fe", "O"],)], "e array<string>")
    assert structures.compounds_only(single, F.col("e")).count() == 1 and structures.compounds_only(single, F.col("e"), True).count() == 2


def test_matrix_and_its_names(spark, tmp_path):
    dist = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 1.5)], "i long, j long, d double")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "matrix_index int, name string")
    sinks.write_matrix(dist, names, str(tmp_path / "m"))
    back, index = patterns.read_matrix(spark, str(tmp_path / "m"))
    assert back.count() == 3 and index.count() == 3
    for bad in (dist.where("i = 0"), dist.unionAll(dist.limit(1)), dist.withColumn("j", F.col("j") + 1)):
        with pytest.raises(ValueError, match="square"):
            sinks.write_matrix(bad, names, str(tmp_path / "n"))


def test_domain_scan_counts_what_it_skips(spark, tmp_path):
    folder = tmp_path / "domain"
    folder.mkdir()
    for name in ("a", "b", "c"):
        np.save(folder / f"{name}_aug.npy", np.random.default_rng(1).random((60, 5, 1)))
    known = spark.createDataFrame([("a", 0), ("c", 1)], "compound string, label int")
    rows, skipped = patterns.domain_scan(spark, str(folder), known, length=5, subsample=4)
    assert skipped == 1 and {(r.compound, r.label): r["count"] for r in rows.groupBy("compound", "label").count().collect()} == {("a", 0): 20, ("c", 1): 20}
    assert dict(rows.dtypes)["spectrum"] == "array<float>"
    with pytest.raises(ValueError, match="no labelled"):
        patterns.domain_scan(spark, str(folder), known.limit(0))


def test_labels_in_another_encoding(spark, tmp_path):
    (tmp_path / "gbk.csv").write_bytes("label,compound\n1,钛酸钡\n2,B\n".encode("gbk"))
    assert {r.label: r.compound for r in patterns.lenient_labels(spark, str(tmp_path / "gbk.csv")).collect()} == {1: "钛酸钡", 2: "B"}
    (tmp_path / "none.csv").write_text("label,compound\nx,A\n")
    with pytest.raises(ValueError, match="no row"):
        patterns.lenient_labels(spark, str(tmp_path / "none.csv"))


def test_weights_from_a_file(spark, tmp_path):
    rng = np.random.default_rng(6)
    state = {"model.conv.0.weight": rng.normal(size=(2, 1, 3)), "model.conv.0.bias": rng.normal(size=2), "model.last.weight": rng.normal(size=(3, 4)), "model.last.bias": rng.normal(size=3), "model.other": np.ones(1)}
    state |= {f"model.dense.0.{n}": v for n, v in {"weight": rng.normal(size=(4, 8)), "bias": np.zeros(4), "gain": np.ones(4), "offset": np.zeros(4), "mean": np.zeros(4), "var": np.ones(4)}.items()}
    np.savez(tmp_path / "w.npz", **state)
    weights = network.load_weights(spark, str(tmp_path / "w.npz"), padding=1)
    x = rng.normal(size=(3, 8))
    logits, flat, deep = network.forward(weights, x)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    row = network.predicted(frame, weights, "id", "v", flat=True).where("id = 2").first()
    assert row.flattened == pytest.approx(flat[2].tolist()) and row.features == pytest.approx(deep[2].tolist()) and row.logits == pytest.approx(logits[2].tolist())


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(k, k % 3, (np.eye(3)[k % 3] + 0.3 * rng.random(3)).tolist()) for k in range(36)], "id long, label int, v array<double>").cache()


@pytest.mark.parametrize(("acquire", "by_class"), [("badge", True), ("badge", False), ("random", False)])
def test_rounds_leave_checkpoints_and_go_on(spark, samples, tmp_path, acquire, by_class):
    path = f"file://{tmp_path}/run"
    run = lambda rounds: sorted(tuple(r) for r in dataset.learning_rounds(spark, samples, rounds, 2, 1, 3, acquire, by_class, path).collect())
    whole = sorted(tuple(r) for r in dataset.learning_rounds(spark, samples, 3, 2, 1, 3, acquire, by_class).collect())
    assert [r[2] for r in whole] == [6, 9, 12]
    assert run(3) == whole
    storage.remove(spark, f"{path}/state/round=2")
    storage.remove(spark, f"{path}/state/round=1/done.json")
    assert run(3) == whole
    at = f"{path}/state/round=1"
    ids = {n: {r.id for r in spark.read.parquet(f"{at}/{n}").collect()} for n in ("trained", "new", "next")}
    assert ids["trained"] | ids["new"] == ids["next"] and not ids["trained"] & ids["new"] and len(ids["new"]) == 3
    with pytest.raises(ValueError, match="unknown acquisition"):
        dataset.learning_rounds(spark, samples, 2, 2, 1, 3, "best")


def test_repeated_runs(spark, samples, tmp_path):
    runs = dataset.repeated_rounds(spark, samples, 2, 2, 1, 5, times=2)
    assert {(r.seed, r["round"]) for r in runs.collect()} == {(5, 0), (5, 1), (6, 0), (6, 1)}
    sinks.write_metrics(runs, str(tmp_path / "metrics"))
    assert spark.read.csv(str(tmp_path / "metrics"), header=True).count() == 4


def test_named_outputs_of_a_sweep(spark, tmp_path):
    prepare, distance = distances.grid_w1(1.0)
    rows = spark.createDataFrame([(k, np.eye(6)[k].tolist()) for k in range(6)], "id long, v array<double>")
    dist = distances.pairwise(rows, "id", "v", prepare, distance)
    names = rows.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    assigned = spark.createDataFrame([(5, k, k // 2) for k in range(6)], "percentile int, id long, label int")
    dataset.sweep_outputs(assigned, *clusters.sweep(dist, assigned), names, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(sinks.CLUSTER_TABLES)
    assert spark.read.csv(str(tmp_path / "out" / "prototypes" / "percentile=5"), header=True).count() == 3
    with pytest.raises(ValueError, match="cluster tables"):
        sinks.write_clusters({}, str(tmp_path))


def test_report_of_duplicates(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), ("B", 2, "z")], "formula string, sg int, name string")
    sinks.duplicate_report(split.duplicate_groups(rows, ["formula", "sg"], "name"), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["A: 1: x, y"]


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    space = {"units": ("choice", [32, 64]), "kernel": ("int", 10, 40, 5), "rate": ("log", 1e-4, 1e-1), "dropout": ("float", 0.3, 0.6)}
    asked = []

    def score(params):
        asked.append(params)
        return -abs(math.log10(params["rate"]) + 2)

    path = f"file://{tmp_path}/trials"
    first = dataset.search(spark, space, 5, 1, score, path)
    best = dataset.search(spark, space, 20, 1, score, path)
    assert len(asked) == 20 and best["score"] >= first["score"] == max(-abs(math.log10(p["rate"]) + 2) for p in asked[:5])
    assert all(p["units"] in (32, 64) and p["kernel"] % 5 == 0 and 10 <= p["kernel"] <= 40 and 1e-4 <= p["rate"] <= 0.1 and 0.3 <= p["dropout"] <= 0.6 for p in asked)
    assert len({p["kernel"] for p in asked}) > 3
    with pytest.raises(ValueError, match="unknown kind"):
        dataset.suggestion({"x": ("normal", 0, 1)}, 1, 1)


def test_storage(spark, tmp_path):
    path = f"file://{tmp_path}/a.json"
    assert storage.read_text(spark, path) is None and storage.names_in(spark, f"file://{tmp_path}/none") == []
    storage.write_text(spark, path, "é")
    storage.write_text(spark, path, "ü")
    assert storage.read_text(spark, path) == "ü"
    table = storage.cut(spark.range(7))
    assert table.count() == 7
    storage.drop(table)
    assert [storage.in_bytes(x) for x in ("64m", "1k", "5", "2gb", "3MiB", 9)] == [64 << 20, 1024, 5, 2 << 30, 3 << 20, 9]
    with pytest.raises(ValueError, match="not a size"):
        storage.in_bytes("much")
