"""Gradients against finite differences; training against its own partitions, its restored best epoch and a task that can be learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.operators import evaluate, network, training
from prismflow.plans import dataset

SMALL = training.Design(length=20, classes=3, conv=((3, 4, 2, 2), (2, 3, 1, 3)), dense=(6, 5), dropout=0.4)


def planted(spark, n, seed=1, length=20, classes=3, shift=0):
    """Rows whose class is where their bump stands."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        label = k % classes
        x = rng.normal(0, 0.3, length)
        x[3 + 5 * label : 7 + 5 * label] += 2
        rows.append((k + shift, label, x.tolist()))
    return spark.createDataFrame(rows, "id long, label int, v array<double>")


@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradients_equal_finite_differences(dropout):
    rng = np.random.default_rng(2)
    state = training.initial(SMALL, 3)
    x, y = rng.normal(size=(9, 20)), rng.integers(0, 3, 9)
    loss = lambda s: training.gradients(s, x, y, dropout, np.random.default_rng(5))[2]
    grads, stats, _, _ = training.gradients(state, x, y, dropout, np.random.default_rng(5))
    assert sorted(grads) == training.learned(state) and sorted(stats) == training.running(state)
    for name, g in grads.items():
        assert g.shape == state[name].shape
        for at in {tuple(rng.integers(0, s) for s in g.shape) for _ in range(12)}:
            moved = []
            for h in (1e-6, -1e-6):
                other = state[name].copy()
                other[at] += h
                moved.append(loss(state | {name: other}))
            assert abs((moved[0] - moved[1]) / 2e-6 - g[at]) < 1e-6, (name, at)


def test_convolution_and_pooling_by_hand():
    x = np.arange(12.0).reshape(1, 2, 6) ** 1.5
    w, b = np.arange(12.0).reshape(2, 2, 3) - 5, np.array([1.0, -2.0])
    got = network.conv1d(x, w, b, 1)
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1)))
    for o in range(2):
        for t in range(6):
            assert np.isclose(got[0, o, t], (padded[0, :, t : t + 3] * w[o]).sum() + b[o])
    out, at = network.pooled(np.array([[[1.0, 5, 2, 2, 7, 0, 9]]]), 3)
    assert out.tolist() == [[[5, 7, 9]]] and at.tolist() == [[[1, 2, 2]]]


def test_partitions_do_not_matter_and_the_best_epoch_is_restored(spark):
    rows, val = planted(spark, 70), planted(spark, 40, 9, shift=1000)
    run = lambda r: training.train(r, val, SMALL, epochs=4, batch=16, workers=2, rate=0.01, seed=4)
    (one, history), (other, again) = run(rows.coalesce(1)), run(rows.repartition(7))
    for name in one:
        np.testing.assert_allclose(one[name], other[name], atol=1e-9)
    assert [h["val_acc"] for h in history] == [h["val_acc"] for h in again]
    best = max(h["val_acc"] for h in history)
    assert np.isclose(training.accuracy(val, one), best)
    assert history[-1]["train_loss"] < history[0]["train_loss"]


def test_a_step_is_one_stage_and_equals_a_tree_of_tasks(spark, monkeypatch):
    rows, val = planted(spark, 70), planted(spark, 30, 9, shift=1000)
    run = lambda: training.train(rows, val, SMALL, epochs=1, batch=10, workers=3, rate=0.01, seed=4)
    read, gradient = [], training.step_gradient
    monkeypatch.setattr(training, "step_gradient", lambda batches, own, *a: read.append((type(batches).__name__, list(own))) or gradient(batches, own, *a))
    one, history = run()
    assert sorted(own for _, own in read) == [[0, 1, 2], [3, 4, 5], [6]] and {kind for kind, _ in read} == {"RDD"}
    monkeypatch.setattr(training, "TOLD", 0)
    other, again = run()
    assert {kind for kind, _ in read[3:]} == {"DataFrame"}
    for name in one:
        np.testing.assert_allclose(one[name], other[name], atol=1e-9)
    assert history[0] == pytest.approx(again[0], abs=1e-9)


def test_a_task_is_learned(spark):
    rows, val = planted(spark, 240, 5), planted(spark, 90, 6, shift=1000)
    design = training.Design(length=20, classes=3, conv=((4, 5, 2, 2),), dense=(16, 8), dropout=0.1)
    state, history = training.train(rows, val, design, epochs=12, batch=20, workers=3, rate=0.02, seed=1, patience=4)
    assert max(h["val_acc"] for h in history) > 0.95
    scores = evaluate.macro_scores(evaluate.top_k(training.long_logits(training.scored(val, state)), 1).select("label", F.col("class").alias("predicted"))).first()
    assert scores.accuracy > 0.95


def test_odd_rows_and_designs(spark):
    rows = planted(spark, 10)
    state, history = training.train(rows.limit(0), rows, SMALL, 3)
    assert history == [] and (state["last.weight"] == training.initial(SMALL, 42)["last.weight"]).all()
    few, history = training.train(rows, rows.limit(0), SMALL, 2, batch=64)  # one batch that is not full
    assert len(history) == 2 and history[0]["val_acc"] == 0
    odd = rows.unionByName(spark.createDataFrame([(99, 7, [0.0] * 20)], rows.schema))
    with pytest.raises(ValueError, match="row 99"):
        training.train(odd, rows, SMALL, 1)
    with pytest.raises(ValueError, match="too short"):
        training.Design(length=5, classes=2, conv=((2, 9, 0, 2),)).flattened()
    mixed = spark.createDataFrame([(None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0])], "id long, label int, v array<double>")
    assert [r.id for r in training.usable(mixed, "id", "label", "v").collect()] == [3]


def test_stop_counts_values_that_do_not_rise():
    stop = training.Stop(3)
    assert [stop(v) for v in (0.5, 0.6, 0.6, 0.6005, 0.6002)] == [False, False, False, False, True]


@pytest.mark.parametrize("acquire", ["badge", "random"])
def test_learning_rounds_with_the_network(spark, tmp_path, acquire):
    rows, val = planted(spark, 150, 7), planted(spark, 45, 8, shift=1000)
    design = training.Design(length=20, classes=3, conv=((4, 5, 2, 2),), dense=(12, 8), dropout=0.1)
    net = dataset.Network(design, val, epochs=8, batch=12, workers=2, rate=0.02)
    found = dataset.learning_rounds(spark, rows, 3, 4, 5, 2, acquire, path=f"file://{tmp_path}/{acquire}", network=net)
    got = sorted((r["round"], r.n_samples, r.acc) for r in found.collect())
    assert [r[:2] for r in got] == [(0, 12), (1, 27), (2, 42)]
    assert got[-1][2] > 0.6
