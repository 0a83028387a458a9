"""Array files as a data source, and checkpoints of the training framework."""

import collections
import io
import os
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.operators import network, training
from prismflow.sources import arrays, checkpoints, patterns


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    arrays.register(spark)
    at = tmp_path_factory.mktemp("arrays")
    rng = np.random.default_rng(1)
    for name, shape in (("a", (700, 8, 1)), ("ab", (3, 8, 1)), ("b", (8, 1)), ("c", (8,)), ("d", (5, 8, 1))):
        x = rng.normal(size=shape).astype(np.float32 if name == "d" else np.float64)
        np.save(at / f"{name}_aug.npy", np.asfortranarray(x) if name == "ab" else x)
    np.save(at / "other.npy", np.zeros(3))
    return str(at)


def table(frame):
    return {(r.compound, r.sample_idx): tuple(r.spectrum) for r in frame.collect()}


def test_reads_what_the_other_reader_reads(spark, folder):
    got = spark.read.format("array_files").load(folder)
    assert table(got) == table(patterns.read_arrays(spark, folder)) and got.count() == 710
    assert got.rdd.getNumPartitions() == 3 + 4  # 700 rows in pieces of 256, and one piece of each other file
    assert table(spark.read.format("array_files").option("rows", 100).load(f"file://{folder}")) == table(got)


def scanned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_leave_files_and_rows_alone(spark, folder):
    whole = table(spark.read.format("array_files").load(folder))
    read = spark.read.format("array_files").load(folder)
    for condition, wanted, parts in (
        ("compound = 'b'", lambda c, k: c == "b", 1),
        ("compound in ('b', 'c', 'x')", lambda c, k: c in "bc", 2),
        ("compound like 'a%'", lambda c, k: c[0] == "a", 4),
        ("sample_idx >= 600 and sample_idx < 640", lambda c, k: 600 <= k < 640, 1),
        ("compound = 'a' and sample_idx = 300", lambda c, k: (c, k) == ("a", 300), 1),
        ("compound = 'none'", lambda c, k: False, 1),
        ("compound > 'b'", lambda c, k: c > "b", 7),
    ):
        found = read.where(condition)
        assert table(found) == {k: v for k, v in whole.items() if wanted(*k)}, condition
        assert found.rdd.getNumPartitions() == parts, condition


def test_unwanted_files_are_not_opened(spark, folder, tmp_path):
    os.symlink(f"{folder}/b_aug.npy", tmp_path / "b_aug.npy")
    (tmp_path / "broken_aug.npy").write_bytes(b"no array")
    assert spark.read.format("array_files").load(str(tmp_path)).where("compound = 'b'").count() == 1
    with pytest.raises(Exception, match="broken_aug.npy|magic"):
        spark.read.format("array_files").load(str(tmp_path)).count()


def test_pickled_and_misshapen_files_are_refused(spark, tmp_path):
    for k, x in enumerate((np.array([{}], object), np.zeros((2, 3, 4)), np.zeros((2, 2, 1, 1)))):
        (tmp_path / str(k)).mkdir()
        np.save(tmp_path / str(k) / "x_aug.npy", x)
        with pytest.raises(Exception, match="x_aug.npy"):
            spark.read.format("array_files").load(f"{tmp_path}/{k}").count()


def test_writes_and_overwrites(spark, folder, tmp_path):
    rows = spark.read.format("array_files").load(folder).withColumn("label", F.length("compound"))
    write = lambda r, mode: r.select("spectrum", "label").repartition(3).write.format("array_files").mode(mode).option("rows", 100).save(f"{tmp_path}/out")
    write(rows, "append")
    names = os.listdir(tmp_path / "out")
    assert all(n.startswith("part-") for n in names)
    parts = [n for n in names if "labels" not in n]
    x = np.concatenate([np.load(tmp_path / "out" / n)[:, :, 0] for n in sorted(parts)])
    y = np.concatenate([np.load(tmp_path / "out" / f"{n.removesuffix('.npy')}-labels.npy") for n in sorted(parts)])
    assert sorted((tuple(v), int(k)) for v, k in zip(x.tolist(), y, strict=True)) == sorted((tuple(r.spectrum), r.label) for r in rows.collect())
    assert spark.read.format("array_files").option("suffix", ".npy").load(f"{tmp_path}/out").where("not compound like '%labels'").count() == 710
    write(rows.limit(7), "overwrite")
    assert sum(len(np.load(tmp_path / "out" / n)) for n in os.listdir(tmp_path / "out") if "labels" not in n) == 7


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.when(F.col("id") == 33, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("spectrum")).repartition(4)
    with pytest.raises(Exception, match="one length"):
        rows.coalesce(1).write.format("array_files").mode("append").save(f"{tmp_path}/out")
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("part-")]


def archive(state, evil=None):
    """An archive as the framework writes it, with stand-ins for its classes."""
    made = {name: types.ModuleType(name) for name in ("torch", "torch._utils")}
    stores = []

    class FloatStorage:
        pass

    def _rebuild_tensor_v2(*_):
        pass

    FloatStorage.__module__, FloatStorage.__qualname__ = "torch", "FloatStorage"
    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    made["torch"].FloatStorage, made["torch._utils"]._rebuild_tensor_v2 = FloatStorage, _rebuild_tensor_v2

    class Store:
        pass

    class Writer(pickle.Pickler):
        def persistent_id(self, obj):
            return ("storage", FloatStorage, str(stores.index(obj)), "cpu", obj.n) if isinstance(obj, Store) else None

        def reducer_override(self, obj):
            if isinstance(obj, np.ndarray):
                store = Store()
                store.data, store.n = np.ascontiguousarray(obj.T if obj.ndim == 2 else obj, "<f4").tobytes(), obj.size
                stores.append(store)
                stride = (1, obj.shape[0]) if obj.ndim == 2 else tuple(int(np.prod(obj.shape[k + 1 :])) for k in range(obj.ndim))
                return _rebuild_tensor_v2, (store, 0, obj.shape, stride, False, collections.OrderedDict())
            return NotImplemented

    out, pickled = io.BytesIO(), io.BytesIO()
    sys.modules |= made
    try:
        Writer(pickled, 2).dump(state if evil is None else evil)
    finally:
        for name in made:
            del sys.modules[name]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("best/data.pkl", pickled.getvalue())
        z.writestr("best/byteorder", "little")
        for k, store in enumerate(stores):
            z.writestr(f"best/data/{k}", store.data)
    return out.getvalue()


DESIGN = training.Design(length=20, classes=3, conv=((3, 4, 2, 2), (2, 3, 1, 3)), dense=(6, 5), dropout=0.4)


def framework_names(state):
    out = {k.replace("conv.", "conv_layers.conv_"): v for k, v in state.items() if k.startswith("conv.") and k.rsplit(".", 1)[1] in ("weight", "bias")}
    for k in range(2):
        out |= {f"classifier.{4 * k}.{n}": state[f"dense.{k}.{n}"] for n in ("weight", "bias")}
        out |= {f"classifier.{4 * k + 1}.{a}": state[f"dense.{k}.{b}"] for a, b in (("weight", "gain"), ("bias", "offset"), ("running_mean", "mean"), ("running_var", "var"))}
    return out | {"classifier.8.weight": state["last.weight"], "classifier.8.bias": state["last.bias"]}


@pytest.mark.parametrize("wrapper", [None, "state_dict"])
def test_checkpoint_gives_the_same_network(spark, tmp_path, wrapper):
    rng = np.random.default_rng(4)
    state = {k: (np.float32(rng.normal(size=v.shape) ** 2 if k.endswith("var") else rng.normal(size=v.shape)) if v.ndim else v) for k, v in training.initial(DESIGN, 1).items()}
    named = collections.OrderedDict(framework_names(state)) | {"extra": np.zeros(2, np.float32)}
    content = {"epoch": 3, "note": "x", wrapper: {f"module.{k}": v for k, v in named.items()}} if wrapper else named
    (tmp_path / "best.pth").write_bytes(archive(content))
    weights, missing, unused = checkpoints.load_network(spark, str(tmp_path / "best.pth"), DESIGN)
    assert missing == [] and unused == []
    x = rng.normal(size=(7, 20))
    for got, expected in zip(network.forward(weights, x), network.forward(network.from_state({k: v.astype(float) if v.ndim else v for k, v in state.items()}), x), strict=True):
        np.testing.assert_allclose(got, expected, rtol=1e-9)
    del named["classifier.8.bias"]
    (tmp_path / "part.pth").write_bytes(archive(dict(named)))
    assert checkpoints.load_network(spark, str(tmp_path / "part.pth"), DESIGN)[1] == ["last.bias"]
    with pytest.raises(ValueError, match="shape"):
        checkpoints.load_network(spark, str(tmp_path / "part.pth"), training.Design(length=20, classes=4, conv=DESIGN.conv, dense=DESIGN.dense))


class Evil:
    def __reduce__(self):
        return os.system, ("touch /tmp/prismflow-evil",)


class Sly:
    def __reduce__(self):
        return getattr, (collections.OrderedDict, "fromkeys")


def test_hostile_and_broken_archives_are_refused(spark, tmp_path):
    for evil in (Evil(), {"w": Evil()}, Sly()):
        with pytest.raises(checkpoints.Refused, match="no part of a tensor"):
            checkpoints.parse_checkpoint(archive(None, evil))
    assert not os.path.exists("/tmp/prismflow-evil")
    whole = archive({"w": np.zeros((4, 5), np.float32)})
    assert checkpoints.parse_checkpoint(whole)["w"].shape == (4, 5)
    for content in (b"", b"PK", whole[:200], archive(None, [1, 2])):
        with pytest.raises(ValueError):
            checkpoints.parse_checkpoint(content)
    with pytest.raises(ValueError, match="beyond"):
        checkpoints._tensor(np.zeros(3), 0, (2, 2), (2, 1))
