"""Samples as tensors: ragged arrays, their padding, files and manifest, and the composed export."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import samples, scale
from tidemark.sources import tensors


def test_ragged_columns_are_padded_and_cut():
    x = tensors.stacked(pa.array([[[1.0, 2.0], [3.0]], [], None, [[4.0, None, 9.0], [5.0], [6.0]]]), [2, 2])
    assert x.to_numpy_ndarray().tolist() == [[[1, 2], [3, 0]], [[0, 0]] * 2, [[0, 0]] * 2, [[4, 0], [5, 0]]]
    assert tensors.stacked(pa.array([[1, 2], [3]], pa.list_(pa.int32())), [3]).to_numpy_ndarray().tolist() == [[1, 2, 0], [3, 0, 0]]
    assert len(tensors.stacked(pa.array([], pa.list_(pa.float32())), [3])) == 0
    with pytest.raises(ValueError, match="fewer axes"):
        tensors.stacked(pa.array([[1.0]]), [1, 1])


def test_files_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(i, [[float(i), 1.0]] * (i % 4), [i]) for i in range(20)], "id int, x array<array<float>>, y array<int>").repartition(3)
    shapes = tensors.longest(rows, {"x": [2]}) | {"y": [1]}
    assert shapes == {"x": [3, 2], "y": [1]}
    tensors.write_tensors(rows, f"{tmp_path}/t", shapes)
    got = {r.id: r for r in tensors.read_tensors(spark, f"{tmp_path}/t").collect()}
    assert {i: r.x for i, r in got.items()} == {i: [[float(i), 1.0]] * (i % 4) + [[0.0, 0.0]] * (3 - i % 4) for i in range(20)}
    assert all(r.y == [i] for i, r in got.items())
    told = json.loads((tmp_path / "t" / "_tensors.json").read_text())
    assert sum(f["rows"] for f in told["files"]) == 20
    with pa.memory_map(f"{tmp_path}/t/{told['files'][0]['file']}") as f:
        x = pa.ipc.open_file(f).read_all().column("x").combine_chunks().to_numpy_ndarray()
        assert x.shape == (told["files"][0]["rows"], 3, 2) and x.dtype == np.float32
    # a file that no manifest names doesn't count; another run adds to it, or takes its place
    (tmp_path / "t" / "part-lost.arrow").write_bytes(b"broken")
    tensors.write_tensors(rows.where("id < 2"), f"{tmp_path}/t", shapes, "append")
    assert tensors.read_tensors(spark, f"{tmp_path}/t").count() == 22
    tensors.write_tensors(rows.where("id < 2"), f"{tmp_path}/t", shapes)
    assert tensors.read_tensors(spark, f"{tmp_path}/t").count() == 2
    tensors.write_tensors(rows.limit(0), f"{tmp_path}/t", shapes)
    assert tensors.read_tensors(spark, f"{tmp_path}/t").count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    """Four subjects with a stay of 3 to 6 rows and nulls; hours left to its end as labels from row 1 on."""
    grid = [(s, 10 * s, b, None if (s + b) % 3 == 0 else float(s * b), float(b)) for s in range(1, 5) for b in range(s + 2)]
    labels = [(s, 10 * s, float(b), 24.0 * (s + 2 - b)) for s in range(1, 5) for b in range(1, s + 1)]
    return spark.createDataFrame(grid, "SUBJECT_ID int, ICUSTAY_ID int, bins int, v double, w double"), spark.createDataFrame(labels, "SUBJECT_ID int, ICUSTAY_ID int, t double, y double")


def test_export_of_prefixes(spark, tables):
    grid, labels = tables
    imputer = scale.fit_imputer(grid, ["v"], "mean")
    scaler = scale.fit_scaler(scale.impute(grid, imputer), ["v", "w"], "minmax")
    got = {(r.SUBJECT_ID, r.t): r for r in samples.exported(grid, labels, ["v", "w"], imputer=imputer, scaler=scaler, binning="custom").collect()}
    known = [r.v for r in grid.collect() if r.v is not None]
    filled = {(r.SUBJECT_ID, r.bins): (sum(known) / len(known) if r.v is None else r.v, r.w) for r in grid.collect()}
    low, high = (np.array(list(filled.values())).min(0), np.array(list(filled.values())).max(0))
    assert set(got) == {(r.SUBJECT_ID, r.t) for r in labels.collect()}
    for (s, t), r in got.items():
        want = [(np.array(filled[s, b]) - low) / (high - low) for b in range(int(t) + 1)]
        assert r.n == len(want) and np.allclose(r.x, want, atol=1e-6)
        assert r.y == [float(s + 2 - t)]  # single days are a class each


def test_export_of_stays(spark, tables):
    grid, labels = tables
    got = {r.SUBJECT_ID: r for r in samples.exported(grid, labels, ["w"], deep_supervision=True, binning="custom", one_hot=True, cut=True).collect()}
    for s, r in got.items():
        assert r.n == s + 1 and r.m == [0] + [1] * s  # the last row has no label, and goes
        assert r.y[0] == [0.0] * 10 and [row.index(1.0) for row in r.y[1:]] == [s + 2 - b for b in range(1, s + 1)]
    whole = {r.SUBJECT_ID: r for r in samples.exported(grid, labels, ["w"], deep_supervision=True).collect()}
    assert all(r.n == s + 2 and r.m[-1] == 0 and r.y[1] == [24.0 * (s + 1)] for s, r in whole.items())


def test_which_subjects_are_exported(spark, tables):
    grid, labels = tables
    subjects = lambda **k: sorted({r.SUBJECT_ID for r in samples.exported(grid, labels, ["w"], **k).collect()})
    assert subjects(subject_ids=[2, 3], n_samples=1) == [2, 3]
    assert subjects(subject_ids=[]) == []
    assert sum(subjects(n_samples=7)) == 7  # subject s has s labels
    assert len(subjects(n_samples=2, deep_supervision=True)) == 2
    for bad in ({"binning": "x"}, {"one_hot": True}):
        with pytest.raises(ValueError):
            samples.exported(grid, labels, ["w"], **bad)


def test_export_of_nothing(spark, tables, tmp_path):
    grid, labels = tables
    none = samples.exported(grid, labels.limit(0), ["w"])
    tensors.write_tensors(none, f"{tmp_path}/t", tensors.longest(none, {"x": [1]}))
    assert tensors.read_tensors(spark, f"{tmp_path}/t").select(F.size("x")).count() == 0
