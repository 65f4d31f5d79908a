"""Plans and pieces that only tables of size need: what is many rows is neither broadcast nor shuffled again."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.catalog import queries
from tidemark.operators import extract, features
from tidemark.sources import stores

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def joins(text):
    return re.findall(r"\w*Join\b", text)


@pytest.mark.parametrize("name", ["a9_feature_vector", "w6_a8_window_statistics"])
def test_vectors_of_labels_are_in_no_join(spark, name):
    above, below = plan(spark, name).split("MapInArrow", 1)
    assert not joins(above) and joins(below)[0] == "SortMergeJoin"


def test_pieces_of_many_labels_are_those_of_few(monkeypatch):
    draw = np.random.default_rng(1)
    n_rows, n_labels = np.array([0, 1, 40, 3, 0, 200, 9]), np.array([4, 0, 60, 1, 0, 33, 5])
    listed = lambda ends, x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ends)], pa.int32()), x)
    h = np.concatenate([np.sort(draw.integers(0, 100, n) / 3) for n in n_rows])
    t = np.concatenate([np.arange(n) * 0.7 for n in n_labels])
    v = [pa.array(draw.normal(50, 9, len(h)), mask=draw.random(len(h)) < share) for share in (0.3, 0.9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), listed(n_labels, pa.array(t, mask=t > 35)), listed(n_rows, pa.array(h)), *(listed(n_rows, x) for x in v)], ["k", "_t", "_h", "_v0", "_v1"])
    window, told = features.SUB_WINDOWS, []
    for most in (10**9, 14):
        monkeypatch.setattr(features, "TOLD", most)
        one = {}
        for _, row, which, some, stats in features._pieces(batch, 2, window):
            for i, s in zip(some, stats.reshape(-1, len(window) * 6), strict=True):
                one[int(which[i % len(row)]), int(i // len(row))] = (int(row[i % len(row)]), s)
        told.append(one)
    assert told[0].keys() == told[1].keys() and len(told[0]) > 100
    at = np.r_[0, np.cumsum(n_rows)]
    for (label, c), (row, s) in told[0].items():
        assert row == told[1][label, c][0] and s == pytest.approx(told[1][label, c][1], abs=1e-9, nan_ok=True)
        own = [x for x, hour in zip(v[c][at[row] : at[row + 1]].to_pylist(), h[at[row] : at[row + 1]], strict=True) if x is not None and hour < t[label] + features.EPS]
        assert t[label] <= 35 and s[[0, 1, 2, 5]] == pytest.approx([min(own), max(own), np.mean(own), len(own)])


def test_equal_lines_of_a_stay_all_count(spark, tmp_path):
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(50 if t == "orders" else 10**6).write.parquet(f"{tmp_path}/{t}.parquet")
    once = {(r.SUBJECT_ID, r.ICUSTAY_ID): r for r in queries()["j10_w1_episodes"](spark, str(tmp_path)).collect()}
    again = spark.read.parquet(f"{DIR}/lineitem.parquet")
    again.write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    twice = {(r.SUBJECT_ID, r.ICUSTAY_ID): r for r in queries()["j10_w1_episodes"](spark, str(tmp_path)).collect()}
    assert once and once.keys() == twice.keys()
    assert all((twice[k].n, twice[k].quantity, twice[k].first) == (2 * r.n, 2 * r.quantity, r.first) for k, r in once.items())


def test_no_join_of_stored_tables_is_broadcast_by_the_size_of_files(spark, monkeypatch):
    threshold, seen, recover = "spark.sql.autoBroadcastJoinThreshold", [], extract.recover_stays
    before = spark.conf.get(threshold)
    monkeypatch.setattr(extract, "recover_stays", lambda *a: (seen.append(spark.conf.get(threshold)), recover(*a))[1])
    common = stores.common_subjects
    monkeypatch.setattr(stores, "common_subjects", lambda *a: (seen.append(spark.conf.get(threshold)), common(*a))[1])
    assert set(joins(plan(spark, "r8_r4_load_data"))) == {"SortMergeJoin"}
    assert len(seen) > 3 and set(seen) == {"-1"} and spark.conf.get(threshold) == before


def test_labels_of_stays_are_in_no_join_and_arrays_of_them_in_no_rows(spark):
    assert "explode" not in plan(spark, "t5_multi_labels")
    for name in ("t3_w9_los_labels", "t2_w7_w8_decomp_labels"):
        above, below = plan(spark, name).split("Generate", 1)
        assert not joins(above) and joins(below)


def test_hourly_arrays_are_made_after_the_last_join(spark):
    text = plan(spark, "t5_multi_labels")
    last = re.search(r"\w*Join\b", text).start()
    assert "transform(" in text[:last] and "transform(" not in text[last:]


@pytest.mark.parametrize("name", ["t3_w9_los_labels", "t2_w7_w8_decomp_labels", "t4_j16_a13_pheno_labels"])
def test_rows_are_counted_up_by_stay_before_any_join(spark, name):
    """The rows of a stay are neither sorted for a join nor made wide."""
    above, below = plan(spark, name).split("partial_min(hours", 1)
    assert joins(above) and not joins(below.split("partial_", 1)[0]) and not re.search(r"keys=\[SUBJECT_ID[^]]*hours", above + below)


def test_stays_are_those_with_a_row_inside(spark):
    from tidemark.operators import tasks

    rows = [(1, -3.0), (1, 0.0), (1, 5.0), (1, None), (2, -1.0), (3, 30.5), (3, 40.0), (4, 30.4), (4, float("nan")), (5, None), (6, 1.0)]
    series = spark.createDataFrame([(n, n, h) for n, h in rows], "SUBJECT_ID long, ICUSTAY_ID long, hours double")
    episodic = spark.createDataFrame([(n, n, 30.4 / 24, None if n == 6 else 0) for n in range(1, 8)], "SUBJECT_ID long, ICUSTAY_ID long, LOS double, MORTALITY int")
    inside = tasks._with_los(series, episodic, tasks.KEYS).groupBy("ICUSTAY_ID").agg({"hours": "min"})
    assert {tuple(r) for r in tasks._stays(series, episodic, tasks.KEYS).select("ICUSTAY_ID", "_first").collect()} == {tuple(r) for r in inside.collect()} == {(1, 0.0), (4, 30.4)}


def test_differences_are_counted_in_one_pass_by_tasks_of_bounded_rows(spark, monkeypatch):
    from tidemark.catalog import proxies

    monkeypatch.setattr(proxies, "TASK_ROWS", 1000)
    text = plan(spark, "o8_difference")
    assert text.count("Exchange") == 1 and re.search(r"REPARTITION_BY_NUM", text) and text.count("HashAggregate") == 2
    a = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x"), (3, "y")], "k int, s string")
    b = spark.createDataFrame([(1, None), (2, "x"), (4, None), (4, None)], "k int, s string")
    for tasks in (None, 3):
        got = extract.difference(a, b, tasks)
        assert got.columns == a.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, None), (1, None), (3, "y"), (4, None), (4, None)]))


def test_lines_with_many_labels_are_in_tasks_of_bounded_rows(spark, monkeypatch):
    from tidemark.catalog import proxies

    monkeypatch.setattr(proxies, "TASK_ROWS", 1000)
    text = plan(spark, "w7_label_grid")
    assert text.count("REPARTITION_BY_NUM") == 2
