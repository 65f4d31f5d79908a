"""Queries that make many rows of a stay deal stays out to tasks of bounded rows; joins and products are made once and in bounded memory."""

import math
import random
import re

import numpy as np
import pytest

from tidemark.catalog import proxies, queries, series
from tidemark.operators import models
from tidemark.sources import tensors

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j13_prefix_rows", "w6_a8_window_statistics"])
def test_stays_are_dealt_to_tasks_of_bounded_rows_and_not_again(spark, monkeypatch, name):
    monkeypatch.setattr(proxies, "STAY_ROWS", 100)
    text = plan(queries()[name](spark, DIR))
    assert set(re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), (\w+)", text)) == {("10", "REPARTITION_BY_NUM")}


def test_exported_samples_are_in_files_of_bounded_stays(spark, monkeypatch):
    monkeypatch.setattr(proxies, "STAY_ROWS", 100)
    seen, write = [], tensors.write_tensors
    monkeypatch.setattr(tensors, "write_tensors", lambda made, *a: (seen.append(plan(made)), write(made, *a))[1])
    assert queries()["e9_array_export"](spark, DIR).count()
    assert set(re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), (\w+)", seen[0])) == {("10", "REPARTITION_BY_NUM")}


def test_sixth_digit_is_that_of_round(spark):
    draw = random.Random(4)
    numbers = [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-8, 14) for _ in range(3000)] + [i / 64 for i in range(-300, 300)] + [0.0, -1e-9, math.inf, math.nan, None, 2.0**33, 5e-7, -5e-7, 1.0000005]
    df = spark.createDataFrame([(x,) for x in numbers], "v double")
    assert "FLOOR(" in plan(queries()["w6_a8_window_statistics"](spark, DIR))
    from pyspark.sql import functions as F

    rows = df.select("v", (series._sixth(F.col("v")) + 0.0).alias("a"), (F.round("v", 6) + 0.0).alias("b")).collect()
    assert all((r.a is None) == (r.b is None) and (r.a is None or r.a == r.b or (r.a != r.a and r.b != r.b)) for r in rows)


def test_lines_are_joined_once(spark, monkeypatch):
    seen, fit = [], models.linear
    monkeypatch.setattr(models, "linear", lambda train: (seen.append(plan(train)), fit(train))[1])
    out = queries()["g3_line"](spark, DIR)
    assert "Join" not in seen[0] + plan(out) and out.count() == 2


def test_products_of_neighbours_are_of_bounded_queries(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 6)).round(1)
    rows = spark.createDataFrame([(i, float(i % 3), v.tolist()) for i, v in enumerate(x)], "id long, label double, x array<double>")
    got = {r.id: r.p for r in models.neighbours(rows, rows, 5, block_rows=100).collect()}
    d = np.square(x[:, None] - x).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(400):
        near = np.lexsort((np.arange(400), d[i]))[:5]
        assert got[i] == pytest.approx(np.mean(near % 3))
    assert models.QUERIES * 16_384 * 8 < 10_000_000
