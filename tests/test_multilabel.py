"""All labels in the same passes, against one MLlib fit for each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidemark.operators import models, multilabel


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * [1, 10, 0.1, 1, 1, 1] + [0, 100, 0, 0, 0, 0]
    x[:, 5] = 3.0  # does not vary
    p = 1 / (1 + np.exp(-(x[:, :1] - (x[:, 1:2] - 100) / 10 * [0.5, 0, 1, 2])))
    y = (rng.random((400, 4)) < p).astype(float)
    y[:, 3] = 1 - y[:, 0]
    frame = pd.DataFrame({f"x{i}": x[:, i] for i in range(6)} | {f"y{i}": y[:, i] for i in range(4)})
    return models.assembled(spark.createDataFrame(frame), [f"x{i}" for i in range(6)], "y0").persist()


@pytest.mark.parametrize("l2", [0.001, 0.1])
def test_same_coefficients_as_single_fits(rows, l2):
    labels = [f"y{i}" for i in range(4)]
    got = multilabel.fit_labels(rows, labels, l2=l2)
    assert got.passes < 60
    for k, c in enumerate(labels):
        one = LogisticRegression(regParam=l2, maxIter=500, tol=1e-12).fit(rows.withColumn("label", F.col(c)))
        assert np.allclose(got.coefficients[k], one.coefficients.toArray(), atol=1e-6)
        assert got.intercepts[k] == pytest.approx(one.intercept, abs=1e-5)


def test_labels_that_rows_do_not_know(rows):
    from pyspark.ml.functions import vector_to_array

    some = rows.select(vector_to_array("features").alias("features"), F.when(F.rand(1) < 0.5, F.col("y0")).alias("a"), "y0", F.lit(None).cast("double").alias("b"), F.lit(1).alias("one")).persist()
    got = multilabel.fit_labels(some, ["a", "b"])
    alone = multilabel.fit_labels(some.where("a IS NOT NULL"), ["a"])
    assert not got.coefficients[1].any() and got.intercepts[1] == 0
    # standardised by all rows, not by those that know a: only the penalty differs by it
    assert np.allclose(got.coefficients[0], alone.coefficients[0], rtol=0.05, atol=1e-2)
    told = some.select(got.scores().alias("p")).collect()
    assert all(len(r.p) == 2 and r.p[1] == 0.5 for r in told)
    with pytest.raises(ValueError, match="no rows"):
        multilabel.fit_labels(some.limit(0), ["a"])
    assert some.limit(0).select(got.scores()).count() == 0
