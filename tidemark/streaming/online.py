"""Models that learn from a stream: a batch is scored by what was learned before it, and only then learned from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.timeseries import quoted
from tidemark.streaming.jobs import now

#: Places of a model's coefficients: -1 is the intercept, then a feature each.
MODEL = "batch long, place int, weight double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal lengths as rows; null numbers count as 0."""
    if not len(column):
        return np.empty((0, 0))
    width = len(column[0])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != width * len(column):
        raise ValueError("rows have features of different number")
    return np.nan_to_num(flat).reshape(len(column), width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def _margins(x: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    w = np.array([weights.get(i, 0.0) for i in range(x.shape[1])])
    return x @ w + weights.get(-1, 0.0)


def scored(rows: DataFrame, weights: dict[int, float], features: str = "features", score: str = "p") -> DataFrame:
    """rows with the probability of class 1 by a logistic model, all coefficients 0 where none are known. weights is as long as a row's features."""
    some = F.array(*(F.lit(float(weights[i])) for i in range(max(weights) + 1))) if weights and max(weights) >= 0 else F.array().cast("array<double>")
    each = F.zip_with(F.col(features), some, lambda x, w: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(w, F.lit(0.0)))
    margin = F.aggregate(each, F.lit(float(weights.get(-1, 0.0))), lambda a, v: a + v)
    return rows.withColumn(score, 1.0 / (1.0 + F.exp(-margin)))


def gradient(rows: DataFrame, weights: dict[int, float], features: str = "features", y: str = "y") -> DataFrame:
    """(place, g, n): the logistic loss' gradient, summed over the rows, and their number; -1 is the intercept. A task gives one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            x, label = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if not len(label):
                continue
            miss = _sigmoid(_margins(x, weights)) - label
            g = np.append(miss.sum(), x.T @ miss)
            total, n = g if total is None else total + g, n + len(label)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total) - 1, dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], ["place", "g", "n"])

    known = rows.where(F.col(y).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    return known.mapInArrow(run, "place int, g double, n long").groupBy("place").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def weights_after(spark: SparkSession, path: str, batch: int | None = None) -> dict[int, float]:
    """The coefficients after a batch, or the last one: as many numbers as there are features."""
    try:
        kept = spark.read.schema(MODEL).parquet(f"{path}/model")
    except AnalysisException:
        return {}
    if batch is None:
        batch = kept.agg(F.max("batch")).first()[0]
    return {r["place"]: r["weight"] for r in kept.where(F.col("batch") == batch).collect()} if batch is not None else {}


def learn(rows: DataFrame, path: str, checkpoint: str, features: str = "features", y: str = "y", rate: float = 0.1, l2: float = 0.0) -> StreamingQuery:
    """Scores each batch of a stream with the model so far, then takes one step down the gradient of its mean loss.

    `path` gets scored/ (the rows with p, by batch) and model/ (the coefficients after each batch). Both are named by
    the batch and replaced when it is run again, and a batch starts from the coefficients of the one before: a batch
    that broke off, or a query that is started anew with its checkpoint, gives what an unbroken run gives. Rows without
    a label are scored and not learned from. The rows of a batch are read twice and never sorted or shuffled; a task
    sums up its own, and one row a feature comes to the driver.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = weights_after(spark, path, number - 1)
        scored(batch, before, features).write.mode("overwrite").parquet(f"{path}/scored/batch={number}")
        told = gradient(batch, before, features, y).collect()
        after = dict(before)
        for r in told:
            w = before.get(r["place"], 0.0)
            after[r["place"]] = w - rate * (r["g"] / r["n"] + (l2 * w if r["place"] >= 0 else 0.0))
        spark.createDataFrame([(number, p, float(w)) for p, w in sorted(after.items())], MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model/of={number}")

    return now(rows.writeStream.foreachBatch(step), checkpoint)


def progress(scored_rows: DataFrame, by: Sequence[str] = ("batch",), y: str = "y", p: str = "p") -> DataFrame:
    """(by, n, log_loss, brier, accuracy) of scores that were made before their rows were learned."""
    told = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), quoted(p)))
    loss = -F.when(quoted(y) == 1, F.log(told)).otherwise(F.log(1 - told))
    known = scored_rows.where(quoted(y).isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("log_loss"), F.avg((quoted(p) - quoted(y)) ** 2).alias("brier"), F.avg(((quoted(p) > 0.5).cast("int") == quoted(y)).cast("double")).alias("accuracy"))
