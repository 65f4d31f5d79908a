"""Logistic regressions of many labels over the same features, all fitted in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class MultiLogistic:
    """A row of coefficients and an intercept for each label."""

    labels: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: int

    def scores(self, features: str = "features") -> Column:
        """The probability of each label, in their order, as an array; from an array of numbers."""
        w, b = self.coefficients, self.intercepts

        @F.pandas_udf("array<double>")
        def put(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(_sigmoid(np.stack(x.to_list()) @ w.T + b)))

        return put(F.col(features).cast("array<double>"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def _sums(rows: DataFrame, mean: np.ndarray, std: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each label, over its known rows: the gradient of its loss at w (intercept last), the loss and their number, summed up.

    One pass: a task multiplies its rows with all labels' coefficients at once and gives a row a label.
    """
    scale = np.where(std > 0, 1 / np.where(std > 0, std, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), w.shape[1] + 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for i in range(2))
            z = np.column_stack([(x - mean) * scale, np.ones(n)])
            margin, known = z @ w.T, ~np.isnan(y)
            miss = np.where(known, _sigmoid(margin) - np.nan_to_num(y), 0.0)
            loss = np.where(known, np.logaddexp(0.0, margin) - np.nan_to_num(y) * margin, 0.0)
            total += np.column_stack([miss.T @ z, loss.sum(0), known.sum(0)])
        lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * total.shape[1], pa.array(total.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), lists], ["label", "sums"])

    parts = rows.mapInArrow(run, "label int, sums array<double>")
    told = parts.groupBy("label").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()  # a row a label
    out = np.zeros((len(w), w.shape[1] + 2))
    for r in told:
        out[r["label"]] = r["sums"]
    return out


class _Descent:
    """Steps of one label: limited-memory BFGS, each trial point judged by the next pass."""

    def __init__(self, d: int, memory: int = 10):
        self.at, self.pairs, self.memory = np.zeros(d), [], memory
        self.value = self.slope = self.direction = None
        self.step, self.done = 1.0, False
        self.trial = self.at

    def told(self, value: float, slope: np.ndarray, tol: float) -> None:
        """The objective and its gradient at the trial point."""
        if self.done:
            return
        if self.value is not None and value > self.value + 1e-4 * self.step * float(self.slope @ self.direction) + 1e-15:
            self.step /= 2
            self.done = self.step < 1e-12  # nothing lower to be told apart
            self.trial = self.at if self.done else self.at + self.step * self.direction
            return
        if self.value is not None:
            s, y = self.trial - self.at, slope - self.slope
            if float(s @ y) > 1e-300:
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.at, self.value, self.slope = self.trial, value, slope
        if np.abs(slope).max() <= tol:
            self.done, self.trial = True, self.at
            return
        q, kept = slope.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        self.direction, self.step = -q, 1.0 if self.pairs else min(1.0, 1.0 / float(np.abs(slope).sum()))
        self.trial = self.at + self.step * self.direction


def fit_labels(train: DataFrame, labels: Sequence[str], features: str = "features", l2: float = 0.001, tol: float = 1e-9, passes: int = 500) -> MultiLogistic:
    """The logistic regression of each label that MLlib would fit alone, with penalty l2 on standardised coefficients.

    Every pass over the rows gives the gradient of all labels, each at its own trial point; a label that has converged
    takes part without moving. What comes to the driver is a number a label and feature. A row counts for the labels
    that it knows; a label without rows keeps 0. features is an array of numbers or an MLlib vector, and whoever calls
    this with rows that are dear to make keeps (persist) or stages them first.
    """
    vector = train.schema[features].dataType.typeName() not in ("array",)
    x = vector_to_array(features) if vector else F.col(features).cast("array<double>")
    rows = train.select(x.alias("x"), F.array(*(F.col(f"`{c}`").cast("double") for c in labels)).alias("y"))
    told = rows.agg(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s")).select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std")).first() if not rows.isEmpty() else None
    if told is None:
        raise ValueError("there are no rows to fit on")
    mean, std = np.array(told["mean"]), np.array(told["std"])
    d, some = len(mean), [_Descent(len(mean) + 1) for _ in labels]
    penalty = np.append(np.full(d, l2), 0.0)
    n = 0
    while n < passes and not all(s.done for s in some):
        w = np.stack([s.trial for s in some])
        sums, n = _sums(rows, mean, std, w), n + 1
        for s, own in zip(some, sums, strict=True):
            many = max(1.0, own[-1])
            s.told(float(own[-2] / many + 0.5 * (penalty * s.trial**2).sum()), own[:-2] / many + penalty * s.trial, tol)
    w = np.stack([s.at for s in some])
    coefficients = np.where(std > 0, w[:, :-1] / np.where(std > 0, std, 1.0), 0.0)
    return MultiLogistic(list(labels), coefficients, w[:, -1] - coefficients @ mean, n)
