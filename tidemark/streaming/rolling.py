"""Metrics of the latest rows of a stream, by counts from which rows that leave are taken back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

WEIGHTS = ("none", "linear", "quadratic")


class Counts:
    """How often each score was given to either label, and each class to each: all that the metrics need. Adding with -1 takes rows back."""

    def __init__(self, bins: int, classes: int, held: bytes | None = None):
        self.bins, self.classes = bins, classes
        self.flat = np.zeros(2 * bins + classes * classes, np.int64) if held is None else np.frombuffer(held, np.int64).copy()

    def add(self, rows: np.ndarray, sign: int = 1) -> None:
        """rows: (score bin, label 0 or 1, true class, told class); -1 for what isn't known."""
        scored = rows[(rows[:, 0] >= 0) & (rows[:, 1] >= 0)]
        told = rows[(rows[:, 2] >= 0) & (rows[:, 3] >= 0)]
        np.add.at(self.flat, scored[:, 1] * self.bins + scored[:, 0], sign)
        np.add.at(self.flat, 2 * self.bins + told[:, 2] * self.classes + told[:, 3], sign)

    def auc(self) -> float | None:
        """Area under the ROC curve, scores of a bin as ties; None where a label is missing."""
        neg, pos = self.flat[: self.bins].astype(float), self.flat[self.bins : 2 * self.bins].astype(float)
        if not neg.sum() or not pos.sum():
            return None
        return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))

    def kappa(self, weights: str) -> float | None:
        """Cohen's kappa; 0 where nothing is expected to differ, None without rows."""
        n = self.flat[2 * self.bins :].reshape(self.classes, self.classes).astype(float)
        if not n.sum():
            return None
        d = np.abs(np.subtract.outer(np.arange(self.classes), np.arange(self.classes)))
        w = {"none": d > 0, "linear": d, "quadratic": d * d}[weights]
        expected = (w * np.outer(n.sum(1), n.sum(0))).sum()
        return float(1 - (w * n).sum() * n.sum() / expected) if expected else 0.0


class _Rolling(StatefulProcessor):
    """A key's last rows as a ring, and their counts."""

    def __init__(self, size: int, every: int, bins: int, classes: int, weights: str):
        self.size, self.every, self.bins, self.classes, self.weights = size, every, bins, classes, weights

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "seen long, rows binary, counts binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["order", "tie"], kind="stable")
        seen, held, counts = 0, np.empty((0, 4), np.int64), Counts(self.bins, self.classes)
        if self.latest.exists():
            seen, ring, flat = self.latest.get()
            held, counts = np.frombuffer(bytes(ring), np.int32).reshape(-1, 4).astype(np.int64), Counts(self.bins, self.classes, bytes(flat))
        known = len(held)
        every = np.concatenate([held, got[["score", "label", "own", "told"]].fillna(-1).to_numpy(np.int64)])
        told, at = [], known
        while at < len(every):
            end = min(len(every), at + self.every - seen % self.every)
            counts.add(every[at:end])
            low, high = max(0, at - self.size), max(0, end - self.size)
            counts.add(every[low:high], -1)
            seen, at = seen + end - at, end
            if seen % self.every == 0:
                told.append((*key, seen, min(seen, self.size), counts.auc(), counts.kappa(self.weights)))
        self.latest.update((int(seen), every[max(0, len(every) - self.size) :].astype(np.int32).tobytes(), counts.flat.tobytes()))
        if told:
            yield pd.DataFrame(told, columns=["key", "seen", "n", "roc_auc", "kappa"]).astype({"roc_auc": "Float64", "kappa": "Float64"})

    def close(self) -> None:
        pass


def rolling_metrics(rows: DataFrame, by: str, order: str, tie: str, y: str, p: str, own: Column, told: Column, size: int = 1000, every: int = 100, bins: int = 1000, classes: int = 2, weights: str = "none") -> DataFrame:
    """(by, seen, n, roc_auc, kappa) of the last `size` rows of each `by`, told after every `every` of them.

    Rows of a batch count in the order of (order, tie), batches in the order in which they come. roc_auc is of label y
    (0 or 1) and score p in [0, 1], which is put into `bins` equal bins (a sum 1e-9 below a bin's start counts to it);
    kappa is of the classes own and told, 0 to classes - 1. A null takes no part in what needs it, but the row counts. A
    row is added once and taken back once, whatever the window's size; the state of a key is its last `size` rows and
    the counts. Start the query inside keyed_state(), in append mode.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"unknown weights {weights}")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(p) * bins + 1e-9).cast("int")))
    kind = rows.schema[by].dataType.simpleString()
    told_rows = rows.select(F.col(by).alias("key"), F.col(order).alias("order"), F.col(tie).alias("tie"), F.when(F.col(p).isNotNull(), bin_).alias("score"), F.col(y).cast("int").alias("label"), own.cast("int").alias("own"), told.cast("int").alias("told"))
    out = told_rows.groupBy("key").transformWithStateInPandas(_Rolling(size, every, bins, classes, weights), f"key {kind}, seen long, n long, roc_auc double, kappa double", "Append", "None")
    return out.withColumnRenamed("key", by)
