"""Models that MLlib fits on the cluster, and calibration of their scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import codes
from tidemark.operators import metrics, scale


def assembled(rows: DataFrame, columns: Sequence[str], label: str = "y") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(rows.withColumn("label", F.col(label).cast("double")))


def logistic(train: DataFrame, l2: float = 0.001, c: float | None = None, l1: bool = False) -> Model:
    """With l2, or with the strength 1/(c n) as usual for a penalty l1 or l2."""
    strength = l2 if c is None else 1 / (c * max(1, train.count()))
    return LogisticRegression(regParam=strength, elasticNetParam=1.0 if l1 else 0.0, maxIter=50).fit(train)


def multi_logistic(train: DataFrame, labels: Sequence[str], l2: float = 0.001) -> dict[str, Model]:
    """A model for each label over the same features."""
    kept = train.persist()
    try:
        return {c: logistic(kept.withColumn("label", F.col(c).cast("double")), l2) for c in labels}
    finally:
        kept.unpersist()


def linear(train: DataFrame, l2: float = 0.0) -> Model:
    """G3."""
    return LinearRegression(regParam=l2, maxIter=50).fit(train)


CLASSIFIERS = {
    # G4, G6
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
    "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=1),
    "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=1),
}


def classifier(train: DataFrame, kind: str) -> Model:
    return CLASSIFIERS[kind]().fit(train)


def predictions(model: Model, rows: DataFrame) -> DataFrame:
    """rows with p: the score of class 1, or a regression's value."""
    out = model.transform(rows)
    return out.withColumn("p", vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction"))


#: Query rows that are compared with a block at a time.
QUERIES = 64
#: Pairs whose exact distances are computed at a time.
EXACT = 50_000


def neighbours(train: DataFrame, rows: DataFrame, k: int, id_col: str = "id", block_rows: int = 16_384) -> DataFrame:
    """(id, p): the mean label of the k rows of train that are nearest to each of rows by Euclidean distance, itself not among them.

    Both have columns id, label and x (an array of numbers, of one length); ties go to the smaller id. train is dealt
    into blocks, every row of rows visits each block with a running top k, and the blocks' best are merged.
    """
    blocks = train.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("_blocks"))  # one row
    own = train.crossJoin(F.broadcast(blocks)).select(F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int").alias("block"), F.lit(0).alias("part"), F.col(id_col).cast("long").alias("id"), F.col("label").cast("double").alias("label"), F.col("x").cast("array<double>").alias("x"))
    asked = rows.crossJoin(F.broadcast(blocks)).select(F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), F.lit(1).alias("part"), F.col(id_col).cast("long").alias("id"), F.lit(None).cast("double").alias("label"), F.col("x").cast("array<double>").alias("x"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            b, part, ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            at = np.flatnonzero(np.r_[True, (np.diff(b) != 0) | (np.diff(part) != 0)]) if len(b) else []
            for first, end in zip(at, [*at[1:], len(b)], strict=True):
                x = batch.column(4).slice(first, end - first).flatten().to_numpy(zero_copy_only=False).reshape(end - first, -1)
                if b[first] != block:
                    block, held = b[first], []
                if part[first] == 0:
                    held.append((ids[first:end], labels[first:end], x))
                    continue
                if not held:
                    continue
                held = [tuple(np.concatenate(h) for h in zip(*held, strict=True))]
                others, label, points = held[0]
                square = np.square(points).sum(1)
                for a in range(0, len(x), QUERIES):
                    q, own_ids = x[a : a + QUERIES], ids[first:end][a : a + QUERIES]
                    near = q @ points.T
                    near *= -2
                    near += square
                    near += np.square(q).sum(1)[:, None]
                    near[own_ids[:, None] == others] = np.inf
                    last = min(k, len(others)) - 1
                    # what the product leaves within its rounding of the k-th is compared anew, exactly
                    far = np.stack([np.partition(row, last)[last : last + 1] for row in near])
                    at, of = np.nonzero((near <= far + 1e-9 * (1 + square.max() + np.abs(np.where(np.isfinite(far), far, 0.0)))) & np.isfinite(near))
                    d = np.concatenate([np.empty(0), *(np.square(points[of[s : s + EXACT]] - q[at[s : s + EXACT]]).sum(1) for s in range(0, len(at), EXACT))])
                    order = np.lexsort((others[of], d, at))
                    at, of, d = at[order], of[order], d[order]
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    at, of, d = (v[place < k] for v in (at, of, d))
                    yield pa.RecordBatch.from_arrays([pa.array(own_ids[at]), pa.array(others[of]), pa.array(label[of]), pa.array(d)], ["id", "other", "label", "d"])

    found = own.unionByName(asked).repartition("block").sortWithinPartitions("block", "part").mapInArrow(search, "id long, other long, label double, d double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("_i", place).where(F.col("_i") <= k).groupBy(F.col("id").alias(id_col)).agg(F.avg("label").alias("p"))


def histogram_calibration(rows: DataFrame, fit: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """P replaced by the share of class 1 in its bin of fit (itself where the bin is empty)."""
    table = metrics.calibration(fit, y, p, bins).select(F.col("bin").alias("_bin"), F.col("share").alias("_share"))
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return rows.withColumn("_bin", b).join(F.broadcast(table), "_bin", "left").withColumn(p, F.coalesce("_share", p)).drop("_bin", "_share")  # at most bins rows


def _logit(p: str):
    safe = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    return F.ln(safe), F.ln(1 - safe)


def calibrated(rows: DataFrame, fit: DataFrame, method: str = "isotonic", y: str = "y", p: str = "p") -> DataFrame:
    """P recalibrated by isotonic, logistic (Platt), temperature, beta or histogram."""
    if method == "histogram":
        return histogram_calibration(rows, fit, y, p)
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="_f").fit(fit.select(F.col(p).alias("_f"), F.col(y).cast("double").alias("label")))
        return model.transform(rows.withColumn("_f", F.col(p))).withColumn(p, F.col("prediction")).drop("_f", "prediction")
    yes, no = _logit(p)
    parts = {"logistic": [yes - no], "temperature": [yes - no], "beta": [yes, -no]}[method]
    names = [f"_x{i}" for i in range(len(parts))]
    put = lambda d: VectorAssembler(inputCols=names, outputCol="features").transform(d.withColumns(dict(zip(names, parts, strict=True))))
    learner = LogisticRegression(fitIntercept=method != "temperature", maxIter=50)
    if method == "beta":
        from pyspark.ml.linalg import Matrices

        learner = learner.setLowerBoundsOnCoefficients(Matrices.dense(1, 2, [0.0, 0.0]))
    model = learner.fit(put(fit).withColumn("label", F.col(y).cast("double")))
    out = model.transform(put(rows)).withColumn(p, vector_to_array("probability")[1])
    return out.drop(*names, "features", "rawPrediction", "probability", "prediction")


def fit_and_test(rows: DataFrame, assignment: DataFrame, columns: str | Sequence[str], kind: str = "logistic", scaler: str = "standard", key: str = "SUBJECT_ID") -> DataFrame:
    """(split, roc_auc or the regression's metrics): imputed, scaled, fitted on train, judged on each split.

    Features are an array column, or a few columns that are made one: the plan doesn't grow with their number.
    """
    x = F.col(columns).cast("array<double>") if isinstance(columns, str) else F.array(*(F.col(f"`{c}`").cast("double") for c in columns))
    some = rows.join(assignment, key).select("split", "y", x.alias("_x"))
    state = scale.fit_arrays(some.where("split = 'train'"), "_x", scaler)
    ready = scale.scaled_arrays(some, "_x", state).select("split", F.col("y").cast("double").alias("label"), array_to_vector("_x").alias("features"))
    train = ready.where("split = 'train'")
    model = {"logistic": logistic, "linear": linear}[kind](train) if kind in ("logistic", "linear") else classifier(train, kind)
    told = predictions(model, ready)
    return metrics.regression(told, "label", "p", ["split"]) if kind == "linear" else metrics.roc_auc(told, "label", "p", ["split"])


def across_sources(rows: DataFrame, source: str, columns: str | Sequence[str], kind: str = "logistic", key: str = "SUBJECT_ID") -> DataFrame:
    """(source, split, roc_auc or the regression's metrics): a model for each source, fitted on its train subjects and judged on its other ones (own) and on all of the other sources (other).

    Every fifth subject, by a digest of its key, is not learned from. The sources' names, a few, come to the driver.
    """
    names = [r[source] for r in rows.select(source).where(F.col(source).isNotNull()).distinct().orderBy(source).collect()]
    out = None
    for name in names:
        split = F.when(F.col(source) != name, "other").when(codes.random_order(F.col(key)) % 5 == 0, "own").otherwise("train")
        told = fit_and_test(rows, rows.where(F.col(source).isNotNull()).select(key, split.alias("split")).distinct(), columns, kind, key=key).withColumn(source, F.lit(name))
        out = told if out is None else out.unionByName(told)
    if out is None:
        raise ValueError("there are no sources")
    return out
