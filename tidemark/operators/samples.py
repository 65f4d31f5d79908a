"""Batches of samples as tables, for training elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.functions.codes import random_order
from tidemark.functions.permutation import permuted
from tidemark.operators import scale, split
from tidemark.operators.running import prefix_sums
from tidemark.operators.timeseries import EPS, KEYS, padded, quoted


def stay_arrays(grid: DataFrame, values: Sequence[str], by: Sequence[str] = KEYS, order: str = "bins") -> DataFrame:
    """(by, x, n): a stay's rows of values as one array in order."""
    row = F.struct(F.col(order).cast("double").alias("o"), F.array(*(quoted(c).cast("float") for c in values)).alias("x"))
    rows = grid.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return rows.select(*by, F.transform("_r", lambda r: r["x"]).alias("x"), F.transform("_r", lambda r: r["o"]).alias("order"), F.size("_r").alias("n"))


def prefix_samples(grid: DataFrame, labels: DataFrame, values: Sequence[str], by: Sequence[str] = KEYS, order: str = "bins", closed: bool = True) -> DataFrame:
    """(by, t, x, n, y): a sample a label, its rows up to the label's time. Sliced from one array a stay."""
    own = stay_arrays(grid, values, by, order)
    upto = F.size(F.filter("order", lambda o: (o <= F.col("t")) if closed else (o < F.col("t") + EPS)))
    joined = labels.join(own, list(by)).withColumn("n", upto).where(F.col("n") > 0)
    return joined.select(*by, "t", F.slice("x", F.lit(1), F.col("n")).alias("x"), "n", "y")


def with_batch(samples: DataFrame, size: int, by: Sequence[str], seed: int = 42) -> DataFrame:
    """Samples with their batch, in a pseudo-random order; no more than size in each."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in by))
    ordered = samples.withColumn("_order", random_order(key, seed)).withColumn("_one", F.lit(1))
    placed = prefix_sums(ordered, [], "_order", ["_one"], list(by))
    return placed.withColumn("batch", F.floor((F.col("cum__one") - 1) / size)).drop("_order", "_one", "cum__one")


def epoch_batches(numbered: DataFrame, total: int, size: int, epoch: int, seed: int = 42) -> DataFrame:
    """Samples, numbered from 0 to total - 1, with their batch in an epoch; each epoch deals them out anew, without a sort."""
    return numbered.withColumn("batch", F.floor(permuted(F.col("number"), total, seed, F.lit(epoch)) / size))


def batches(samples: DataFrame, size: int, by: Sequence[str], width: int, seed: int = 42) -> DataFrame:
    """(batch, x, y, lengths): size samples, filled up with zero rows to the batch's longest."""
    placed = with_batch(samples, size, by, seed)
    longest = placed.groupBy("batch").agg(F.max("n").alias("_longest"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    full = placed.join(longest, "batch").withColumn("x", F.concat("x", F.array_repeat(zero, F.col("_longest") - F.col("n"))))
    rows = full.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(*by, "x", "y", "n"))).alias("_s"))
    return rows.select("batch", F.transform("_s", lambda s: s["x"]).alias("x"), F.transform("_s", lambda s: s["y"]).alias("y"), F.transform("_s", lambda s: s["n"]).alias("lengths"))


def exported(
    grid: DataFrame,
    labels: DataFrame,
    values: Sequence[str],
    by: Sequence[str] = KEYS,
    subject_ids: Sequence[int] | None = None,
    n_samples: int | None = None,
    binning: str = "none",
    one_hot: bool = False,
    deep_supervision: bool = False,
    cut: bool = False,
    imputer: DataFrame | None = None,
    scaler: DataFrame | None = None,
    key: str = "SUBJECT_ID",
) -> DataFrame:
    """The samples of a data set as arrays: (by, t, x, n, y), or (by, x, n, y, m) in deep supervision.

    Subjects are the given ones, or those with about n_samples samples together (of both, the ids win), or all. Labels
    are binned as hours of stay (none, custom or log), to a class or with one_hot to ten zeros and ones; y is an array.
    A sample is a label with the rows up to its time, or in deep supervision a stay with y and mask m of each row (labels
    between two rows are left out); with cut, what lies behind the stay's last label goes. Rows are imputed and scaled by fitted states before they
    become arrays. Arrays are ragged: `sources.tensors` pads them to one shape as it writes.
    """
    if binning not in BINNINGS:
        raise ValueError(f"unknown binning {binning}")
    if one_hot and binning == "none":
        raise ValueError("one_hot needs a binning")
    if subject_ids is not None:
        labels = labels.where(F.col(key).isin(*subject_ids)) if subject_ids else labels.limit(0)
    elif n_samples is not None:
        counts = (labels.select(*by).distinct() if deep_supervision else labels).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        labels = labels.join(split.subjects_for_samples(counts, n_samples, key=key), key, "left_semi")
    of = BINNINGS[binning]
    told = lambda y: codes.one_hot(of(y), 10) if one_hot else F.array(of(y).cast("double"))
    rows = grid.join(labels.select(*by).distinct(), list(by), "left_semi")
    rows = scale.impute(rows, imputer) if imputer is not None else rows
    rows = scale.scaled(rows, scaler) if scaler is not None else rows
    if not deep_supervision:
        return prefix_samples(rows, labels, values, by).withColumn("y", told(F.col("y")))
    y = labels.where(F.col("t") == F.floor("t")).select(*by, F.col("t").cast("int").alias("bins"), F.col("y").cast("double").alias("_y"))
    joined = rows.join(y, [*by, "bins"], "left")
    row = F.struct("bins", F.array(*(quoted(c).cast("float") for c in values)).alias("x"), "_y")
    stays = joined.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    if cut:
        stays = stays.withColumn("_end", F.array_max(F.transform(F.filter("_r", lambda r: r["_y"].isNotNull()), lambda r: r["bins"])))
        stays = stays.withColumn("_r", F.filter("_r", lambda r: r["bins"] <= F.col("_end"))).where(F.size("_r") > 0)
    known = lambda r: r["_y"].isNotNull()
    zero = F.array_repeat(F.lit(0.0), 10 if one_hot else 1)
    label = F.transform("_r", lambda r: F.when(known(r), told(r["_y"]).cast("array<double>")).otherwise(zero))
    return stays.select(*by, F.transform("_r", lambda r: r["x"]).alias("x"), F.size("_r").alias("n"), label.alias("y"), F.transform("_r", lambda r: known(r).cast("int")).alias("m"))


#: How labels that are hours of stay become classes.
BINNINGS = {"none": lambda y: y, "custom": codes.custom_bin, "log": codes.log_bin}


def batch_count(samples: DataFrame, size: int, least: int = 0) -> DataFrame:
    """Full batches of samples; at least 1 of stays for deep supervision."""
    return samples.agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) / size)).cast("long").alias("batches"))


__all__ = ["stay_arrays", "prefix_samples", "with_batch", "epoch_batches", "batches", "batch_count", "exported", "padded"]
