"""Samples and labels of the prediction tasks: (X, y) frames keyed by stay."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.operators.timeseries import EPS, KEYS, label_grid, label_times, within_stay

# Hours.
IHM_HOURS, LABEL_START, HORIZON = 48.0, 4.0, 24.0


@dataclass
class Task:
    x: DataFrame
    y: DataFrame


def _with_los(series: DataFrame, episodic: DataFrame, by: Sequence[str]) -> DataFrame:
    """The series of stays whose mortality is known, cut to the stay."""
    los = episodic.where(F.col("MORTALITY").isNotNull()).select(*by, (F.col("LOS") * 24).alias("_los"))
    return within_stay(series.join(los, list(by)), F.col("_los"))


def in_hospital_mortality(series: DataFrame, episodic: DataFrame, by: Sequence[str] = KEYS) -> Task:
    """The first 48 hours of stays that last as long; the label stands at the last row kept."""
    long = episodic.where((F.col("LOS") * 24 >= IHM_HOURS) & F.col("MORTALITY").isNotNull()).select(*by, "MORTALITY")
    early = series.where((F.col("hours") > -EPS) & (F.col("hours") < IHM_HOURS + EPS))
    x = early.join(long.select(*by), list(by), "left_semi")
    y = early.groupBy(*by).agg(F.max("hours").alias("t")).join(long, list(by)).select(*by, "t", F.col("MORTALITY").cast("double").alias("y"))
    return Task(x, y)


def _stays(series: DataFrame, episodic: DataFrame, by: Sequence[str]) -> DataFrame:
    """The stays that _with_los() leaves rows of, and the first of these: rows are counted up by stay before the join, as one lies within the stay if the first does."""
    first = series.where(F.col("hours") > -EPS).groupBy(*by).agg(F.min("hours").alias("_first"))
    own = episodic.where(F.col("MORTALITY").isNotNull()).select(*by, (F.col("LOS") * 24).alias("_los"), "MORTALITY")
    return own.join(first, list(by)).where(F.col("_first") < F.col("_los") + EPS)


def lived_hours(stays: DataFrame) -> Column:
    return F.coalesce(codes.hours_between(F.col("INTIME"), F.col("DEATHTIME")), F.lit(1e18))


def _dies_soon(t: Column) -> Column:
    return F.when(F.col("MORTALITY") == 1, (F.col("_lived") - t < HORIZON).cast("double")).otherwise(0.0)


def _labelled(x: DataFrame, y: DataFrame, by: Sequence[str]) -> Task:
    """P14 for labels that were made from the stays of x: only rows without a label go, and labels are neither shuffled nor sorted."""
    return Task(x.drop("_los").join(y.select(*by).distinct(), list(by), "left_semi"), y)


def decompensation(series: DataFrame, episodic: DataFrame, stays: DataFrame, by: Sequence[str] = KEYS, start: float = LABEL_START, after_first: bool = True) -> Task:
    """Hourly, whether death comes within 24 hours."""
    x = _with_los(series, episodic, by)
    lived = stays.select(*by, lived_hours(stays).alias("_lived"))
    grid = label_grid(_stays(series, episodic, by).join(lived, list(by)), F.least("_los", "_lived"), start, by)
    grid = grid.where(F.col("t") > F.col("_first")) if after_first else grid
    return _labelled(x, grid.select(*by, "t", _dies_soon(F.col("t")).alias("y")), by)


def length_of_stay(series: DataFrame, episodic: DataFrame, by: Sequence[str] = KEYS, start: float = LABEL_START, after_first: bool = True) -> Task:
    """Hourly, the hours that remain."""
    x = _with_los(series, episodic, by)
    grid = label_grid(_stays(series, episodic, by), F.col("_los"), start, by)
    grid = grid.where(F.col("t") >= F.col("_first")) if after_first else grid
    return _labelled(x, grid.select(*by, "t", (F.col("_los") - F.col("t")).alias("y")), by)


def phenotype_labels(diagnoses: DataFrame, groups: Sequence[str], by: Sequence[str] = KEYS) -> DataFrame:
    """An array of 0/1 for each benchmark phenotype, in the order of the names."""
    own = lambda g: F.max(F.when((F.col("USE_IN_BENCHMARK") == 1) & (F.col("HCUP_CCS_2015") == g), 1).otherwise(0))
    names = sorted(groups)
    flags = diagnoses.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *(own(g).alias(f"_{i}") for i, g in enumerate(names)))
    return flags.select(*by, F.array(*(F.col(f"_{i}") for i in range(len(names)))).cast("array<int>").alias("y"))


def phenotyping(series: DataFrame, episodic: DataFrame, diagnoses: DataFrame, groups: Sequence[str], by: Sequence[str] = KEYS) -> Task:
    """T4: one label row at the stay's end."""
    x = _with_los(series, episodic, by)
    y = phenotype_labels(diagnoses, groups, by).join(episodic.select(*by, (F.col("LOS") * 24).alias("t")), list(by)).select(*by, "t", "y")
    y = y.join(_stays(series, episodic, by).select(*by), list(by), "left_semi")
    return Task(x.drop("_los").join(y.select(*by).distinct(), list(by), "left_semi"), y)  # P14: stays without a label or without rows go


def multitask(series: DataFrame, episodic: DataFrame, stays: DataFrame, diagnoses: DataFrame, groups: Sequence[str], by: Sequence[str] = KEYS) -> Task:
    """T5: all labels of a stay in one row; hourly ones on a grid from 0, with a mask of those after LABEL_START."""
    pheno = phenotyping(series, episodic, diagnoses, groups, by)
    base = pheno.y.select(*by, F.col("t").alias("LOS_value"), F.col("y").alias("PHENO_labels")).join(episodic.select(*by, F.col("MORTALITY").cast("double").alias("_m")), list(by))
    ihm = in_hospital_mortality(series, episodic, by).y.select(*by, F.col("y").alias("_ihm"))

    def listed(name: str, end: Column, y: Callable[[Column], Column]) -> list[Column]:
        times = label_times(end)
        made = F.transform(times, lambda t: (t > LABEL_START).cast("double")), F.transform(times, y)
        return [F.coalesce(m, none).alias(f"{name}_{n}") for n, m in zip(("masks", "labels"), made, strict=True)]

    # A stay's hourly labels are made as arrays, so that there is never a row a label, and after the last join, so that none is sorted or kept.
    hourly = _stays(series, episodic, by).drop("_first").join(stays.select(*by, lived_hours(stays).alias("_lived")), list(by), "left")
    none = F.array_repeat(F.lit(0.0), int(LABEL_START) + 1)
    out = base.join(ihm, list(by), "left").join(hourly, list(by), "left")
    y = out.select(
        *by,
        F.when(F.col("_ihm").isNull(), 0).otherwise(47).alias("IHM_pos"),
        F.col("_ihm").isNotNull().cast("int").alias("IHM_mask"),
        F.coalesce("_ihm", "_m").alias("IHM_label"),
        *listed("DECOMP", F.when(F.col("_lived").isNotNull(), F.least("_los", "_lived")), _dies_soon),
        *listed("LOS", F.col("_los"), lambda t: F.col("_los") - t),
        "LOS_value",
        "PHENO_labels",
    )
    return Task(pheno.x, y)


TASKS: dict[str, Callable[..., Task]] = {
    "IHM": lambda series, episodic, stays, diagnoses, groups, by: in_hospital_mortality(series, episodic, by),
    "DECOMP": lambda series, episodic, stays, diagnoses, groups, by: decompensation(series, episodic, stays, by),
    "LOS": lambda series, episodic, stays, diagnoses, groups, by: length_of_stay(series, episodic, by),
    "PHENO": lambda series, episodic, stays, diagnoses, groups, by: phenotyping(series, episodic, diagnoses, groups, by),
    "MULTI": multitask,
}


def task_set(task: str, series: DataFrame, episodic: DataFrame, stays: DataFrame, diagnoses: DataFrame, groups: Sequence[str], by: Sequence[str] = KEYS) -> Task:
    """T6."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}; there are {', '.join(TASKS)}")
    return TASKS[task](series, episodic, stays, diagnoses, groups, by)


def sample_counts(y: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """A10: samples of each stay, each subject (stay null), and in all (both null)."""
    return y.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def sample_shares(counts: DataFrame, key: str = "SUBJECT_ID", n: str = "n") -> DataFrame:
    """Each subject's share of the samples."""
    each = counts.groupBy(key).agg(F.sum(n).alias("n"))
    total = counts.agg(F.sum(n).alias("_total"))  # one row
    return each.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("_total")).alias("ratio"))
