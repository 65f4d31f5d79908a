"""Time grids, imputation, windows before a label, and labels: windows over one stay at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import channels

KEYS = ("SUBJECT_ID", "ICUSTAY_ID")
#: Guards the edges of bins and windows against rounding.
EPS = 1e-6


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def bin_id(hours: Column, step: float = 1.0, start: Column | None = None) -> Column:
    """The bin of an hour; both bounds count to the earlier bin, cut toward zero."""
    return (((hours - start) if start is not None else hours) / step - EPS).cast("int")


def with_bins(series: DataFrame, step: float = 1.0, start_at_zero: bool = True, by: Sequence[str] = KEYS, time: str = "hours") -> DataFrame:
    start = None if start_at_zero else F.min(time).over(Window.partitionBy(*by))
    return series.withColumn("bins", bin_id(F.col(time), step, start))


def last_in_bin(series: DataFrame, values: Sequence[str], by: Sequence[str] = KEYS, time: str = "hours") -> DataFrame:
    """The last known value of each channel in each bin (of two at one time, the larger)."""
    last = [F.max_by(quoted(c), F.when(quoted(c).isNotNull(), F.struct(time, quoted(c)))).alias(c) for c in values]
    return series.groupBy(*by, "bins").agg(*last)


def dense_grid(binned: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """All bins from 0 to the stay's last; those without events are null."""
    grid = binned.groupBy(*by).agg(F.max("bins").alias("_last")).where("_last >= 0").select(*by, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("bins"))
    return grid.join(binned, [*by, "bins"], "left")


def imputed(grid: DataFrame, normal: Mapping[str, object], strategy: str = "previous", by: Sequence[str] = KEYS, order: str = "bins") -> DataFrame:
    """Fills nulls of the columns of normal: from the previous or next bin and then the normal value, with the normal value, or with zero."""
    back = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fill = {
        "previous": lambda c: F.last(c, ignorenulls=True).over(back),
        "next": lambda c: F.first(c, ignorenulls=True).over(ahead),
        "normal": lambda c: c,
        "zero": lambda c: c,
    }
    if strategy not in fill:
        raise ValueError(f"unknown strategy {strategy}")
    value = lambda c: F.lit(0 if strategy == "zero" else normal[c]).cast(grid.schema[c].dataType)
    return grid.select(*(F.coalesce(fill[strategy](quoted(c)), value(c)).alias(c) if c in normal else quoted(c) for c in grid.columns))


def one_hot(series: DataFrame, categories: Mapping[str, Sequence[str]] = channels.CATEGORIES) -> DataFrame:
    """A 0/1 column 'channel->category' for each category; unknown text is all 0, null all null. Other columns stay."""
    cols = []
    for c in series.columns:
        if c in categories:
            cols += [F.when(quoted(c).isNotNull(), (quoted(c) == v).cast("float")).alias(f"{c}->{v}") for v in categories[c]]
        else:
            cols.append(quoted(c))
    return series.select(*cols)


def normal_values(categories: Mapping[str, Sequence[str]] = channels.CATEGORIES, normal: Mapping[str, str] = channels.NORMAL) -> dict[str, float]:
    """The normal value of each discretized column: 1 for the normal category."""
    out: dict[str, float] = {}
    for c, v in normal.items():
        if c in categories:
            out |= {f"{c}->{x}": float(x == v) for x in categories[c]}
        else:
            out[c] = float(v)
    return out


def discretize(series: DataFrame, step: float = 1.0, strategy: str = "previous", start_at_zero: bool = True, categories: Mapping[str, Sequence[str]] = channels.CATEGORIES, normal: Mapping[str, str] = channels.NORMAL, by: Sequence[str] = KEYS, time: str = "hours") -> DataFrame:
    """One-hot, bins, imputation, in this order: by, bins, and a float column for each number and category (59 by default)."""
    numbers = [c for c in normal if c not in categories]
    typed = series.select(*by, F.col(time), *(quoted(c).try_cast("float").alias(c) if c in numbers else quoted(c).cast("string").alias(c) for c in normal))
    hot = one_hot(typed, categories)
    values = [c for c in hot.columns if c not in (*by, time)]
    binned = last_in_bin(with_bins(hot, step, start_at_zero, by, time), values, by, time)
    filled = imputed(dense_grid(binned, by), normal_values(categories, normal), strategy, by)
    return filled.select(*by, "bins", *(quoted(c).cast("float").alias(c) for c in values))


def deep_supervision(grid: DataFrame, labels: DataFrame, by: Sequence[str] = KEYS, time: str = "t", label: str = "y") -> DataFrame:
    """By, bins, y (0 where none) and mask (whether there is a label), for every bin of the grid."""
    y = labels.select(*by, F.col(time).cast("int").alias("bins"), F.col(label).cast("double").alias("_y"))
    joined = grid.select(*by, "bins").join(y, [*by, "bins"], "left")
    return joined.select(*by, "bins", F.coalesce("_y", F.lit(0.0)).alias("y"), F.col("_y").isNotNull().alias("mask"))


def target_replication(grid: DataFrame, labels: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """A stay's label at each of its steps."""
    return grid.join(labels.select(*by, "y"), list(by))


def replication_weights(grid: DataFrame, coef: float, by: Sequence[str] = KEYS) -> DataFrame:
    """Weight coef for all steps but a stay's last, which has 1."""
    last = F.max("bins").over(Window.partitionBy(*by))
    return grid.withColumn("weight", F.when(F.col("bins") < last, F.lit(coef)).otherwise(F.lit(1.0)))


def label_times(end: Column, rate: float = 1.0) -> Column:
    """The array of times 0, rate, 2 rate ... up to end; null where end is null or negative."""
    return F.when(end >= 0, F.transform(F.sequence(F.lit(0), F.floor((end + EPS) / rate).cast("int")), lambda i: i * F.lit(rate)))


def label_grid(stays: DataFrame, end: Column, start: float, by: Sequence[str] = KEYS, rate: float = 1.0) -> DataFrame:
    """Times 0, rate, 2 rate ... up to end that lie after start. Stays with a null or negative end have none."""
    return stays.withColumn("_end", end).where(F.col("_end") >= 0).withColumn("t", F.explode(label_times(F.col("_end"), rate))).where(F.col("t") > start).drop("_end")


def prefix_rows(series: DataFrame, labels: DataFrame, by: Sequence[str] = KEYS, time: str = "hours", t: str = "t", closed: bool = False) -> DataFrame:
    """J13 (hour < t + EPS), or J14 if closed (hour <= t): the rows before each label. Grows with the square of a stay; see features."""
    fits = F.col(time) <= F.col(t) if closed else F.col(time) < F.col(t) + EPS
    return labels.join(series, list(by)).where(fits)


def rows_at(series: DataFrame, labels: DataFrame, by: Sequence[str] = KEYS, time: str = "hours", t: str = "t") -> DataFrame:
    """The row at exactly a label's time."""
    return labels.join(series.withColumnRenamed(time, t), [*by, t])


def within_stay(series: DataFrame, end: Column, time: str = "hours") -> DataFrame:
    return series.where((F.col(time) > -EPS) & (F.col(time) < end + EPS))


def padded(arrays: Column, length: Column | int, zero: object = 0.0) -> Column:
    """An array filled up with zeros to a length."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(arrays, F.array_repeat(F.lit(zero), F.greatest(F.lit(0), n - F.size(arrays))))


def cut_to_shortest(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays of a row cut to the shortest of them."""
    n = F.least(*(F.size(c) for c in columns)) if len(columns) > 1 else F.size(columns[0])
    return frame.withColumns({c: F.slice(c, F.lit(1), n) for c in columns})
