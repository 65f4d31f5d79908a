"""Descriptive statistics of features and of event logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.timeseries import quoted


def rows_by_source(events: DataFrame, source: str = "source") -> DataFrame:
    """A14."""
    return events.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def times_by_source(events: DataFrame, source: str = "source", time: str = "CHARTTIME", by: Sequence[str] = ()) -> DataFrame:
    """Distinct times of each source (of each of by, too)."""
    return events.groupBy(source, *by).agg(F.count_distinct(time).alias("n"))


def pair_sums(rows: DataFrame, columns: Sequence[str], shift: Sequence[float] | None = None) -> DataFrame:
    """(place, sums) for each column: over all others, one after the other, known pairs n, sums of x, of y, of x squared, of y squared and of xy, x being the column's values less its shift.

    A task multiplies blocks of rows with each other as matrices, known values as ones beside them, and gives a row a
    column; these are added up over the tasks, those of a task's partition first. It is one pass however many columns.
    """
    d = len(columns)
    off = np.zeros(d) if shift is None else np.asarray(shift, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        seen = False
        for batch in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns], 1)
            known = ~np.isnan(x)
            x, k = np.where(known, x - off, 0.0), known.astype(float)
            xk, sk = x.T @ k, (x * x).T @ k
            total += np.stack([k.T @ k, xk, xk.T, sk, sk.T, x.T @ x])
            seen = True
        if seen:
            by_column = np.ascontiguousarray(total.transpose(1, 0, 2)).reshape(d, 6 * d)
            for a in range(0, d, 64):
                part = by_column[a : a + 64]
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * 6 * d, pa.array(part.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), lists], ["place", "sums"])

    parts = rows.select(*(quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, "place int, sums array<double>")
    return parts.groupBy("place").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, over the rows that know both (neither null nor NaN); null where one of them does not vary.

    Values are shifted by the means of some first rows: the result is the same, but large means cost no digits.
    """
    d = len(columns)
    known = lambda c: F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double"))
    first = rows.limit(1000).agg(*(F.avg(known(c)).alias(f"c{i}") for i, c in enumerate(columns))).first()
    sums = pair_sums(rows, columns, [x or 0.0 for x in first])
    names = F.array(*map(F.lit, columns))
    at = lambda k, j: F.get("sums", k * d + j)

    def pair(j):
        n, x, y, xx, yy, xy = (at(k, j) for k in range(6))
        vx, vy = n * xx - x * x, n * yy - y * y
        flat = (vx <= 1e-12 * n * xx) | (vy <= 1e-12 * n * yy)
        return F.struct(F.get(names, j).alias("b"), F.when(F.col("place") == j, F.when(~flat, F.lit(1.0))).when(~flat, (n * xy - x * y) / F.sqrt(vx * vy)).alias("r"))

    told = sums.select("place", F.get(names, F.col("place")).alias("a"), F.inline(F.transform(F.sequence(F.col("place"), F.lit(d - 1)), pair)))
    return told.select("a", "b", "r")


def histogram(rows: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(name, bin, n), bins of equal width from the least to the largest value; the last one is closed."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in columns)))
    long = rows.select(each.alias("x")).select("x.*").where(F.col("v").isNotNull())
    span = long.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.coalesce(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)), F.lit(0)).cast("int")
    return long.join(F.broadcast(span), "name").groupBy("name", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # a row for each column


def autocorrelation(series: DataFrame, value: str, by: Sequence[str], order: str, max_lag: int = 100) -> DataFrame:
    """(by, lag, r): sum of x times x lagged, over the sum of squares (not centred)."""
    w, v = Window.partitionBy(*by).orderBy(order), F.col("v")
    known = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("v"))
    products = known.select(*by, (v * v).alias("_q"), *((v * F.lag(v, i).over(w)).alias(f"_{i}") for i in range(1, max_lag + 1)))
    sums = products.groupBy(*by).agg(F.sum("_q").alias("_q"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(1, max_lag + 1)))
    each = sums.select(*by, "_q", F.posexplode(F.array("_q", *(f"_{i}" for i in range(1, max_lag + 1)))).alias("lag", "_s"))
    return each.where(F.col("_s").isNotNull()).select(*by, "lag", (F.col("_s") / F.nullif(F.col("_q"), F.lit(0.0))).alias("r"))


def running_mean(series: DataFrame, value: str, by: Sequence[str], order: str) -> DataFrame:
    """A18."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn("running_mean", F.avg(value).over(w))


def column_kinds(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, all_null, numeric), numeric if every known value is a number."""
    one = rows.agg(*(F.struct(F.lit(c).alias("name"), (F.count(quoted(c)) == 0).alias("all_null"), (F.count(quoted(c).cast("string").try_cast("double")) == F.count(quoted(c))).alias("numeric")).alias(f"_{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(columns))))).alias("x")).select("x.*")
