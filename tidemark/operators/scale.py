"""Imputers and scalers: a fit is one aggregate row, a transform joins it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.running import prefix_sums
from tidemark.operators.timeseries import quoted

STRATEGIES = ("mean", "median", "most_frequent", "constant")


def _one_row(rows: DataFrame, columns: Sequence[str], of) -> DataFrame:
    return rows.agg(*(of(quoted(c)).alias(c) for c in columns))


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(name, q): each column's exact quantiles, between two values as far along as the share is; q is null without known values.

    Values are counted over the cluster and ranked by running sums, so no task holds a column's values.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in columns)))
    counts = rows.select(each.alias("x")).select("x.*").where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, ["name"], "v", ["n"])
    total = counts.groupBy("name").agg(F.sum("n").alias("_all"))
    at = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    met = lambda place: F.min(F.when(F.col("cum_n") > place, F.col("v")))
    low, high = ([met(of(a)) for a in at] for of in (F.floor, F.ceil))
    found = ranked.join(total, "name").groupBy("name").agg(F.array(*low).alias("_l"), F.array(*high).alias("_h"), F.max("_all").alias("_all"))
    part = lambda l, i: l + (F.get("_h", i) - l) * (F.get(F.array(*at), i) - F.floor(F.get(F.array(*at), i)))
    return found.select("name", F.transform("_l", part).alias("q"))


def _in_a_row(rows: DataFrame, columns: Sequence[str], of) -> DataFrame:
    """One row of a (name, ...) table, with of(name's value) for each column; of gets an aggregate that picks a name's value of a column."""
    pick = lambda c: lambda v: F.max_by(v, F.when(F.col("name") == c, F.lit(1)))
    return rows.agg(*(of(pick(c)).alias(c) for c in columns))


def _modes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value of each column, of equally frequent ones the least; values are counted over the cluster."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in columns)))
    counts = rows.select(each.alias("x")).select("x.*").where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.max_by("v", F.when(F.col("name") == c, F.struct("n", -F.col("v"))))
    return counts.agg(*(of(c).cast(rows.schema[c].dataType).alias(c) for c in columns))


def fit_imputer(rows: DataFrame, columns: Sequence[str], strategy: str = "mean", constant: float = 0.0, accuracy: int | None = None) -> DataFrame:
    """One row with each column's fill value, over known values. With accuracy the median comes from a sketch, of a rank error of 1 / accuracy, in one pass."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "most_frequent":
        return _modes(rows, columns)
    if strategy == "median" and accuracy is None:
        return _in_a_row(quantiles(rows, columns, [0.5]), columns, lambda pick: pick(F.get("q", F.lit(0))))
    of = {"mean": F.avg, "median": lambda c: F.percentile_approx(c, 0.5, accuracy), "constant": lambda c: F.first(F.lit(float(constant)))}[strategy]
    return _one_row(rows, columns, of)


def impute(rows: DataFrame, state: DataFrame) -> DataFrame:
    filled = state.columns
    s = state.select(*(quoted(c).alias(f"_f{i}") for i, c in enumerate(filled)))
    joined = rows.crossJoin(F.broadcast(s))  # of one row
    return joined.select(*(F.coalesce(quoted(c), F.col(f"_f{filled.index(c)}")).alias(c) if c in filled else quoted(c) for c in rows.columns))


SCALERS: dict[str, tuple] = {
    # centre and scale of a column, from its values
    "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
    "standard": (F.avg, F.stddev_pop),
    "maxabs": (lambda c: F.first(F.lit(0.0)), lambda c: F.max(F.abs(c))),
}


def _robust(accuracy: int) -> tuple:
    of = lambda c, share: F.percentile_approx(c, share, accuracy)
    return lambda c: of(c, 0.5), lambda c: of(c, 0.75) - of(c, 0.25)


def _by_quartiles(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The robust scaler of (name, q), q being the quartiles."""
    q = lambda i: F.get("q", F.lit(i))
    one = F.when(q(2) == q(0), 1.0).otherwise(q(2) - q(0))
    empty = F.struct(F.lit(None).cast("double").alias("centre"), F.lit(None).cast("double").alias("scale"))
    return _in_a_row(rows, columns, lambda pick: F.coalesce(pick(F.struct(q(1).alias("centre"), one.alias("scale"))), empty))


def fit_scaler(rows: DataFrame, columns: Sequence[str], kind: str = "minmax", accuracy: int | None = None) -> DataFrame:
    """One row (centre, scale) for each column, as structs; a scale of 0 is 1. accuracy as for the imputer, for robust."""
    if kind not in (*SCALERS, "robust"):
        raise ValueError(f"unknown scaler {kind}")
    if kind == "robust" and accuracy is None:
        return _by_quartiles(quantiles(rows, columns, [0.25, 0.5, 0.75]), columns)
    centre, scale = SCALERS[kind] if kind in SCALERS else _robust(accuracy)
    state = rows.agg(*(F.struct(centre(quoted(c)).cast("double").alias("centre"), scale(quoted(c)).cast("double").alias("scale")).alias(c) for c in columns))
    one = lambda c: F.when(quoted(c)["scale"] == 0, 1.0).otherwise(quoted(c)["scale"])
    return state.select(*(F.struct(quoted(c)["centre"].alias("centre"), one(c).alias("scale")).alias(c) for c in columns))


def scaled(rows: DataFrame, state: DataFrame, clip: tuple[float, float] | None = None) -> DataFrame:
    names = state.columns
    s = state.select(*(quoted(c).alias(f"_s{i}") for i, c in enumerate(names)))

    def put(c: str) -> Column:
        own = F.col(f"_s{names.index(c)}")
        v = (quoted(c) - own["centre"]) / own["scale"]
        return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), v)) if clip else v

    joined = rows.crossJoin(F.broadcast(s))  # of one row
    return joined.select(*(put(c).alias(c) if c in names else quoted(c) for c in rows.columns))


def fit_on_train(rows: DataFrame, assignment: DataFrame, columns: Sequence[str], kind: str = "minmax", strategy: str = "mean", key: str = "SUBJECT_ID") -> tuple[DataFrame, DataFrame]:
    """(imputer, scaler) of the train subjects; the scaler is fitted on imputed rows."""
    train = rows.join(assignment.where("split = 'train'"), key, "left_semi")
    imputer = fit_imputer(train, columns, strategy)
    return imputer, fit_scaler(impute(train, imputer), columns, kind)


def fit_arrays(train: DataFrame, features: str, kind: str = "standard") -> tuple[list[float], list[float], list[float]]:
    """E6, E8 for an array column, however long: what fills a place (its mean), and its centre and scale, standard, minmax or maxabs.

    Two passes over the rows, each one aggregate of vectors: the plan doesn't grow with the features. A number a
    feature and statistic comes to the driver. A place that no row knows is filled with 0.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind}")
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    x = F.col(features).cast("array<double>")
    value = array_to_vector(F.transform(x, lambda v: F.when(known(v), v).otherwise(0.0)))
    told = train.agg(Summarizer.sum(value).alias("s"), Summarizer.sum(array_to_vector(F.transform(x, lambda v: known(v).cast("double")))).alias("n")).select(vector_to_array("s").alias("s"), vector_to_array("n").alias("n")).first()
    fill = [s / n if n else 0.0 for s, n in zip(told["s"], told["n"], strict=True)]
    some = train.select(array_to_vector(_filled(x, fill)).alias("x")).agg(Summarizer.metrics("mean", "std", "min", "max", "count").summary(F.col("x")).alias("m"))
    m = some.select(*(vector_to_array(f"m.{c}").alias(c) for c in ("mean", "std", "min", "max")), F.col("m.count").alias("n")).first()
    all_ = {
        "standard": lambda: (m["mean"], [s * math.sqrt((m["n"] - 1) / m["n"]) for s in m["std"]]),
        "minmax": lambda: (m["min"], [b - a for a, b in zip(m["min"], m["max"], strict=True)]),
        "maxabs": lambda: ([0.0] * len(fill), [max(abs(a), abs(b)) for a, b in zip(m["min"], m["max"], strict=True)]),
    }
    centre, size = all_[kind]()
    return fill, list(centre), [s or 1.0 for s in size]


def _filled(x: Column, fill: Sequence[float]) -> Column:
    values = F.array(*map(F.lit, fill))
    return F.transform(x, lambda v, i: F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.get(values, i)))


def scaled_arrays(rows: DataFrame, features: str, state: tuple[Sequence[float], Sequence[float], Sequence[float]]) -> DataFrame:
    """rows with the array column filled and scaled as fit_arrays() told."""
    fill, centre, size = state
    middle, length = F.array(*map(F.lit, centre)), F.array(*map(F.lit, size))
    return rows.withColumn(features, F.transform(_filled(F.col(features).cast("array<double>"), fill), lambda v, i: (v - F.get(middle, i)) / F.get(length, i)))


def transform(rows: DataFrame, imputer: DataFrame, scaler: DataFrame, clip: tuple[float, float] | None = None) -> DataFrame:
    return scaled(impute(rows, imputer), scaler, clip)


def save(state: DataFrame, path: str) -> None:
    """E7."""
    state.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def moments_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, n, s, q, lo, hi), a row a column: what adds up over batches."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in columns)))
    v = F.col("v")
    return rows.select(each.alias("x")).select("x.*").groupBy("name").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def merged_moments(*states: DataFrame) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("name").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def from_moments(state: DataFrame) -> DataFrame:
    """(name, mean, std, lo, hi) of merged states: the exact pooled values."""
    mean = F.col("s") / F.nullif(F.col("n"), F.lit(0))
    return state.select("name", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.nullif(F.col("n"), F.lit(0)) - mean * mean)).alias("std"), "lo", "hi")


#: Size of a quantile sketch; see rank_error().
SKETCH = 2000


def rank_error(k: int = SKETCH) -> float:
    """How far the rank of a told quantile is off at most, as a share of the values, in 99 of 100 cases: that of a KLL sketch of size k, merged or not."""
    return 2.446 / k**0.9433


def sketches_of(rows: DataFrame, columns: Sequence[str], k: int = SKETCH) -> DataFrame:
    """(name, n, sketch), a row a column: what is known of its quantiles, in some 10 k bytes however many values there are."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("v")) for c in columns)))
    known = rows.select(each.alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return known.groupBy("name").agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def merged_sketches(*states: DataFrame, k: int = SKETCH) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("name").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_quantiles(state: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(name, n, q) of merged states."""
    return state.select("name", "n", F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares)).alias("q"))


def imputer_of(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The median imputer of merged sketches, as fit_imputer() gives it."""
    return _in_a_row(sketched_quantiles(state, [0.5]), columns, lambda pick: pick(F.get("q", F.lit(0))))


def scaler_of(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The robust scaler of merged sketches, as fit_scaler() gives it."""
    return _by_quartiles(sketched_quantiles(state, [0.25, 0.5, 0.75]), columns)
