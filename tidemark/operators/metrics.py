"""Metrics of predictions, each an aggregate over groups (by: a split, a run, a window, or nothing)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.operators.running import prefix_sums


def masked(rows: DataFrame, mask: str | None) -> DataFrame:
    return rows.where(F.col(mask)) if mask else rows


def confusion(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """M1: (by, y, p, n)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(n.cast("double").alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def binary(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """M2: accuracy, precision, recall and F1 of class 1."""
    hit = lambda a, b: F.sum(((F.col(y) == a) & (F.col(p) == b)).cast("double"))
    n = rows.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select(*by, _div(tp + tn, tp + fp + fn + tn).alias("accuracy"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def report(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """M3: a row a class with precision, recall, f1, support, and rows for the micro, macro and weighted means."""
    each = F.explode(F.array(F.struct(F.col("y").cast("string").alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("told"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0).alias("tp")), F.struct(F.col("p").cast("string").alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("told"), F.lit(0.0).alias("tp"))))
    sums = confusion(rows, y, p, by).select(*by, each.alias("x")).select(*by, "x.*").groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("support", "told", "tp")))
    own = sums.select(*by, "class", _div(F.col("tp"), F.col("told")).alias("precision"), _div(F.col("tp"), F.col("support")).alias("recall"), _div(2 * F.col("tp"), F.col("told") + F.col("support")).alias("f1"), "support", "told", "tp")
    w = F.col("support")
    macro = own.groupBy(*by).agg(F.lit("macro").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum(w).alias("support"))
    weighted = own.groupBy(*by).agg(F.lit("weighted").alias("class"), *(_div(F.sum(F.col(c) * w), F.sum(w)).alias(c) for c in ("precision", "recall", "f1")), F.sum(w).alias("support"))
    micro = own.groupBy(*by).agg(F.lit("micro").alias("class"), _div(F.sum("tp"), F.sum("told")).alias("precision"), _div(F.sum("tp"), F.sum(w)).alias("recall"), _div(2 * F.sum("tp"), F.sum("told") + F.sum(w)).alias("f1"), F.sum(w).alias("support"))
    return own.drop("told", "tp").unionByName(micro).unionByName(macro).unionByName(weighted)


def kappa(rows: DataFrame, y: str, p: str, weights: str | None = None, by: Sequence[str] = (), mask: str | None = None) -> DataFrame:
    """M4, M5: (by, kappa), classes as numbers; weights none, linear or quadratic; 0 where nothing is expected to differ."""
    n = confusion(masked(rows, mask), y, p, by)
    names = list(by) or ["_all"]
    n = n if by else n.withColumn("_all", F.lit(1))
    d = F.abs(F.col("y").cast("double") - F.col("p").cast("double"))
    w = {None: (d > 0).cast("double"), "linear": d, "quadratic": d * d}[weights]
    seen = n.groupBy(*names).agg(F.sum(w * F.col("n")).alias("_o"), F.sum("n").alias("_n"))
    rows_, cols = n.groupBy(*names, "y").agg(F.sum("n").alias("_r")), n.groupBy(*names, "p").agg(F.sum("n").alias("_c"))
    expected = rows_.join(cols, names).groupBy(*names).agg(F.sum(w * F.col("_r") * F.col("_c")).alias("_e"))  # classes x classes of a group
    out = seen.join(expected, names)
    return out.select(*by, F.when(F.col("_e") == 0, 0.0).otherwise(1 - F.col("_o") * F.col("_n") / F.col("_e")).alias("kappa"))


def scores(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, p, pos, neg): the distinct scores with how many of either label."""
    w = F.col(weight) if weight else F.lit(1.0)
    known = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return known.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("neg"))


def roc_auc(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """M6: (by, roc_auc), exact, ties by half; null where a label is missing."""
    s = prefix_sums(scores(rows, y, p, by, weight), by, "p", ["neg"])
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return s.groupBy(*by).agg((area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"))


def curve_points(rows: DataFrame, y: str, p: str, cuts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, points, pos, neg): for each of the ascending cuts a struct (cut, tp, fp) of what lies strictly above it.

    A score is put between two cuts by binary search, and rows are counted by that: a group has one more counts than
    cuts at most, and these are added up from the top.
    """
    n = len(cuts)
    given = F.array(*(F.lit(float(c)) for c in cuts))
    halves = F.array(*(F.lit(1 << k) for k in range(max(n, 1).bit_length() - 1, -1, -1)))
    score = F.col(p).cast("double")
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(given, at + step - 1) < score), at + step).otherwise(at))
    known = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    cells = known.groupBy(*by, below.alias("_below")).agg(F.sum((F.col(y) == 1).cast("double")).alias("pos"), F.sum((F.col(y) != 1).cast("double")).alias("neg"))
    own = cells.groupBy(*by).agg(F.collect_list(F.struct("_below", "pos", "neg")).alias("_c"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = lambda name, i: F.aggregate(F.filter("_c", lambda c: c["_below"] > i), F.lit(0.0), lambda a, c: a + c[name])
    points = F.transform(given, lambda cut, i: F.struct(cut.alias("cut"), above("pos", i).alias("tp"), above("neg", i).alias("fp")))
    return own.where("_c IS NOT NULL AND size(_c) > 0").select(*by, points.alias("points"), "pos", "neg")


def curve(rows: DataFrame, y: str, p: str, cuts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, cut, tp, fp, pos, neg): the same, a row a cut."""
    return curve_points(rows, y, p, cuts, by).select(*by, "pos", "neg", F.inline("points")).select(*by, "cut", "tp", "fp", "pos", "neg")


def cuts(n: int) -> list[float]:
    """n cuts from 0 to 1, the ends widened by 1e-7."""
    out = [i / (n - 1) for i in range(n)]
    return [out[0] - 1e-7, *out[1:-1], out[-1] + 1e-7]


def _trapezoid(points: DataFrame, x: Callable[[Column], Column], height: Callable[[Column], Column], name: str, by: Sequence[str]) -> DataFrame:
    at = F.transform("points", lambda q: F.struct(x(q).alias("x"), height(q).alias("h")))
    steps = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: (F.get("_p", i - 1)["x"] - F.get("_p", i)["x"]) * (F.get("_p", i - 1)["h"] + F.get("_p", i)["h"]) / 2)
    return points.withColumn("_p", at).select(*by, F.aggregate(steps, F.lit(0.0), lambda a, s: a + s).alias(name))


def _rate(a: Column, b: Column) -> Column:
    """a / b; 1 for 0/0."""
    return F.when(b == 0, F.when(a == 0, 1.0).otherwise(0.0)).otherwise(a / b)


def pr_auc(rows: DataFrame, y: str, p: str, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """M7: (by, pr_auc), by trapezoids over n cuts."""
    c = curve_points(rows, y, p, cuts(n), by)
    return _trapezoid(c, lambda q: _rate(q["tp"], F.col("pos")), lambda q: _rate(q["tp"], q["tp"] + q["fp"]), "pr_auc", by)


def roc_auc_cuts(rows: DataFrame, y: str, p: str, n: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """M6, by trapezoids over n cuts: (by, roc_auc)."""
    c = curve_points(rows, y, p, cuts(n), by)
    return _trapezoid(c, lambda q: _rate(q["fp"], F.col("neg")), lambda q: _rate(q["tp"], F.col("pos")), "roc_auc", by)


def average_precision(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """M8: (by, average_precision): precision at each distinct score, weighed by the recall it adds."""
    s = scores(rows, y, p, by).withColumn("_down", -F.col("p"))
    s = prefix_sums(s, by, "_down", ["pos", "neg"])
    at = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return s.groupBy(*by).agg((F.sum(at * F.col("pos")) / F.nullif(F.sum("pos"), F.lit(0.0))).alias("average_precision"))


def labelled(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, y, p): one row for each label of array columns y (0/1) and p; y may be a class number, one against all."""
    kind = rows.schema[y].dataType.typeName()
    x = F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))) if kind == "array" else F.posexplode(F.transform(F.col(p), lambda v, i: F.struct((F.col(y) == i).cast("int").alias("y"), v.alias("p"))))
    return rows.select(*by, x.alias("label", "_x")).select(*by, "label", F.col("_x.y").alias("y"), F.col("_x.p").alias("p"))


def over_labels(metric, rows: DataFrame, y: str, p: str, average: str | None, name: str, by: Sequence[str] = ()) -> DataFrame:
    """A score metric over labels: micro (all in one), macro (mean of the labels' known ones), or one for each label."""
    each = labelled(rows, y, p, by)
    if average == "micro":
        return metric(each, "y", "p", by=list(by))
    own = metric(each, "y", "p", by=[*by, "label"])
    return own if average is None else own.groupBy(*by).agg(F.avg(name).alias(name))


def regression(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), mask: str | None = None) -> DataFrame:
    """MAE, MSE, RMSE, R2, MAPE and SMAPE (in percent)."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    d = a - b
    share = F.when(a != 0, F.abs(d) / F.abs(a))
    both = F.when(F.abs(a) + F.abs(b) != 0, 2 * F.abs(d) / (F.abs(a) + F.abs(b))).otherwise(0.0)
    n = masked(rows, mask).where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.var_pop(a).alias("_v"), (100 * F.avg(share)).alias("mape"), (100 * F.avg(both)).alias("smape")
    )
    return n.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.nullif(F.col("_v"), F.lit(0.0))).alias("r2"), "mape", "smape")


def losses(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Means of log loss, hinge, squared hinge, MSLE, Huber, log-cosh and Poisson-free cosine similarity of 0/1 labels and scores."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    safe = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), b))
    hinge = F.greatest(F.lit(0.0), 1 - (2 * a - 1) * b)
    d = F.abs(a - b)
    log = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
    return rows.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.avg(-(a * F.ln(safe) + (1 - a) * F.ln(1 - safe))).alias("log_loss"), F.avg(hinge).alias("hinge"), F.avg(hinge * hinge).alias("squared_hinge"),
        F.avg(F.pow(log(a) - log(b), F.lit(2.0))).alias("msle"), F.avg(F.when(d <= 1, d * d / 2).otherwise(d - 0.5)).alias("huber"),
        F.avg(d + F.log1p(F.exp(-2 * d)) - F.ln(F.lit(2.0))).alias("log_cosh"),
        (F.sum(a * b) / F.nullif(F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)), F.lit(0.0))).alias("cosine"),
    )


def top_k(rows: DataFrame, y: str, p: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, top_k): how often class y has one of the k largest scores; of equal scores the earlier class comes first."""
    own = F.get(F.col(p), F.col(y).cast("int"))
    above = F.size(F.filter(F.transform(F.col(p), lambda v, i: (v > own) | ((v == own) & (i < F.col(y)))), lambda x: x))
    return rows.groupBy(*by).agg(F.avg((above < k).cast("double")).alias("top_k"))


def at_operating_point(rows: DataFrame, y: str, p: str, value: float, fixed: str = "sensitivity", n: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """The best specificity at a sensitivity of at least value, or the other way round: (by, specificity or sensitivity)."""
    c = curve_points(rows, y, p, cuts(n), by)
    sens = lambda q: _rate(q["tp"], F.col("pos"))
    spec = lambda q: 1 - F.when(F.col("neg") == 0, 0.0).otherwise(q["fp"] / F.col("neg"))
    have, best, name = (sens, spec, "specificity") if fixed == "sensitivity" else (spec, sens, "sensitivity")
    return c.select(*by, F.coalesce(F.array_max(F.transform(F.filter("points", lambda q: have(q) >= value), best)), F.lit(0.0)).alias(name))


def binned_mae(rows: DataFrame, y: str, p: str, means: Sequence[float] = codes.LOS_MEANS, by: Sequence[str] = (), mask: str | None = None) -> DataFrame:
    """(by, mae, mse) of classes' mean hours; class numbers, or arrays of scores whose largest counts."""
    index = lambda c: codes.arg_max(F.col(c)) if rows.schema[c].dataType.typeName() == "array" else F.col(c)
    d = codes.bin_mean(index(y), means) - codes.bin_mean(index(p), means)
    return masked(rows, mask).groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def calibration(rows: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The reliability curve and confidence histogram: (by, bin, n, confidence, share)."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("share"))


def calibration_error(rows: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    c = calibration(rows, y, p, bins, by)
    return c.groupBy(*by).agg((F.sum(F.abs(F.col("confidence") - F.col("share")) * F.col("n")) / F.sum("n")).alias("ece"))


def drift_report(by_split: DataFrame, metric: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """One row: the metric of each split, and how far the last falls behind the first."""
    own = by_split.agg(*(F.max(F.when(F.col("split") == s, F.col(metric))).alias(s) for s in splits))
    return own.withColumn("drift", F.col(splits[0]) - F.col(splits[-1]))
