"""Queries of data sets that are written as tensors of one shape, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.catalog.series import _F, _LABELS, _T, _grid, _grid_sql, _labels, _task
from tidemark.functions import codes
from tidemark.operators import extract, samples, scale
from tidemark.operators.timeseries import KEYS
from tidemark.sources import stores, tensors


def _written(spark: SparkSession, d: str, **how) -> DataFrame:
    """The LOS task's samples over daily bins, imputed with the mean and scaled to (0, 1), as tensors of the longest one's shape."""
    path, grid = P.folder(spark), _grid(spark, d, dealt=True)
    y = _labels(spark, d, "LOS", dealt=True).withColumn("t", F.col("t") / 24)
    imputer = scale.fit_imputer(grid, P.CHANNELS, "mean")
    scaler = scale.fit_scaler(scale.impute(grid, imputer), P.CHANNELS, "minmax")
    made = samples.exported(grid, y, P.CHANNELS, imputer=imputer, scaler=scaler, binning="custom", **how)
    inner = {"x": [len(P.CHANNELS)], "y": [10 if how.get("one_hot") else 1], "m": []}
    shapes = tensors.longest(made, {"x": inner["x"], **({"y": inner["y"], "m": inner["m"]} if "m" in made.columns else {})})
    tensors.write_tensors(made, path, shapes if "m" in made.columns else shapes | {"y": inner["y"]})
    return tensors.read_tensors(spark, path)


def _sum(values, of=lambda v: v):
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """A sample a label: shapes, lengths and sums of what was written."""
    rows = _written(spark, d)
    total = _sum("x", lambda row: _sum(row, lambda v: v.cast("double")))
    return rows.select(*KEYS, "t", F.col("n").cast("long").alias("n"), F.size("x").cast("long").alias("steps"), F.size(F.col("x")[0]).cast("long").alias("width"), F.round(total, 3).alias("total"), F.col("y")[0].alias("y"))


def exported_deep(spark: SparkSession, d: str) -> DataFrame:
    """A sample a stay, in deep supervision with one-hot labels: how many steps have labels, and of which classes."""
    rows = _written(spark, d, one_hot=True, deep_supervision=True, cut=True)
    classes = _sum("y", lambda row: _sum(F.transform(row, lambda v, i: v.cast("double") * i)))
    return rows.select(
        *KEYS, F.col("n").cast("long").alias("n"), F.size("y").cast("long").alias("steps"), _sum("m", lambda v: v.cast("double")).cast("long").alias("labelled"), _sum("y", lambda row: _sum(row, lambda v: v.cast("double"))).cast("long").alias("hot"),
        classes.cast("long").alias("classes"), F.round(_sum("x", lambda row: _sum(row, lambda v: v.cast("double"))), 3).alias("total"),
    )


def labelled_stays(spark: SparkSession, d: str) -> DataFrame:
    """Rows and labels of each stay of the LOS task: a stay has both, or is in neither table."""
    task = _task(spark, d, "LOS")
    rows, labels = (t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(n)) for t, n in ((task.x, "rows"), (task.y, "labels")))
    return rows.join(labels, list(KEYS), "full")


def episodic_info(spark: SparkSession, d: str) -> DataFrame:
    """First known height and weight of each stay (clicks and purchases stand in), stored by subject and read back."""
    folder, wide = P.folder(spark), P.wide(spark, d)
    info = wide.select(*KEYS).distinct()
    for c, name in (("click", "Height"), ("purchase", "Weight")):
        info = info.join(extract.first_value(wide, c).withColumnRenamed(c, name), list(KEYS), "left")
    stores.write_by_subject({"episodic_info": info}, folder)
    return stores.read_subjects(spark, folder, "episodic_info").select(*KEYS, "Height", "Weight")


_SCALED = f"""{_grid_sql()}, {P.P_SQL}, x AS (SELECT w.*, LOS, MORTALITY, death_hours FROM w JOIN p USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours > -1e-6::DOUBLE AND hours < LOS * 24 + 1e-6::DOUBLE), {_F},
  y AS (SELECT SUBJECT_ID, ICUSTAY_ID, t / 24 AS t, len([b FOR b IN {[24 * x for x in codes.LOS_DAYS]} IF b <= y]) AS y FROM ({_LABELS})),
  im AS (SELECT SUBJECT_ID, ICUSTAY_ID, bins, {", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in P.CHANNELS)} FROM g),
  sc AS (SELECT SUBJECT_ID, ICUSTAY_ID, bins, {" + ".join(f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()))::FLOAT::DOUBLE" for c in P.CHANNELS)} AS v FROM im)"""

ENTRIES = {
    "p14_labelled_stays": (labelled_stays, f"""{_T}, {_F}, y AS ({_LABELS}) SELECT SUBJECT_ID, ICUSTAY_ID, rows, labels FROM (SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS rows FROM x GROUP BY ALL) JOIN (SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS labels FROM y GROUP BY ALL) USING (SUBJECT_ID, ICUSTAY_ID)"""),
    "s23_episodic_info": (episodic_info, f"WITH {P.E_SQL}, {P.W_SQL} SELECT SUBJECT_ID, ICUSTAY_ID, arg_min(click, hours) FILTER (click IS NOT NULL) AS Height, arg_min(purchase, hours) FILTER (purchase IS NOT NULL) AS Weight FROM w GROUP BY ALL"),
    "e9_array_export": (exported, f"""{_SCALED}, s AS (SELECT SUBJECT_ID, ICUSTAY_ID, t, count(*) AS n, round(sum(v), 3) AS total, y::DOUBLE AS y FROM y JOIN sc USING (SUBJECT_ID, ICUSTAY_ID) WHERE bins <= t GROUP BY ALL)
      SELECT SUBJECT_ID, ICUSTAY_ID, t, n, max(n) OVER () AS steps, {len(P.CHANNELS)}::BIGINT AS width, total, y FROM s"""),
    "e9_deep_export": (exported_deep, f"""{_SCALED}, l AS (SELECT SUBJECT_ID, ICUSTAY_ID, t::INT AS bins, y FROM y WHERE t = floor(t)),
      j AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN bins END) OVER (PARTITION BY SUBJECT_ID, ICUSTAY_ID) AS last FROM sc LEFT JOIN l USING (SUBJECT_ID, ICUSTAY_ID, bins)),
      s AS (SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS n, count(y) AS labelled, count(y) AS hot, coalesce(sum(y), 0)::BIGINT AS classes, round(sum(v), 3) AS total FROM j WHERE bins <= last GROUP BY ALL)
      SELECT SUBJECT_ID, ICUSTAY_ID, n, max(n) OVER () AS steps, labelled, hot, classes, total FROM s"""),
}
