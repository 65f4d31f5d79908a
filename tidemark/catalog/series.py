"""Queries of time grids, labels and window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.functions import codes
from tidemark.operators import features, samples, stats, tasks, timeseries
from tidemark.operators.timeseries import KEYS

#: A day's step; normal values of the channels.
STEP = 24.0
NORMAL = {c: float(i + 1) for i, c in enumerate(P.CHANNELS)}


def _grid(spark: SparkSession, d: str, zero: bool = True, dealt: bool = False) -> DataFrame:
    binned = timeseries.last_in_bin(timeseries.with_bins(P.wide(spark, d, dealt), STEP, zero), P.CHANNELS)
    return timeseries.dense_grid(binned)


def grid(strategy: str, zero: bool = True):
    return lambda spark, d: timeseries.imputed(_grid(spark, d, zero), NORMAL, strategy)


def _grid_sql(zero: bool = True) -> str:
    start = "0" if zero else "min(hours) OVER (PARTITION BY SUBJECT_ID, ICUSTAY_ID)"
    return f"""WITH {P.E_SQL}, {P.W_SQL}, b0 AS (SELECT *, trunc((hours - {start}) / 24 - 1e-6::DOUBLE)::INT AS bins FROM w),
b AS (SELECT SUBJECT_ID, ICUSTAY_ID, bins, {", ".join(f"arg_max({c}, hours) FILTER ({c} IS NOT NULL) AS {c}" for c in P.CHANNELS)} FROM b0 GROUP BY ALL),
g AS (SELECT g.*, {", ".join(P.CHANNELS)} FROM (SELECT SUBJECT_ID, ICUSTAY_ID, unnest(range(0, max(bins) + 1))::INT AS bins FROM b GROUP BY SUBJECT_ID, ICUSTAY_ID) g LEFT JOIN b USING (SUBJECT_ID, ICUSTAY_ID, bins))"""


def _imputed_sql(strategy: str, zero: bool = True) -> str:
    over = "PARTITION BY SUBJECT_ID, ICUSTAY_ID ORDER BY bins"
    of = {
        "previous": lambda c: f"last_value({c} IGNORE NULLS) OVER ({over} ROWS UNBOUNDED PRECEDING)",
        "next": lambda c: f"first_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
        "normal": lambda c: c,
        "zero": lambda c: c,
    }[strategy]
    return f"{_grid_sql(zero)} SELECT SUBJECT_ID, ICUSTAY_ID, bins, {', '.join(f'coalesce({of(c)}, {0.0 if strategy == "zero" else NORMAL[c]}::DOUBLE) AS {c}' for c in P.CHANNELS)} FROM g"


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def one_hot(spark: SparkSession, d: str) -> DataFrame:
    o = P.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("priority"))
    hot = timeseries.one_hot(o, {"priority": PRIORITIES})
    return hot.select("o_orderkey", *(F.col(f"`priority->{p}`").cast("double").alias(f"p{i}") for i, p in enumerate(PRIORITIES)))


def discretized(spark: SparkSession, d: str) -> DataFrame:
    """The whole discretizer: two numbers and a category of three, with daily bins."""
    w = P.wide(spark, d).select(*KEYS, "hours", "click", "view", F.when(F.col("error") < 5, "low").when(F.col("error") < 20, "middle").when(F.col("error") < 60, "high").when(F.col("error").isNotNull(), "other").alias("error"))
    out = timeseries.discretize(w, STEP, "previous", True, {"error": ["low", "middle", "high"]}, {"click": "1.5", "view": "2.5", "error": "middle"})
    return out.select(*KEYS, "bins", F.round(F.col("click").cast("double"), 4).alias("click"), F.round(F.col("view").cast("double"), 4).alias("view"), *(F.col(f"`error->{c}`").cast("int").alias(c) for c in ("low", "middle", "high")))


DISCRETIZED_SQL = f"""WITH {P.E_SQL}, {P.W_SQL},
h AS (SELECT SUBJECT_ID, ICUSTAY_ID, trunc(hours / 24 - 1e-6::DOUBLE)::INT AS bins, hours, click, view, CASE WHEN error < 5 THEN 1 WHEN error IS NOT NULL THEN 0 END AS low,
      CASE WHEN error >= 5 AND error < 20 THEN 1 WHEN error IS NOT NULL THEN 0 END AS middle, CASE WHEN error >= 20 AND error < 60 THEN 1 WHEN error IS NOT NULL THEN 0 END AS high FROM w),
b AS (SELECT SUBJECT_ID, ICUSTAY_ID, bins, {", ".join(f"arg_max({c}, hours) FILTER ({c} IS NOT NULL) AS {c}" for c in ("click", "view", "low", "middle", "high"))} FROM h GROUP BY ALL),
g AS (SELECT * FROM (SELECT SUBJECT_ID, ICUSTAY_ID, unnest(range(0, max(bins) + 1))::INT AS bins FROM b GROUP BY SUBJECT_ID, ICUSTAY_ID) LEFT JOIN b USING (SUBJECT_ID, ICUSTAY_ID, bins))
SELECT SUBJECT_ID, ICUSTAY_ID, bins, {", ".join(f"{f'round({x}::FLOAT::DOUBLE, 4)' if c in ('click', 'view') else x + '::INT'} AS {c}" for c, n in (("click", "1.5"), ("view", "2.5"), ("low", "0"), ("middle", "1"), ("high", "0")) for x in [f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY SUBJECT_ID, ICUSTAY_ID ORDER BY bins ROWS UNBOUNDED PRECEDING), {n})"])} FROM g"""


def _task(spark: SparkSession, d: str, task: str, series: DataFrame | None = None, dealt: bool = False) -> tasks.Task:
    ep = P.episodic(spark, d, dealt)
    diag = P.events(spark, d).where("VALUE > 15").select(*KEYS, F.col("VARIABLE").alias("HCUP_CCS_2015"), (F.col("VARIABLE") != "view").cast("int").alias("USE_IN_BENCHMARK"))
    groups = [c for c in P.CHANNELS if c != "view"]
    return tasks.task_set(task, P.wide(spark, d) if series is None else series, ep.select(*KEYS, "AGE", "LOS", "MORTALITY"), ep.select(*KEYS, "INTIME", "DEATHTIME"), diag, groups)


def _labels(spark: SparkSession, d: str, task: str, dealt: bool = False) -> DataFrame:
    """A task's labels: they go by stays and hours of rows alone, so events needn't be made wide for them."""
    return _task(spark, d, task, P.events(spark, d, dealt).select(*KEYS, "hours"), dealt).y


def labels(task: str):
    return lambda spark, d: _labels(spark, d, task)


def rows(task: str):
    return lambda spark, d: _task(spark, d, task).x.select(*KEYS, "hours", *P.CHANNELS)


def phenotyping(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, "PHENO").select(*KEYS, "t", *(F.col("y")[i].alias(f"y{i}") for i in range(4)))


def multitask(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c)
    y = _labels(spark, d, "MULTI")
    return y.select(*KEYS, "IHM_pos", "IHM_mask", F.col("IHM_label").cast("int").alias("IHM_label"), *(text(c) for c in ("DECOMP_masks", "DECOMP_labels", "LOS_masks", "LOS_labels")), "LOS_value", text("PHENO_labels"))


_T = f"WITH {P.E_SQL}, {P.W_SQL}, {P.P_SQL}, x AS (SELECT w.*, LOS, MORTALITY, death_hours FROM w JOIN p USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours > -1e-6 AND hours < LOS * 24 + 1e-6::DOUBLE)"
_F = "f AS (SELECT SUBJECT_ID, ICUSTAY_ID, LOS * 24 AS los, MORTALITY, coalesce(death_hours, 1e18::DOUBLE) AS lived, min(hours) AS first FROM x GROUP BY ALL)"


def _hourly(end: str, after: str, y: str) -> str:
    return f"SELECT SUBJECT_ID, ICUSTAY_ID, t, {y} AS y FROM (SELECT *, unnest(range(0, floor({end} + 1e-6::DOUBLE)::BIGINT + 1))::DOUBLE AS t FROM f) WHERE {after}"


_DEC = "CASE WHEN MORTALITY = 1 THEN (lived - t < 24)::INT::DOUBLE ELSE 0.0::DOUBLE END"
_PH = "ph AS (SELECT SUBJECT_ID, ICUSTAY_ID, " + ", ".join(f"max((VARIABLE = '{c}')::INT) AS y{i}" for i, c in enumerate(c for c in P.CHANNELS if c != "view")) + " FROM e WHERE VALUE > 15 GROUP BY ALL)"
MULTI_SQL = f"""{_T}, {_F}, {_PH},
i AS (SELECT DISTINCT SUBJECT_ID, ICUSTAY_ID FROM x WHERE LOS * 24 >= 48 AND hours < 48 + 1e-6::DOUBLE),
dc AS (SELECT SUBJECT_ID, ICUSTAY_ID, string_agg((t > 4)::INT, ',' ORDER BY t) AS DECOMP_masks, string_agg(y::INT, ',' ORDER BY t) AS DECOMP_labels FROM ({_hourly("least(los, lived)", "true", _DEC)}) GROUP BY ALL),
lo AS (SELECT SUBJECT_ID, ICUSTAY_ID, string_agg((t > 4)::INT, ',' ORDER BY t) AS LOS_masks, string_agg(trunc(y)::INT, ',' ORDER BY t) AS LOS_labels FROM ({_hourly("los", "true", "los - t")}) GROUP BY ALL)
SELECT f.SUBJECT_ID, f.ICUSTAY_ID, CASE WHEN i.SUBJECT_ID IS NULL THEN 0 ELSE 47 END AS IHM_pos, (i.SUBJECT_ID IS NOT NULL)::INT AS IHM_mask, MORTALITY AS IHM_label, DECOMP_masks, DECOMP_labels, LOS_masks, LOS_labels, los AS LOS_value,
  concat_ws(',', y0, y1, y2, y3) AS PHENO_labels
FROM f JOIN ph USING (SUBJECT_ID, ICUSTAY_ID) LEFT JOIN i USING (SUBJECT_ID, ICUSTAY_ID) JOIN dc USING (SUBJECT_ID, ICUSTAY_ID) JOIN lo USING (SUBJECT_ID, ICUSTAY_ID)"""


def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    return tasks.sample_counts(_labels(spark, d, "LOS"))


def sample_shares(spark: SparkSession, d: str) -> DataFrame:
    n = _labels(spark, d, "LOS").groupBy("SUBJECT_ID").agg(F.count(F.lit(1)).alias("n"))
    return tasks.sample_shares(n)


def deep_supervision(spark: SparkSession, d: str) -> DataFrame:
    g = timeseries.dense_grid(timeseries.last_in_bin(timeseries.with_bins(P.wide(spark, d), 1.0), P.CHANNELS))
    return timeseries.deep_supervision(g, _labels(spark, d, "DECOMP"))


def replicated(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    weighed = timeseries.replication_weights(g.select(*KEYS, "bins"), 0.5)
    return timeseries.target_replication(weighed, _labels(spark, d, "IHM"))


def prefix(spark: SparkSession, d: str) -> DataFrame:
    y = _labels(spark, d, "LOS", dealt=True)
    return timeseries.prefix_rows(P.wide(spark, d, dealt=True), y).groupBy(*KEYS, "t").agg(F.count(F.lit(1)).alias("n"), F.max("hours").alias("last"))


def at_time(spark: SparkSession, d: str) -> DataFrame:
    y = _labels(spark, d, "IHM")
    return timeseries.rows_at(P.wide(spark, d), y).select(*KEYS, "t", "y", *P.CHANNELS)


def _sixth(v: Column) -> Column:
    """Half up at the sixth digit, in double precision, as SQL has it; round() makes a decimal object of each number and is left to large ones, which have few digits behind the sixth."""
    return F.when(F.abs(v) < 2.0**20, F.signum(v) * (F.floor(F.abs(v) * 1e6 + 0.5) / F.lit(1e6))).otherwise(F.round(v, 6))


def window_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Six statistics of seven sub-windows of each channel before each hourly label."""
    y = _labels(spark, d, "LOS", dealt=True)
    told = features.windowed(P.wide(spark, d, dealt=True), y, P.CHANNELS)
    each = told.select(*KEYS, "t", "channel", F.posexplode("stats").alias("window", "s"))
    return each.select(*KEYS, "t", "channel", "window", *((_sixth(F.col(f"s.{n}")) + 0.0).alias(n) for n in features.STATISTICS))


_WINDOWS = ", ".join(f"({i}, '{p}', {n})" for i, (p, n) in enumerate(features.SUB_WINDOWS))
_LABELS = _hourly("los", "t > 4 AND t >= first", "los - t")
_STATS = f"""{_T}, {_F}, y AS ({_LABELS}), l AS ({" UNION ALL ".join(f"SELECT SUBJECT_ID, ICUSTAY_ID, hours, '{c}' AS channel, {c} AS v FROM w WHERE {c} IS NOT NULL" for c in P.CHANNELS)}),
pr AS (SELECT y.SUBJECT_ID, y.ICUSTAY_ID, t, channel, hours, v, min(hours) OVER k AS lo, max(hours) OVER k AS hi FROM y JOIN l USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours < t + 1e-6::DOUBLE WINDOW k AS (PARTITION BY y.SUBJECT_ID, y.ICUSTAY_ID, t, channel)),
sw AS (SELECT *, CASE part WHEN 'first' THEN lo ELSE hi - (hi - lo) * (pc / 100.0::DOUBLE) END AS a, CASE part WHEN 'first' THEN lo + (hi - lo) * (pc / 100.0::DOUBLE) ELSE hi END AS b FROM pr, (VALUES {_WINDOWS}) z(wd, part, pc)),
st AS (SELECT SUBJECT_ID, ICUSTAY_ID, t, channel, wd AS "window", min(v) AS mi, max(v) AS ma, avg(v) AS me, count(*) AS n, avg(v * v) AS m2, avg(v * v * v) AS m3, stddev_pop(v) AS sd FROM sw WHERE hours < b + 1e-6::DOUBLE AND hours > a - 1e-6::DOUBLE GROUP BY ALL)"""
STATS_SQL = f"""{_STATS} SELECT SUBJECT_ID, ICUSTAY_ID, t, channel, "window", round(mi, 6) AS min, round(ma, 6) AS max, round(me, 6) AS mean, round(sd, 6) AS std,
  round(CASE WHEN n > 1 AND mi <> ma THEN (m3 - 3 * me * m2 + 2 * me * me * me) / pow(sd, 3) END, 6) + 0.0::DOUBLE AS skew, n::DOUBLE AS len FROM st"""


def vector(spark: SparkSession, d: str) -> DataFrame:
    """The feature vector of each hourly label: how many features are known, and the first channel's mean and length."""
    y = _labels(spark, d, "LOS")
    x = features.engineered(P.wide(spark, d), y, P.CHANNELS)
    return x.select(*KEYS, "t", F.size("x").alias("n"), F.size(F.filter("x", lambda v: v.isNotNull())).alias("known"), F.round(F.col("x")[0].cast("double"), 3).alias("first_min"), F.col("x")[5].cast("int").alias("first_len"))


VECTOR_SQL = f"""{_STATS} SELECT y.SUBJECT_ID, y.ICUSTAY_ID, y.t, 210 AS n, coalesce(k, 0) AS known, m AS first_min, n5 AS first_len FROM y LEFT JOIN (
  SELECT SUBJECT_ID, ICUSTAY_ID, t, sum(5 + (n > 1 AND mi <> ma)::INT)::INT AS k, round(max(mi) FILTER (channel = 'click' AND "window" = 0)::FLOAT::DOUBLE, 3) AS m, (max(n) FILTER (channel = 'click' AND "window" = 0))::INT AS n5 FROM st GROUP BY ALL) USING (SUBJECT_ID, ICUSTAY_ID, t)"""


def last_quarter(spark: SparkSession, d: str) -> DataFrame:
    return features.series_window(P.wide(spark, d), "last", 25).select(*KEYS, "hours")


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    o = P.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("other"))
    return features.ordinals(o, {"o_orderpriority": {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}, "other": {"7": 70}})


def padded(spark: SparkSession, d: str) -> DataFrame:
    lists = P.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    p = lists.withColumn("p", timeseries.padded(F.col("q"), 7)).withColumn("z", F.slice("q", 1, 3))
    cut = timeseries.cut_to_shortest(p, ["p", "z"])
    return p.select("l_orderkey", F.size("p").alias("n"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_position("p", 0.0).cast("int").alias("zero")).join(cut.select("l_orderkey", F.size("p").alias("shortest")), "l_orderkey")


def batches(spark: SparkSession, d: str) -> DataFrame:
    arrays = samples.stay_arrays(timeseries.imputed(_grid(spark, d), NORMAL), P.CHANNELS).withColumn("y", F.lit(1.0))
    return samples.batches(arrays, 16, KEYS, len(P.CHANNELS)).select("batch", F.size("x").alias("size"), F.size(F.col("x")[0]).alias("longest"), F.aggregate("lengths", F.lit(0), lambda a, x: a + x).alias("steps"))


BATCH_SQL = f"""{_grid_sql()}, n AS (SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT *, (row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || SUBJECT_ID::VARCHAR || '|' || ICUSTAY_ID::VARCHAR), 1, 7))::BIGINT, SUBJECT_ID, ICUSTAY_ID) - 1) // 16 AS batch FROM n)
SELECT batch, count(*) AS size, max(n) AS longest, sum(n) AS steps FROM o GROUP BY 1"""


def prefix_samples(spark: SparkSession, d: str) -> DataFrame:
    y = _labels(spark, d, "LOS").withColumn("t", F.col("t") / 24)
    out = samples.prefix_samples(timeseries.imputed(_grid(spark, d), NORMAL), y, P.CHANNELS)
    return out.select(*KEYS, "t", "n", "y", F.round(F.element_at("x", -1)[0].cast("double"), 3).alias("click"))


def batch_count(spark: SparkSession, d: str) -> DataFrame:
    return samples.batch_count(P.table(spark, d, "orders"), 64)


def running_mean(spark: SparkSession, d: str) -> DataFrame:
    return stats.running_mean(P.events(spark, d), "VALUE", ["SUBJECT_ID"], "EVENT_ID").select("EVENT_ID", F.round("running_mean", 10).alias("running_mean"))


def autocorrelation(spark: SparkSession, d: str, max_lag: int = 100) -> DataFrame:
    return stats.autocorrelation(P.events(spark, d), "VALUE", ["SUBJECT_ID"], "EVENT_ID", max_lag).select("SUBJECT_ID", "lag", F.round("r", 6).alias("r"))


def correlations(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(P.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("a", "b", F.round("r", 6).alias("r"))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(P.table(spark, d, "lineitem"), ["l_quantity", "l_discount"])


def kinds(spark: SparkSession, d: str) -> DataFrame:
    return stats.column_kinds(P.table(spark, d, "customer").withColumn("nothing", F.lit(None).cast("string")), ["c_acctbal", "c_name", "nothing"])


def flagged_hours(spark: SparkSession, d: str) -> DataFrame:
    lines = P.table(spark, d, "lineitem")
    n = P.tasks_for(lines)
    li = lines.repartition(n, "l_orderkey").join(P.table(spark, d, "orders").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    h = codes.hours_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    grid_ = timeseries.label_grid(li.select("l_orderkey", "l_linenumber", h.alias("h")), F.col("h"), 240.0, ["l_orderkey"], 240.0)
    return grid_.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))


_HIST = lambda c: f"""SELECT '{c}' AS name, coalesce(least(9, floor(({c} - lo) / nullif(hi - lo, 0) * 10)), 0)::INT AS bin, count(*) AS n FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 2"""
_PAIRS = [(a, b) for i, a in enumerate(["l_quantity", "l_extendedprice", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_tax"][i:]]
ENTRIES = {
    **{f"w5_daily_grid_{s}": (grid(s), _imputed_sql(s)) for s in ("previous", "next", "normal", "zero")},
    "w3_w4_a7_grid_from_first_event": (grid("previous", False), _imputed_sql("previous", False)),
    "w16_one_hot": (one_hot, f"SELECT o_orderkey, {', '.join(f'CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderpriority = {chr(39)}{p}{chr(39)})::INT::DOUBLE END AS p{i}' for i, p in enumerate(PRIORITIES))} FROM orders"),
    "w16_w3_w5_discretized": (discretized, DISCRETIZED_SQL),
    "w7_label_grid": (flagged_hours, """SELECT l_orderkey, l_linenumber, count(*) AS n, max(t)::DOUBLE AS last FROM (SELECT l_orderkey, l_linenumber, unnest(range(0, floor((h + 1e-6::DOUBLE) / 240)::BIGINT + 1)) * 240 AS t
      FROM (SELECT *, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE h >= 0) WHERE t > 240 GROUP BY ALL"""),
    "t1_ihm_labels": (labels("IHM"), f"{_T} SELECT SUBJECT_ID, ICUSTAY_ID, max(hours) AS t, any_value(MORTALITY)::DOUBLE AS y FROM x WHERE LOS * 24 >= 48 AND hours < 48 + 1e-6::DOUBLE GROUP BY ALL"),
    "t1_p15_ihm_rows": (rows("IHM"), f"{_T} SELECT SUBJECT_ID, ICUSTAY_ID, hours, {', '.join(P.CHANNELS)} FROM x WHERE LOS * 24 >= 48 AND hours < 48 + 1e-6::DOUBLE"),
    "t2_w7_w8_decomp_labels": (labels("DECOMP"), f"{_T}, {_F} {_hourly('least(los, lived)', 't > 4 AND t > first', _DEC)}"),
    "t3_w9_los_labels": (labels("LOS"), f"{_T}, {_F} {_hourly('los', 't > 4 AND t >= first', 'los - t')}"),
    "t4_j16_a13_pheno_labels": (phenotyping, f"{_T}, {_F}, {_PH} SELECT SUBJECT_ID, ICUSTAY_ID, los AS t, y0, y1, y2, y3 FROM f JOIN ph USING (SUBJECT_ID, ICUSTAY_ID)"),
    "t5_multi_labels": (multitask, MULTI_SQL),
    "a10_sample_counts": (sample_counts, f"{_T}, {_F}, y AS ({_hourly('los', 't > 4 AND t >= first', 'los - t')}) SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS n FROM y GROUP BY ROLLUP (SUBJECT_ID, ICUSTAY_ID)"),
    "a12_sample_shares": (sample_shares, f"{_T}, {_F}, y AS ({_hourly('los', 't > 4 AND t >= first', 'los - t')}) SELECT SUBJECT_ID, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM y GROUP BY 1"),
    "w10_deep_supervision": (deep_supervision, f"""{_T}, {_F}, y AS ({_hourly('least(los, lived)', 't > 4 AND t > first', _DEC)}),
      g AS (SELECT SUBJECT_ID, ICUSTAY_ID, unnest(range(0, max(trunc(hours - 1e-6::DOUBLE)::INT) + 1))::INT AS bins FROM w GROUP BY SUBJECT_ID, ICUSTAY_ID)
      SELECT SUBJECT_ID, ICUSTAY_ID, bins, coalesce(y, 0.0::DOUBLE) AS y, y IS NOT NULL AS mask FROM g LEFT JOIN (SELECT SUBJECT_ID, ICUSTAY_ID, t::INT AS bins, y FROM y) USING (SUBJECT_ID, ICUSTAY_ID, bins)"""),
    "w11_w14_replicated_targets": (replicated, f"""{_grid_sql()}, {P.P_SQL}, i AS (SELECT SUBJECT_ID, ICUSTAY_ID, any_value(MORTALITY)::DOUBLE AS y FROM w JOIN p USING (SUBJECT_ID, ICUSTAY_ID) WHERE LOS * 24 >= 48 AND hours < 48 + 1e-6::DOUBLE GROUP BY ALL)
      SELECT SUBJECT_ID, ICUSTAY_ID, bins, CASE WHEN bins < max(bins) OVER (PARTITION BY SUBJECT_ID, ICUSTAY_ID) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, y FROM g JOIN i USING (SUBJECT_ID, ICUSTAY_ID)"""),
    "j13_prefix_rows": (prefix, f"{_T}, {_F}, y AS ({_LABELS}) SELECT SUBJECT_ID, ICUSTAY_ID, t, count(*) AS n, max(hours) AS last FROM y JOIN w USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours < t + 1e-6::DOUBLE GROUP BY ALL"),
    "j15_rows_at_label": (at_time, f"""{_T}, y AS (SELECT SUBJECT_ID, ICUSTAY_ID, max(hours) AS t, any_value(MORTALITY)::DOUBLE AS y FROM x WHERE LOS * 24 >= 48 AND hours < 48 + 1e-6::DOUBLE GROUP BY ALL)
      SELECT y.*, {', '.join(P.CHANNELS)} FROM y JOIN w ON y.SUBJECT_ID = w.SUBJECT_ID AND y.ICUSTAY_ID = w.ICUSTAY_ID AND t = hours"""),
    "w6_a8_window_statistics": (window_statistics, STATS_SQL),
    "a9_feature_vector": (vector, VECTOR_SQL),
    "w6b_series_window": (last_quarter, f"WITH {P.E_SQL}, {P.W_SQL} SELECT SUBJECT_ID, ICUSTAY_ID, hours FROM (SELECT *, min(hours) OVER k AS lo, max(hours) OVER k AS hi FROM w WINDOW k AS (PARTITION BY SUBJECT_ID, ICUSTAY_ID)) WHERE hours > hi - (hi - lo) * 0.25::DOUBLE - 1e-6::DOUBLE"),
    "w15_ordinals": (ordinals, "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END::DOUBLE AS o_orderpriority, CASE WHEN o_orderkey = 7 THEN 70 ELSE o_orderkey END::DOUBLE AS other FROM orders"),
    "w12_w13_padded": (padded, "SELECT l_orderkey, greatest(7, count(*))::INT AS n, sum(l_quantity) AS total, (CASE WHEN count(*) < 7 THEN count(*) + 1 ELSE 0 END)::INT AS zero, least(3, count(*))::INT AS shortest FROM lineitem GROUP BY 1"),
    "b1_b2_batches": (batches, BATCH_SQL),
    "b1_j14_prefix_samples": (prefix_samples, f"""{_grid_sql()}, {P.P_SQL}, x AS (SELECT w.*, LOS, MORTALITY, death_hours FROM w JOIN p USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours > -1e-6 AND hours < LOS * 24 + 1e-6::DOUBLE), {_F},
      y AS (SELECT SUBJECT_ID, ICUSTAY_ID, t / 24 AS t, y FROM ({_LABELS})), im AS (SELECT SUBJECT_ID, ICUSTAY_ID, bins, coalesce(last_value(click IGNORE NULLS) OVER (PARTITION BY SUBJECT_ID, ICUSTAY_ID ORDER BY bins ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE) AS click FROM g)
      SELECT SUBJECT_ID, ICUSTAY_ID, t, count(*) AS n, y, round(arg_max(click, bins)::FLOAT::DOUBLE, 3) AS click FROM y JOIN im USING (SUBJECT_ID, ICUSTAY_ID) WHERE bins <= t GROUP BY ALL"""),
    "b3_batch_count": (batch_count, "SELECT count(*) // 64 AS batches FROM orders"),
    "a18_running_mean": (running_mean, "SELECT event_id AS EVENT_ID, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 10) AS running_mean FROM events"),
    "a17_autocorrelation": (autocorrelation, """WITH n AS (SELECT user_id AS s, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), q AS (SELECT s, sum(v * v) AS q FROM n GROUP BY 1)
      SELECT a.s AS SUBJECT_ID, lag, round(sum(a.v * b.v) / any_value(q), 6) AS r FROM n a, (SELECT unnest(range(0, 101))::INT AS lag) JOIN n b ON a.s = b.s AND a.i = b.i + lag JOIN q ON q.s = a.s GROUP BY ALL"""),
    "a15_correlations": (correlations, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS)),
    "a16_histogram": (histogram, f"{_HIST('l_quantity')} UNION ALL {_HIST('l_discount')}"),
    "a20_column_kinds": (kinds, "SELECT unnest(['c_acctbal', 'c_name', 'nothing']) AS name, unnest([count(c_acctbal) = 0, count(c_name) = 0, true]) AS all_null, unnest([true, count(try_cast(c_name AS DOUBLE)) = count(c_name), true]) AS numeric FROM customer"),
}
