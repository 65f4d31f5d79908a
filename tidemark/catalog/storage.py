"""Queries of scans and sinks: the given tables are written in the raw or stored form, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.catalog.series import _task
from tidemark.functions import permutation
from tidemark.operators import features, metrics, scale
from tidemark.sources import raw, stores


def _as_csv(spark: SparkSession, frame: DataFrame, table: str, header: bool = True) -> str:
    """frame as a raw table, in lower-case columns and with times as text; gives the folder."""
    folder = P.folder(spark)
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kind == "timestamp" else F.col(c) for c, kind in frame.dtypes]
    frame.select(*text).toDF(*(c.lower() for c in frame.columns)).write.option("header", header).option("escape", '"').csv(f"{folder}/{table}.csv")
    return folder


def patients(spark: SparkSession, d: str) -> DataFrame:
    t = raw.read_raw(spark, _as_csv(spark, P.orders_as_stays(spark, d)["patients"], "PATIENTS"), "PATIENTS")
    return t.select("SUBJECT_ID", "GENDER", F.year("DOB").alias("born"), F.col("DOD").isNull().alias("alive"))


def stays(spark: SparkSession, d: str) -> DataFrame:
    t = raw.read_raw(spark, _as_csv(spark, P.orders_as_stays(spark, d)["stays"], "ICUSTAYS"), "ICUSTAYS")
    return t.select("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "FIRST_CAREUNIT", "FIRST_WARDID", F.datediff("OUTTIME", "INTIME").alias("days"), F.year("INTIME").alias("year"), "LOS")


def titles(spark: SparkSession, d: str) -> DataFrame:
    part = P.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ICD9_CODE"), F.col("p_type").alias("SHORT_TITLE"), F.concat_ws(", ", "p_name", F.lit('a "b"')).alias("LONG_TITLE"), F.lit(1).alias("ROW_ID"))
    return raw.read_raw(spark, _as_csv(spark, part, "D_ICD_DIAGNOSES"), "D_ICD_DIAGNOSES")


def items(spark: SparkSession, d: str) -> DataFrame:
    part = P.table(spark, d, "part").select(F.col("p_partkey").alias("ITEMID"), F.col("p_type").alias("DBSOURCE"), F.col("p_name").alias("LABEL"))
    return raw.read_raw(spark, _as_csv(spark, part, "D_ITEMS"), "D_ITEMS")


def records(spark: SparkSession, d: str) -> DataFrame:
    return raw.read_raw(spark, _as_csv(spark, P.lines_as_diagnoses(spark, d), "DIAGNOSES_ICD"), "DIAGNOSES_ICD")


def lenient(spark: SparkSession, d: str) -> DataFrame:
    """A table of any name; what doesn't fit its kind is null."""
    e = P.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"), "event_type")
    folder = _as_csv(spark, e, "LOG")
    return raw.read_table(spark, f"{folder}/LOG.csv", {"EVENT_ID": "long", "USER_ID": "int", "EVENT_TYPE": "string"}, lenient=True)


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Samples and labels written by subject in two runs, the second of which brings subjects that are there already; then those of some subjects."""
    folder, task = P.folder(spark), _task(spark, d, "LOS")
    one = {"X": task.x.where("SUBJECT_ID % 2 = 0"), "y": task.y}
    stores.write_by_subject(one, folder)
    stores.write_by_subject({"X": task.x, "y": task.y}, folder)
    y = stores.read_subjects(spark, folder, "y")
    return y.groupBy("SUBJECT_ID", "ICUSTAY_ID").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hours"))


def flat_samples(spark: SparkSession, d: str) -> DataFrame:
    """Engineered samples in a column each, beside their labels, written and read."""
    path, y = P.folder(spark), _task(spark, d, "IHM").y
    x = features.flat(features.engineered(P.wide(spark, d), y, P.CHANNELS), features.feature_names(P.CHANNELS))
    stores.write_samples(x.drop("t"), y.drop("t"), path, ["SUBJECT_ID", "ICUSTAY_ID"])
    kept = spark.read.parquet(path)
    return kept.select("SUBJECT_ID", "ICUSTAY_ID", "y", F.col("`click|first 100|len`").cast("int").alias("clicks"), F.round(F.col("`view|first 100|max`").cast("double"), 3).alias("largest_view"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Error metrics of each split as JSON, by run and split."""
    path = P.folder(spark)
    e = P.events(spark, d).select(F.col("VARIABLE").alias("split"), F.col("VALUE").alias("y"), F.lit(20.0).alias("p"))
    told = metrics.regression(e, "y", "p", ["split"])
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("mae", "rmse"))))
    stores.write_metrics(told.select(F.lit("r1").alias("run"), "split", each.alias("m")).select("run", "split", "m.*"), path)
    return spark.read.json(path).select("run", "split", "metric", F.round("value", 6).alias("value"))


#: Draws of a call, of each ten customers, and calls.
_PART, _CALLS = 4, 6


def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Six calls that draw four of ten customers each, and so go on into a third epoch."""
    folder = P.folder(spark)
    stores.numbered_subjects(P.table(spark, d, "customer"), "c_custkey").write.parquet(folder)
    subjects = spark.read.parquet(folder)
    total = subjects.count()
    n, out = -(-total * _PART // 10), None
    for call in range(_CALLS):
        drawn = stores.draw_subjects(subjects, total, n, call * n, key="c_custkey").withColumn("call", F.lit(call))
        out = drawn if out is None else out.unionByName(drawn)
    return out


def _epochs_sql() -> str:
    turn = lambda i, half: f"('0x' || substr(md5('42|' || e || '|{i}|' || {half}), 1, 15))::BIGINT"
    out = "SELECT k, e, x % a AS l, x // a AS r, a, b, n FROM w"
    for i in range(permutation.ROUNDS):
        out = f"SELECT * REPLACE ((l + {turn(i, 'r')} % a) % a AS l) FROM ({out})" if i % 2 == 0 else f"SELECT * REPLACE ((r + {turn(i, 'l')} % b) % b AS r) FROM ({out})"
    return f"""WITH RECURSIVE s AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS x FROM (SELECT DISTINCT c_custkey FROM customer)),
    z AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM s)),
    w AS (SELECT k, e, x, a, b, n, false AS done FROM s, z, (SELECT unnest(range(0, 1 + {_CALLS * _PART} // 10 + 1)) AS e)
      UNION ALL SELECT k, e, r * a + l, a, b, n, r * a + l < n FROM ({out.replace('FROM w', 'FROM w WHERE NOT done')}))
    SELECT k AS c_custkey, e * n + x AS draw, ((e * n + x) // ((n * {_PART} + 9) // 10))::INT AS call FROM w WHERE done AND e * n + x < {_CALLS} * ((n * {_PART} + 9) // 10)"""


def rows_of_file(spark: SparkSession, d: str) -> DataFrame:
    folder = _as_csv(spark, P.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "LINES", header=False)
    return spark.range(1).select(F.lit(raw.row_count(spark, f"{folder}/LINES.csv")).cast("long").alias("n"))


def kept_scaler(spark: SparkSession, d: str) -> DataFrame:
    """A scaler that was fitted, written and read."""
    path, li = P.folder(spark), P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    scale.save(scale.fit_scaler(li, ["l_quantity", "l_tax"], "minmax"), path)
    out = scale.scaled(li, scale.load(spark, path))
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 8).alias("l_quantity"), F.round("l_tax", 8).alias("l_tax"))


def approximate(spark: SparkSession, d: str) -> DataFrame:
    """The robust scaler and the median from sketches; on these tables, of few distinct values, they meet the nearest rank exactly."""
    li = P.table(spark, d, "lineitem")
    s = scale.fit_scaler(li, ["l_quantity"], "robust", accuracy=1_000_000)
    m = scale.fit_imputer(li, ["l_quantity"], "median", accuracy=1_000_000)
    return s.select(F.col("l_quantity.centre").alias("centre"), F.col("l_quantity.scale").alias("scale")).crossJoin(F.broadcast(m.select(F.col("l_quantity").cast("double").alias("median"))))  # one row each


_T = f"WITH {P.E_SQL}, {P.W_SQL}, {P.P_SQL}, x AS (SELECT w.*, LOS, MORTALITY, death_hours FROM w JOIN p USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours > -1e-6::DOUBLE AND hours < LOS * 24 + 1e-6::DOUBLE)"
_RANK = "max(l_quantity) FILTER (i = ceil({q} * n)::BIGINT)"

ENTRIES = {
    "s1_patients": (patients, "SELECT c_custkey::INT AS SUBJECT_ID, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS GENDER, (1900 + c_custkey % 120)::INT AS born, true AS alive FROM customer"),
    "s3_icustays": (stays, """SELECT o_custkey::INT AS SUBJECT_ID, o_orderkey::INT AS HADM_ID, (o_orderkey * 10 + l_linenumber)::INT AS ICUSTAY_ID, l_linestatus AS FIRST_CAREUNIT, (l_suppkey % 2)::INT AS FIRST_WARDID, floor(l_quantity)::INT AS days,
      year(o_orderdate)::INT AS year, l_quantity AS LOS FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "s4_icd_titles": (titles, "SELECT p_partkey::VARCHAR AS ICD9_CODE, p_type AS SHORT_TITLE, p_name || ', a \"b\"' AS LONG_TITLE FROM part"),
    "s5_items": (items, "SELECT p_partkey::INT AS ITEMID, p_type AS DBSOURCE FROM part"),
    "s6_diagnoses": (records, f"WITH {P.D_SQL} SELECT SUBJECT_ID::INT AS SUBJECT_ID, HADM_ID::INT AS HADM_ID, SEQ_NUM::INT AS SEQ_NUM, ICD9_CODE FROM d"),
    "s11_lenient_table": (lenient, "SELECT event_id::BIGINT AS EVENT_ID, CASE WHEN event_id % 5 <> 0 THEN user_id::INT END AS USER_ID, event_type AS EVENT_TYPE FROM events"),
    "s13_s16_s17_stored_by_subject": (stored, f"""{_T}, f AS (SELECT SUBJECT_ID, ICUSTAY_ID, any_value(LOS) * 24 AS los, min(hours) AS first FROM x GROUP BY ALL),
      y AS (SELECT SUBJECT_ID, ICUSTAY_ID, unnest(range(0, floor(los + 1e-6::DOUBLE)::BIGINT + 1))::DOUBLE AS t, los, first FROM f) SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS n, sum(los - t) AS hours FROM y WHERE t > 4 AND t >= first GROUP BY ALL"""),
    "s19_b4_flat_samples": (flat_samples, f"""{_T}, y AS (SELECT SUBJECT_ID, ICUSTAY_ID, max(hours) AS t, any_value(MORTALITY)::DOUBLE AS y FROM x WHERE LOS * 24 >= 48 AND hours < 48 + 1e-6::DOUBLE GROUP BY ALL)
      SELECT SUBJECT_ID, ICUSTAY_ID, any_value(y) AS y, nullif(count(click), 0)::INT AS clicks, round(max("view")::FLOAT::DOUBLE, 3) AS largest_view FROM y JOIN w USING (SUBJECT_ID, ICUSTAY_ID) WHERE hours < t + 1e-6::DOUBLE GROUP BY ALL"""),
    "s20_metric_history": (history, """SELECT 'r1' AS run, event_type AS split, unnest(['mae', 'rmse']) AS metric, unnest([round(avg(abs(value - 20)), 6), round(sqrt(avg(pow(value - 20, 2))), 6)]) AS value FROM events GROUP BY event_type"""),
    "s14_o5_epochs": (epochs, _epochs_sql()),
    "s21_rows_of_file": (rows_of_file, "SELECT count(*) AS n FROM orders"),
    "e7_kept_scaler": (kept_scaler, "SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 8) AS l_quantity, round((l_tax - c) / (e - c), 8) AS l_tax FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS e FROM lineitem)"),
    "e1_e5_approximate_quantiles": (approximate, f"""WITH o AS (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS i, count(*) OVER () AS n FROM lineitem)
      SELECT {_RANK.format(q=0.5)} AS centre, {_RANK.format(q=0.75)} - {_RANK.format(q=0.25)} AS scale, {_RANK.format(q=0.5)} AS median FROM o"""),
}
