"""The whole run over the given tables, written as raw CSV tables: an order is an admission with one stay, its lines are events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import proxies as P
from tidemark.plans import pipeline

DEFINITIONS = {"A": {"use_in_benchmark": True, "codes": ["001"]}}
VARMAP = [("Heart Rate", "1", "5", "ready", "HR"), ("pH", "2", "5", "ready", "pH"), ("", "3", "5", "ready", "x")]


def _later(hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (hours * 3_600_000_000).cast("long"))


def _source(spark: SparkSession, d: str) -> str:
    """Stays of one to five days; a line's event comes seven hours after the one before, every third without its stay, and those of item 2 are in the other log."""
    folder, o, li = P.folder(spark), P.table(spark, d, "orders"), P.table(spark, d, "lineitem")
    days = F.col("o_orderkey") % 5 + 1
    keys = [F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderkey").alias("icustay_id")]
    none = F.lit(None).cast("string")
    events = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *keys[:2], F.when(F.col("l_linenumber") % 3 != 0, F.col("o_orderkey")).alias("icustay_id"), _later(F.col("l_linenumber") * 7).alias("charttime"), (F.col("l_linenumber") % 4 + 1).alias("itemid"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.lit("x").alias("valueuom")
    )
    tables = {
        "PATIENTS": P.table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.lit("F").alias("gender"), F.lit("1940-06-01 00:00:00").alias("dob"), none.alias("dod")),
        "ADMISSIONS": o.select(*keys[:2], _later(F.lit(0)).alias("admittime"), _later(F.lit(240)).alias("dischtime"), F.when(F.col("o_orderpriority") == "1-URGENT", _later(F.lit(20))).alias("deathtime"), *(F.lit("X").alias(c) for c in ("ethnicity", "diagnosis", "admission_type", "admission_location", "discharge_location", "insurance", "language"))),
        "ICUSTAYS": o.select(*keys, F.lit("cv").alias("dbsource"), F.lit("A").alias("first_careunit"), F.lit("A").alias("last_careunit"), F.lit(1).alias("first_wardid"), F.lit(1).alias("last_wardid"), _later(F.lit(0)).alias("intime"), _later(days * 24).alias("outtime"), days.cast("double").alias("los")),
        "D_ICD_DIAGNOSES": spark.createDataFrame([("001", "a", "b")], "icd9_code string, short_title string, long_title string"),
        "DIAGNOSES_ICD": o.select(*keys[:2], F.lit(1).alias("seq_num"), F.lit("001").alias("icd9_code")),
        "CHARTEVENTS": events.where("itemid <> 2"),
        "LABEVENTS": events.where("itemid = 2").drop("icustay_id"),
        "OUTPUTEVENTS": events.limit(0),
        "varmap": spark.createDataFrame(VARMAP, "LEVEL2 string, ITEMID string, COUNT string, STATUS string, `MIMIC LABEL` string"),
    }
    for name, t in tables.items():
        text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kind == "timestamp" else F.col(f"`{c}`") for c, kind in t.dtypes]
        t.select(*text).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    return folder


def loaded(spark: SparkSession, d: str) -> DataFrame:
    """Samples and labels of in-hospital mortality, in one storage from two runs: some subjects, and then the others."""
    source = _source(spark, d)
    some = [r["c_custkey"] for r in P.table(spark, d, "customer").where("c_custkey <= 20").select("c_custkey").collect()]
    run = lambda **k: pipeline.load_data(spark, source, f"{source}/out", DEFINITIONS, f"{source}/varmap.csv", task="IHM", preprocess=True, **k)
    run(subject_ids=some)
    out = run()
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    x = out["X"].groupBy("SUBJECT_ID", "ICUSTAY_ID").agg(F.count(F.lit(1)).alias("rows"), F.max("hours").alias("last"), F.sum(number("Heart Rate")).alias("rate"), F.sum(number("pH")).alias("ph"))
    return x.hint("merge").join(out["y"].select("SUBJECT_ID", "ICUSTAY_ID", F.col("y").cast("int").alias("y")), ["SUBJECT_ID", "ICUSTAY_ID"])


ENTRIES = {
    "r8_r4_load_data": (loaded, """WITH s AS (SELECT o_custkey::INT AS SUBJECT_ID, o_orderkey::INT AS ICUSTAY_ID, o_orderdate::TIMESTAMP AS a, o_orderkey % 5 + 1 AS days, (o_orderpriority = '1-URGENT')::INT AS y FROM orders),
      e AS (SELECT SUBJECT_ID, ICUSTAY_ID, a + to_hours(l_linenumber * 7) AS t, l_linenumber % 4 + 1 AS item, floor(l_quantity)::DOUBLE AS v FROM lineitem JOIN s ON l_orderkey = ICUSTAY_ID WHERE l_linenumber % 4 < 2),
      w AS (SELECT SUBJECT_ID, t, max(v) FILTER (item = 1) AS rate, max(v) FILTER (item = 2) AS ph FROM e GROUP BY ALL),
      k AS (SELECT DISTINCT SUBJECT_ID, t, s.ICUSTAY_ID, a, days, y FROM e JOIN s USING (SUBJECT_ID) WHERE e.ICUSTAY_ID = s.ICUSTAY_ID OR t BETWEEN a AND a + to_days(days::INT)),
      x AS (SELECT k.*, rate, ph, (epoch_us(t) - epoch_us(a)) / 3.6e9 AS hours FROM k JOIN w USING (SUBJECT_ID, t))
      SELECT SUBJECT_ID, ICUSTAY_ID, count(*) AS rows, max(hours) AS last, sum(rate) AS rate, sum(ph) AS ph, any_value(y) AS y FROM x WHERE SUBJECT_ID IN (SELECT SUBJECT_ID FROM s WHERE days > 2) AND days * 24 >= 48 AND hours > -1e-6::DOUBLE AND hours < 48 + 1e-6::DOUBLE AND hours < days * 24 + 1e-6::DOUBLE GROUP BY 1, 2"""),
}
