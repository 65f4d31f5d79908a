"""Clinical stand-ins from the given tables, as frames and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codes import hours_between

START = "2024-01-01 00:00:00"
STAY_DAYS = 10
#: The event types, in order: the channels of a stay.
CHANNELS = ["click", "error", "purchase", "signup", "view"]
KEYS = ("SUBJECT_ID", "ICUSTAY_ID")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors reach")
    return tempfile.mkdtemp(prefix="tidemark-")


#: Batches of a stream over files that are there; each costs a look at all of the state.
BATCHES = 8


def files_a_batch(spark: SparkSession, path: str, least: int) -> int:
    """At least so many, and more where there are many files, so that the number of batches does not grow with them."""
    return max(least, -(-len(spark.read.parquet(path).inputFiles()) // BATCHES))


#: Rows of a large table that are sorted or counted in one task.
TASK_ROWS = 1_000_000


#: Events of a task in queries that make many rows of an event.
STAY_ROWS = 50_000


def tasks_for(rows: DataFrame, most: int | None = None) -> int:
    """So many tasks that each has a bounded number of the rows of a table, which is told by the files' footers."""
    return max(1, -(-rows.count() // (most or TASK_ROWS)))


def start() -> Column:
    return F.to_timestamp(F.lit(START))


def at_hours(hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start()) + (hours * 3.6e9).cast("long"))


def events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(SUBJECT_ID, ICUSTAY_ID, EVENT_ID, CHARTTIME, INTIME, hours, VARIABLE, VALUE). dealt: out to tasks by stay, of STAY_ROWS each; aggregates and joins by stay need no other exchange then."""
    e = table(spark, sf_dir, "events").withColumn("CHARTTIME", F.col("ts").cast("timestamp"))
    k = F.floor(hours_between(start(), F.col("CHARTTIME")) / (24 * STAY_DAYS))
    e = e.withColumn("k", k).withColumn("INTIME", at_hours(F.col("k") * (24 * STAY_DAYS)))
    out = e.select(
        F.col("user_id").alias("SUBJECT_ID"), (F.col("user_id") * 100 + F.col("k")).alias("ICUSTAY_ID"), F.col("event_id").alias("EVENT_ID"), "CHARTTIME", "INTIME",
        hours_between(F.col("INTIME"), F.col("CHARTTIME")).alias("hours"), F.col("event_type").alias("VARIABLE"), F.col("value").alias("VALUE"),
    )
    return out.repartition(tasks_for(table(spark, sf_dir, "events"), STAY_ROWS), *KEYS) if dealt else out


E_SQL = f"""e AS (
  SELECT user_id AS SUBJECT_ID, user_id * 100 + k AS ICUSTAY_ID, event_id AS EVENT_ID, k, (us - k * {STAY_DAYS * 86_400_000_000}) / 3.6e9 AS hours, event_type AS VARIABLE, value AS VALUE
  FROM (SELECT *, us // {STAY_DAYS * 86_400_000_000} AS k FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '{START}') AS us FROM events)))"""


def wide(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(KEYS, hours, a column for each event type): the series of the stays."""
    e = events(spark, sf_dir, dealt)
    return e.groupBy(*KEYS, "hours").agg(*(F.max(F.when(F.col("VARIABLE") == c, F.col("VALUE"))).alias(c) for c in CHANNELS))


W_SQL = f"""w AS (SELECT SUBJECT_ID, ICUSTAY_ID, hours, {", ".join(f"max(VALUE) FILTER (VARIABLE = '{c}') AS {c}" for c in CHANNELS)} FROM e GROUP BY ALL)"""


def episodic(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(KEYS, AGE, LOS in days, MORTALITY, INTIME, DEATHTIME): one row a stay; every third subject dies, at 60 to 180 hours."""
    e = events(spark, sf_dir, dealt)
    s = e.groupBy(*KEYS).agg(F.min("INTIME").alias("INTIME"))
    dies = F.col("SUBJECT_ID") % 3 == 0
    death = F.when(dies, F.timestamp_micros(F.unix_micros("INTIME") + ((F.lit(60.5) + F.col("SUBJECT_ID") % 120) * 3.6e9).cast("long")))
    los = ((F.col("ICUSTAY_ID") % 7 + 1) * 30 + F.lit(0.5)) / 24
    return s.select(*KEYS, (F.col("SUBJECT_ID") % 80 + 10).cast("double").alias("AGE"), los.alias("LOS"), dies.cast("int").alias("MORTALITY"), "INTIME", death.alias("DEATHTIME"))


P_SQL = """p AS (SELECT DISTINCT SUBJECT_ID, ICUSTAY_ID, ((ICUSTAY_ID % 7 + 1) * 30 + 0.5::DOUBLE) / 24 AS LOS, (SUBJECT_ID % 3 = 0)::INT AS MORTALITY,
  CASE WHEN SUBJECT_ID % 3 = 0 THEN 60.5::DOUBLE + SUBJECT_ID % 120 END AS death_hours FROM e)"""


def orders_as_stays(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """stays, admissions, admission_info and patients, from lineitem, orders and customer."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    day = lambda col, n: F.timestamp_micros(F.unix_micros(col.cast("timestamp")) + (n * 86_400_000_000).cast("long"))
    begun = F.col("o_orderdate").cast("timestamp")
    stays = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("HADM_ID"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("ICUSTAY_ID"),
        F.col("l_returnflag").alias("DBSOURCE"), F.col("l_linestatus").alias("FIRST_CAREUNIT"), F.col("l_linestatus").alias("LAST_CAREUNIT"),
        (F.col("l_suppkey") % 2).cast("int").alias("FIRST_WARDID"), (F.col("l_partkey") % 2).cast("int").alias("LAST_WARDID"),
        begun.alias("INTIME"), day(F.col("o_orderdate"), F.col("l_quantity").cast("long")).alias("OUTTIME"), F.col("l_quantity").alias("LOS"),
    )
    admissions = o.select(
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("HADM_ID"), begun.alias("ADMITTIME"), day(F.col("o_orderdate"), F.lit(30)).alias("DISCHTIME"),
        F.when(F.col("o_orderpriority") == "1-URGENT", day(F.col("o_orderdate"), F.lit(12))).alias("DEATHTIME"), F.col("o_orderstatus").alias("ETHNICITY"), F.lit("").alias("DIAGNOSIS"),
    )
    info = o.select(
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("HADM_ID"), F.col("o_orderpriority").alias("ADMISSION_TYPE"), F.col("o_orderstatus").alias("ADMISSION_LOCATION"),
        F.lit("HOME").alias("DISCHARGE_LOCATION"), F.lit("X").alias("INSURANCE"), F.lit(None).cast("string").alias("LANGUAGE"), F.col("o_orderstatus").alias("ETHNICITY"),
    )
    patients = c.select(
        F.col("c_custkey").alias("SUBJECT_ID"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("GENDER"),
        F.make_timestamp((1900 + F.col("c_custkey") % 120).cast("int"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).alias("DOB"),
        F.lit(None).cast("timestamp").alias("DOD"),
    )
    return {"stays": stays, "admissions": admissions, "info": info, "patients": patients}


H_SQL = """m AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY HADM_ID) AS n_stays FROM (
    SELECT o_custkey AS SUBJECT_ID, o_orderkey AS HADM_ID, o_orderkey * 10 + l_linenumber AS ICUSTAY_ID, l_returnflag AS DBSOURCE, l_linestatus AS CAREUNIT, (l_suppkey % 2)::INT AS WARDID, l_quantity AS LOS,
           o_orderpriority = '1-URGENT' AS dies, o_orderpriority, o_orderstatus, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS GENDER,
           (CASE WHEN year(o_orderdate) - (1900 + c_custkey % 120) < 0 THEN 90 ELSE year(o_orderdate) - (1900 + c_custkey % 120) END)::DOUBLE AS AGE
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_suppkey % 2 = l_partkey % 2)) WHERE n_stays = 1)"""


def lines_as_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(SUBJECT_ID, HADM_ID, SEQ_NUM, ICD9_CODE): a line of an order with its part's brand."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("HADM_ID"), F.col("l_linenumber").alias("SEQ_NUM"), F.col("p_brand").alias("ICD9_CODE")
    )


#: Phenotypes by brand, as definitions: use every second one; brands above 20 have none.
DEFINITIONS = {f"group {i}": {"use_in_benchmark": i % 2 == 0, "codes": [f"Brand#{b}" for b in range(1, 21) if b % 6 == i]} for i in range(6)}
GROUPS = sorted(n for n, d in DEFINITIONS.items() if d["use_in_benchmark"])
D_SQL = """d AS (
  SELECT o_custkey AS SUBJECT_ID, o_orderkey AS HADM_ID, o_orderkey AS ICUSTAY_ID, l_linenumber AS SEQ_NUM, p_brand AS ICD9_CODE,
         CASE WHEN substr(p_brand, 7)::INT BETWEEN 1 AND 20 THEN 'group ' || (substr(p_brand, 7)::INT % 6) END AS HCUP_CCS_2015,
         CASE WHEN substr(p_brand, 7)::INT BETWEEN 1 AND 20 THEN (substr(p_brand, 7)::INT % 2 = 0)::INT END AS USE_IN_BENCHMARK
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
