"""Queries of sources, cleaning, joins and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.catalog import proxies as P
from tidemark.functions import cleaning, codes
from tidemark.operators import extract, stats
from tidemark.sources import raw, stores


def _history(spark: SparkSession, d: str, most: int = 1) -> DataFrame:
    t = P.orders_as_stays(spark, d)
    return extract.merge_history(t["stays"], t["admissions"], t["patients"], 1, most)


def merged_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "LOS", "GENDER", "AGE")


def icu_history(spark: SparkSession, d: str) -> DataFrame:
    return extract.icu_history(_history(spark, d)).select("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "AGE", "MORTALITY_INUNIT", "MORTALITY", "MORTALITY_INHOSPITAL")


def subject_info(spark: SparkSession, d: str) -> DataFrame:
    return extract.subject_info(_history(spark, d), P.orders_as_stays(spark, d)["info"])


def processable(spark: SparkSession, d: str) -> DataFrame:
    return extract.processable(_history(spark, d), 48.0)


def _diagnoses(spark: SparkSession, d: str) -> DataFrame:
    records = P.lines_as_diagnoses(spark, d)
    titles = P.table(spark, d, "part").select(F.col("p_brand").alias("ICD9_CODE")).distinct().select("ICD9_CODE", F.upper("ICD9_CODE").alias("SHORT_TITLE"), F.concat(F.lit("of "), "ICD9_CODE").alias("LONG_TITLE"))
    history = P.table(spark, d, "orders").select(F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("HADM_ID"), F.col("o_orderkey").alias("ICUSTAY_ID"))
    return extract.diagnoses(records, titles, history, raw.phenotype_codes(spark, P.DEFINITIONS))


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    return _diagnoses(spark, d).select("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "SEQ_NUM", "ICD9_CODE", "SHORT_TITLE", "HCUP_CCS_2015", "USE_IN_BENCHMARK")


CODES = [f"Brand#{i}" for i in range(1, 26)]


def flags(spark: SparkSession, d: str) -> DataFrame:
    return extract.code_flags(_diagnoses(spark, d), CODES, prefix="d_")


def phenotypes(spark: SparkSession, d: str) -> DataFrame:
    return extract.phenotype_matrix(_diagnoses(spark, d), P.GROUPS)


def _events_of_lines(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("l_linenumber") % 3 == 1, F.col("l_orderkey")).when(F.col("l_linenumber") % 3 == 2, F.col("l_orderkey") + 1)
    return P.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("HADM_ID"), own.alias("ICUSTAY_ID"), F.col("l_partkey").alias("ITEMID"), F.col("l_linenumber").alias("LINE"),
        F.when(F.col("l_returnflag") == "A", "None").otherwise(F.col("l_quantity").cast("string")).alias("VALUE"),
    )


def recovered(spark: SparkSession, d: str) -> DataFrame:
    history = P.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("HADM_ID"), F.col("o_orderkey").alias("ICUSTAY_ID"))
    return extract.recover_stays(_events_of_lines(spark, d), history).select("HADM_ID", "ICUSTAY_ID", "ITEMID", "LINE", F.col("VALUE").try_cast("double").alias("VALUE"))


def _variable_map(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    return P.table(spark, d, "part").select(named.alias("LEVEL2"), F.col("p_partkey").alias("ITEMID"), (F.col("p_size") - 10).alias("COUNT"), F.when(F.col("p_size") % 2 == 0, "ready").otherwise("verify").alias("STATUS"), F.col("p_name").alias("MIMIC LABEL"))


def variable_map(spark: SparkSession, d: str) -> DataFrame:
    return raw.variable_map(_variable_map(spark, d))


def mapped_events(spark: SparkSession, d: str) -> DataFrame:
    joined = extract.with_variables(_events_of_lines(spark, d), raw.variable_map(_variable_map(spark, d)))
    return joined.groupBy("VARIABLE").agg(F.count(F.lit(1)).alias("n"), F.count("ICUSTAY_ID").alias("with_stay"))


def union_events(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d).withColumn("source", F.element_at(F.array(F.lit("CHART"), F.lit("LAB"), F.lit("OUTPUT")), (F.col("EVENT_ID") % 3 + 1).cast("int")))
    logs = [e.where(F.col("source") == s) for s in ("CHART", "LAB", "OUTPUT")]
    logs[1] = logs[1].drop("ICUSTAY_ID")
    return raw.union_events(logs, ["SUBJECT_ID", "ICUSTAY_ID", "EVENT_ID", "VARIABLE", "VALUE", "source"])


def pivot(spark: SparkSession, d: str, legacy: bool = False) -> DataFrame:
    e = P.events(spark, d).withColumn("day", F.floor(F.col("hours") / 24)).withColumn("VALUE", F.col("VALUE").cast("int").cast("string"))
    return extract.pivot_events(e, P.CHANNELS, ["SUBJECT_ID", "ICUSTAY_ID", "day"], legacy_order=legacy)


def _pivot_sql(legacy: bool) -> str:
    order = "v" if legacy else "v::INT"
    cols = ", ".join(f"arg_max(v, {order}) FILTER (VARIABLE = '{c}') AS {c}" for c in P.CHANNELS)
    return f"WITH {P.E_SQL} SELECT SUBJECT_ID, ICUSTAY_ID, day, {cols} FROM (SELECT *, floor(hours / 24)::BIGINT AS day, trunc(VALUE)::INT::VARCHAR AS v FROM e) GROUP BY ALL"


def _line_series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, li = P.table(spark, d, "orders"), P.table(spark, d, "lineitem")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("SUBJECT_ID"), F.col("l_orderkey").alias("ICUSTAY_ID"), F.col("l_shipdate").cast("timestamp").alias("CHARTTIME"), "l_quantity")
    begun = F.col("o_orderdate").cast("timestamp")
    stays = o.select(F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("ICUSTAY_ID"), begun.alias("INTIME"), F.timestamp_micros(F.unix_micros(begun) + F.lit(60 * 86_400_000_000)).alias("OUTTIME"))
    return rows, stays


def episodes(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.hour_index(extract.episodes(*_line_series(spark, d), row=[], days=60.0))
    return rows.groupBy("SUBJECT_ID", "ICUSTAY_ID").agg(F.count(F.lit(1)).alias("n"), F.min("hours").alias("first"), F.max("hours").alias("last"), F.sum("l_quantity").alias("quantity"))


def series_with_stays(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d).withColumn("CHARTTIME", F.date_trunc("hour", "CHARTTIME")).withColumn("VALUE", F.col("VALUE").cast("string"))
    wide = extract.series_with_stays(e, P.CHANNELS)
    return wide.select("SUBJECT_ID", "ICUSTAY_ID", codes.hours_between(P.start(), F.col("CHARTTIME")).alias("hour"), *(F.col(c).try_cast("double").alias(c) for c in P.CHANNELS))


def first_value(spark: SparkSession, d: str) -> DataFrame:
    return extract.first_value(P.wide(spark, d), "purchase")


def static_join(spark: SparkSession, d: str) -> DataFrame:
    ep = P.episodic(spark, d).select(*P.KEYS, "AGE", "LOS", "MORTALITY")
    info = P.table(spark, d, "customer").join(ep.select(*P.KEYS), F.col("c_custkey") == F.col("SUBJECT_ID")).select("SUBJECT_ID", "ICUSTAY_ID", F.col("c_mktsegment").alias("INSURANCE"))
    return extract.split_info(ep, info)


def status(spark: SparkSession, d: str) -> DataFrame:
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("SUBJECT_ID"))
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("SUBJECT_ID"), "o_orderpriority")
    requested = c.select((F.col("SUBJECT_ID") * 2).alias("SUBJECT_ID"))
    return extract.subject_status(requested, c, o, o.where("o_orderpriority = '1-URGENT'"))


def refilled(spark: SparkSession, d: str) -> DataFrame:
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("SUBJECT_ID"))
    e = P.events(spark, d).where("VARIABLE = 'purchase'")
    return extract.first_with_samples(c, e, 40)


def capped(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d).withColumnRenamed("VARIABLE", "source")
    return extract.cap_samples(e, 1003).select("EVENT_ID", "source")


def complete(spark: SparkSession, d: str) -> DataFrame:
    c = P.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("SUBJECT_ID"))
    o = P.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("SUBJECT_ID"))
    e = P.events(spark, d).where("VARIABLE = 'error' AND VALUE > 20")
    return stores.common_subjects([c, o, e])


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return stores.sample_subjects(P.table(spark, d, "customer").select(F.col("c_custkey").alias("SUBJECT_ID")), 50, skip=25)


def stage_subjects(spark: SparkSession, d: str) -> DataFrame:
    info = P.table(spark, d, "customer").select(F.col("c_custkey").alias("SUBJECT_ID"), "c_mktsegment")
    return stores.stage_subjects(info, P.events(spark, d))


def difference(spark: SparkSession, d: str) -> DataFrame:
    li = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return extract.difference(li.where("l_linenumber <= 3"), li.where("l_linenumber >= 3").withColumn("l_quantity", F.col("l_quantity").cast("double")), P.tasks_for(li))


def converted(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"EVENT_ID": "int", "USER_ID": "short", "VALUE": "float", "PROPS": "double", "EVENT_TYPE": "string"}
    return raw.converted(raw.upper_case(P.table(spark, d, "events")), kinds, lenient=True).select("EVENT_ID", "USER_ID", F.col("VALUE").cast("double").alias("VALUE"), "PROPS", "EVENT_TYPE")


_AS = {"click": "Temperature", "error": "Oxygen saturation", "purchase": "Weight", "signup": "Height", "view": "Fraction inspired oxygen"}


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in _AS.items() for x in kv))
    unit = F.element_at(F.array(F.lit("F"), F.lit("lb"), F.lit("oz"), F.lit("torr"), F.lit("inches")), (F.col("EVENT_ID") % 5 + 1).cast("int"))
    e = P.events(spark, d).select("EVENT_ID", F.element_at(names, F.col("VARIABLE")).alias("VARIABLE"), F.when(F.col("EVENT_ID") % 11 != 0, F.col("VALUE").cast("string")).alias("VALUE"), F.when(F.col("EVENT_ID") % 7 != 0, unit).alias("VALUEUOM"))
    return cleaning.clean(e).select("EVENT_ID", "VARIABLE", F.col("VALUE").try_cast("double").alias("VALUE"), "VALUEUOM")


CLEAN_SQL = f"""
WITH {P.E_SQL},
u AS (SELECT EVENT_ID, VARIABLE, VALUE AS v, CASE WHEN EVENT_ID % 7 = 0 THEN '' ELSE ['F', 'lb', 'oz', 'torr', 'inches'][(EVENT_ID % 5 + 1)::INT] END AS uom FROM e WHERE EVENT_ID % 11 <> 0)
SELECT EVENT_ID, CASE VARIABLE {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS.items())} END AS VARIABLE, uom AS VALUEUOM,
  CASE VARIABLE WHEN 'click' THEN CASE WHEN uom = 'F' OR v >= 79 THEN (v - 32) * 5 / 9 ELSE v END
    WHEN 'error' THEN CASE WHEN v <= 1 THEN v * 100 ELSE v END
    WHEN 'purchase' THEN CASE uom WHEN 'oz' THEN v / 16 * 0.453592::DOUBLE WHEN 'lb' THEN v * 0.453592::DOUBLE ELSE v END
    WHEN 'signup' THEN CASE WHEN uom = 'inches' THEN round_even(v * 2.54::DOUBLE, 0) ELSE v END
    ELSE CASE WHEN uom = 'torr' THEN v ELSE v / 100 END END AS VALUE
FROM u"""


_TEXTS = {"click": "Systolic blood pressure", "error": "Diastolic blood pressure", "purchase": "Capillary refill rate", "signup": "Respiratory rate", "view": "Glucose"}
REFILLS = ["Normal <3 secs", "Brisk", "Abnormal >3 secs", "Delayed", "Comfortable"]


def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pressures as pairs, capillary refill and breath rates as words, and laboratory values that are not all numbers."""
    names = F.create_map(*(F.lit(x) for kv in _TEXTS.items() for x in kv))
    n, i = F.floor("VALUE").cast("string"), F.col("EVENT_ID")
    pair = F.when(i % 3 != 0, F.concat(n, F.lit("/"), F.floor(F.col("VALUE") / 2).cast("string"))).when(i % 2 == 0, n).otherwise("n/a")
    refill = F.element_at(F.array(*map(F.lit, REFILLS)), (i % 5 + 1).cast("int"))
    breath = F.when(i % 4 == 0, ">60/min retracts").when(i % 4 == 1, ">60/minute").when(i % 4 == 2, n).otherwise("fast")
    of = F.when(F.col("VARIABLE").isin("click", "error"), pair).when(F.col("VARIABLE") == "purchase", refill).when(F.col("VARIABLE") == "signup", breath).otherwise(F.when(i % 3 == 0, F.concat(n, F.lit(" mg"))).otherwise(n))
    e = P.events(spark, d).select("EVENT_ID", F.element_at(names, F.col("VARIABLE")).alias("NAME"), of.alias("VALUE"), F.lit(None).cast("string").alias("VALUEUOM"))
    return cleaning.clean(e.withColumnRenamed("NAME", "VARIABLE")).select("EVENT_ID", "VARIABLE", F.col("VALUE").try_cast("double").alias("VALUE"))


TEXTS_SQL = f"""
WITH {P.E_SQL}, u AS (SELECT EVENT_ID, VARIABLE, floor(VALUE)::DOUBLE AS n, floor(VALUE / 2)::DOUBLE AS h FROM e)
SELECT * FROM (SELECT EVENT_ID, CASE VARIABLE {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TEXTS.items())} END AS VARIABLE,
  CASE WHEN VARIABLE IN ('click', 'error') THEN CASE WHEN EVENT_ID % 3 <> 0 THEN CASE VARIABLE WHEN 'click' THEN n ELSE h END WHEN EVENT_ID % 2 = 0 THEN n END
    WHEN VARIABLE = 'purchase' THEN CASE EVENT_ID % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 1.0::DOUBLE END
    WHEN VARIABLE = 'signup' THEN CASE EVENT_ID % 4 WHEN 0 THEN 60.0::DOUBLE WHEN 1 THEN 60.0::DOUBLE WHEN 2 THEN n END
    WHEN EVENT_ID % 3 <> 0 THEN n END AS VALUE FROM u) WHERE VALUE IS NOT NULL"""


def episodic(spark: SparkSession, d: str) -> DataFrame:
    """Static data of each stay that has a flagged event: codes, first height and weight, and a flag for each event type of a high value."""
    sex = F.element_at(F.array(F.lit("F"), F.lit("M"), F.lit("X"), F.lit("")), (F.col("SUBJECT_ID") % 4 + 1).cast("int"))
    told = F.element_at(F.array(F.lit("WHITE - RUSSIAN"), F.lit("ASIAN"), F.lit("MARTIAN")), (F.col("SUBJECT_ID") % 3 + 1).cast("int"))
    history = P.episodic(spark, d).select(*P.KEYS, "AGE", "LOS", "MORTALITY", sex.alias("GENDER"), told.alias("ETHNICITY"))
    series = P.wide(spark, d).withColumnsRenamed({"click": "Height", "view": "Weight"})
    high = P.events(spark, d).where("VALUE > 30").select("ICUSTAY_ID", F.col("VARIABLE").alias("ICD9_CODE"))
    return extract.episodic_data(history, series, extract.code_flags(high, P.CHANNELS, prefix="d_"))


EPISODIC_SQL = f"""
WITH {P.E_SQL}, {P.W_SQL}, {P.P_SQL}, g AS (SELECT ICUSTAY_ID, {", ".join(f"max((VARIABLE = '{c}')::INT) AS d_{c}" for c in P.CHANNELS)} FROM e WHERE VALUE > 30 GROUP BY 1),
f AS (SELECT SUBJECT_ID, ICUSTAY_ID, arg_min(click, hours) FILTER (click IS NOT NULL) AS "Height", arg_min("view", hours) FILTER ("view" IS NOT NULL) AS "Weight" FROM w GROUP BY ALL)
SELECT SUBJECT_ID, ICUSTAY_ID, (SUBJECT_ID % 80 + 10)::DOUBLE AS AGE, LOS, MORTALITY, [1, 2, 3, 0][(SUBJECT_ID % 4 + 1)::INT] AS GENDER, [4, 1, 5][(SUBJECT_ID % 3 + 1)::INT] AS ETHNICITY, "Height", "Weight", {", ".join(f"d_{c}" for c in P.CHANNELS)}
FROM p JOIN f USING (SUBJECT_ID, ICUSTAY_ID) JOIN g USING (ICUSTAY_ID)"""


def grouped(spark: SparkSession, d: str) -> DataFrame:
    """Each event's place among its subject's rows, as they lie in one task after grouping."""
    rows = extract.by_subject(P.events(spark, d).select("SUBJECT_ID", "CHARTTIME", "EVENT_ID"), ["CHARTTIME", "EVENT_ID"]).withColumn("_at", F.monotonically_increasing_id())
    w = Window.partitionBy("SUBJECT_ID")
    place = F.row_number().over(w.orderBy("_at"))
    tasks = F.size(F.collect_set(F.shiftright("_at", 33)).over(w))
    return rows.select("SUBJECT_ID", "EVENT_ID", place.alias("place"), tasks.alias("tasks"))


def scalar_codes(spark: SparkSession, d: str) -> DataFrame:
    li = P.table(spark, d, "lineitem")
    h = F.col("l_quantity") * 24
    return li.select(
        "l_orderkey", "l_linenumber", codes.custom_bin(h).alias("custom"), codes.log_bin(h).alias("logarithmic"), codes.bin_mean(codes.custom_bin(h)).alias("mean_hours"),
        codes.bin_index(F.col("l_quantity"), [10, 20, 30]).alias("digitized"), F.array_position(codes.one_hot(codes.custom_bin(h), 10), 1).cast("int").alias("hot"),
        codes.arg_max(F.array("l_discount", "l_tax", F.lit(0.045))).alias("largest"),
    )


CODES_SQL = f"""
SELECT l_orderkey, l_linenumber, custom, logarithmic, [{", ".join(f"{m}::DOUBLE" for m in codes.LOS_MEANS)}][custom + 1] AS mean_hours, len([b FOR b IN [10, 20, 30] IF b <= l_quantity]) AS digitized, custom + 1 AS hot,
  CASE WHEN l_discount >= l_tax AND l_discount >= 0.045::DOUBLE THEN 0 WHEN l_tax >= 0.045::DOUBLE THEN 1 ELSE 2 END AS largest
FROM (SELECT *, len([b FOR b IN {[24 * x for x in codes.LOS_DAYS]} IF b <= l_quantity * 24]) AS custom, least(9, greatest(0, round_even(ln(l_quantity * 24 + 1) / 8.0 * 10, 0)))::INT AS logarithmic FROM lineitem)"""


def demographic_codes(spark: SparkSession, d: str) -> DataFrame:
    c = P.table(spark, d, "customer")
    told = F.element_at(F.array(F.lit("WHITE - RUSSIAN"), F.lit("BLACK/CAPE VERDEAN"), F.lit("HISPANIC OR LATINO"), F.lit("ASIAN"), F.lit("MARTIAN"), F.lit("")), (F.col("c_custkey") % 6 + 1).cast("int"))
    sex = F.element_at(F.array(F.lit("F"), F.lit("M"), F.lit("X"), F.lit("")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", codes.ethnicity_code(told).alias("ethnicity"), codes.gender_code(sex).alias("gender"))


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    return stats.rows_by_source(P.events(spark, d), "VARIABLE")


def source_times(spark: SparkSession, d: str) -> DataFrame:
    e = P.events(spark, d).withColumn("day", F.floor(codes.hours_between(P.start(), F.col("CHARTTIME")) / 24))
    return stats.times_by_source(e, "VARIABLE", "day", ["SUBJECT_ID"])


_M = f"WITH {P.H_SQL}"
_D = f"WITH {P.D_SQL}"
_E = f"WITH {P.E_SQL}"
_ORDER = "('0x' || substr(md5('42|' || SUBJECT_ID::VARCHAR), 1, 7))::BIGINT"

ENTRIES = {
    "j1_j2_j3_p6_a1_f12_merged_history": (merged_history, f"{_M} SELECT SUBJECT_ID, HADM_ID, ICUSTAY_ID, LOS, GENDER, AGE FROM m"),
    "p7_f13_f14_icu_history": (icu_history, f"{_M} SELECT SUBJECT_ID, HADM_ID, ICUSTAY_ID, AGE, (dies AND LOS >= 12)::INT AS MORTALITY_INUNIT, dies::INT AS MORTALITY, dies::INT AS MORTALITY_INHOSPITAL FROM m WHERE AGE >= 18"),
    "s2_subject_info": (subject_info, f"{_M} SELECT SUBJECT_ID, ICUSTAY_ID, DBSOURCE, CAREUNIT, WARDID, o_orderpriority AS ADMISSION_TYPE, o_orderstatus AS ADMISSION_LOCATION, 'HOME' AS DISCHARGE_LOCATION, 'X' AS INSURANCE, NULL::VARCHAR AS LANGUAGE, o_orderstatus AS ETHNICITY, GENDER, AGE FROM m"),
    "p9_processable_subjects": (processable, f"{_M} SELECT DISTINCT SUBJECT_ID FROM m WHERE LOS >= (48 + 1e-6::DOUBLE) / 24"),
    "j4_j5_j6_s10_diagnoses": (diagnoses, f"{_D} SELECT SUBJECT_ID, HADM_ID, ICUSTAY_ID, SEQ_NUM, ICD9_CODE, upper(ICD9_CODE) AS SHORT_TITLE, HCUP_CCS_2015, USE_IN_BENCHMARK FROM d"),
    "a2_diagnosis_flags": (flags, f"{_D} SELECT ICUSTAY_ID, {', '.join(f'max((ICD9_CODE = {chr(39)}{c}{chr(39)})::INT) AS {chr(34)}d_{c}{chr(34)}' for c in CODES)} FROM d GROUP BY 1"),
    "a3_phenotype_matrix": (phenotypes, f"{_D} SELECT ICUSTAY_ID, {', '.join(f'max((HCUP_CCS_2015 = {chr(39)}{g}{chr(39)})::INT) AS {chr(34)}{g}{chr(34)}' for g in P.GROUPS)} FROM d WHERE USE_IN_BENCHMARK = 1 GROUP BY 1"),
    "j7_p4_p5_recover_stays": (recovered, """SELECT l_orderkey AS HADM_ID, l_orderkey AS ICUSTAY_ID, l_partkey AS ITEMID, l_linenumber AS LINE, CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS VALUE
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber < 7 AND l_linenumber % 3 <> 2"""),
    "s9_variable_map": (variable_map, "SELECT p_partkey::INT AS ITEMID, p_type AS VARIABLE, p_name AS MIMIC_LABEL FROM part WHERE p_size % 5 <> 0 AND p_size > 10 AND p_size % 2 = 0"),
    "j8_events_with_variables": (mapped_events, """SELECT p_type AS VARIABLE, count(*) AS n, count(*) FILTER (l_linenumber % 3 <> 0) AS with_stay FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE p_size % 5 <> 0 AND p_size > 10 AND p_size % 2 = 0 GROUP BY 1"""),
    "s7_o6_union_events": (union_events, f"{_E} SELECT SUBJECT_ID, CASE WHEN EVENT_ID % 3 <> 1 THEN ICUSTAY_ID END AS ICUSTAY_ID, EVENT_ID, VARIABLE, VALUE, ['CHART', 'LAB', 'OUTPUT'][(EVENT_ID % 3 + 1)::INT] AS source FROM e"),
    "a4_w2_pivot_numeric": (pivot, _pivot_sql(False)),
    "a4_pivot_legacy_order": (lambda spark, d: pivot(spark, d, True), _pivot_sql(True)),
    "j9_a5_series_with_stays": (series_with_stays, f"""{_E}, h AS (SELECT *, floor(k * 240 + hours)::DOUBLE AS hour FROM e),
      v AS (SELECT SUBJECT_ID, hour, {', '.join(f"max(VALUE) FILTER (VARIABLE = '{c}') AS {c}" for c in P.CHANNELS)} FROM h GROUP BY ALL)
      SELECT v.*, s.ICUSTAY_ID FROM v JOIN (SELECT DISTINCT SUBJECT_ID, hour, ICUSTAY_ID FROM h) s USING (SUBJECT_ID, hour)"""),
    "j10_w1_episodes": (episodes, """WITH r AS (SELECT o_custkey AS SUBJECT_ID, l_orderkey AS own, l_linenumber, l_shipdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT SUBJECT_ID, o_orderkey AS ICUSTAY_ID, count(*) AS n, min(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS first, max(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9 AS last, sum(l_quantity) AS quantity
      FROM r JOIN orders ON o_custkey = SUBJECT_ID WHERE own = o_orderkey OR l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY ALL"""),
    "a6_first_value": (first_value, f"{_E}, {P.W_SQL} SELECT SUBJECT_ID, ICUSTAY_ID, arg_min(purchase, hours) AS purchase FROM w WHERE purchase IS NOT NULL GROUP BY ALL"),
    "j12_split_info": (static_join, f"{_E}, {P.P_SQL} SELECT SUBJECT_ID, ICUSTAY_ID, (SUBJECT_ID % 80 + 10)::DOUBLE AS AGE, LOS, MORTALITY, c_mktsegment AS INSURANCE FROM p JOIN customer ON c_custkey = SUBJECT_ID"),
    "p10_j18_o7_subject_status": (status, """SELECT c_custkey * 2 AS SUBJECT_ID, CASE WHEN c_custkey * 2 NOT IN (SELECT c_custkey FROM customer) THEN 'unknown' WHEN c_custkey * 2 NOT IN (SELECT o_custkey FROM orders) THEN 'unprocessable'
      WHEN c_custkey * 2 IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'done' ELSE 'open' END AS status FROM customer"""),
    "p11_p12_first_with_samples": (refilled, f"{_E} SELECT SUBJECT_ID FROM (SELECT DISTINCT SUBJECT_ID FROM e JOIN customer ON c_custkey = SUBJECT_ID WHERE VARIABLE = 'purchase') ORDER BY {_ORDER}, SUBJECT_ID LIMIT 40"),
    "p16_capped_samples": (capped, f"""{_E}, n AS (SELECT VARIABLE, count(*) AS r FROM e GROUP BY 1), k AS (SELECT VARIABLE, floor(r * 1003 / sum(r) OVER ()) AS k, row_number() OVER (ORDER BY VARIABLE) AS i FROM n),
      q AS (SELECT VARIABLE, k + (i <= 1003 - sum(k) OVER ())::INT AS k FROM k), t AS (SELECT *, dense_rank() OVER (PARTITION BY VARIABLE ORDER BY k * 240 + hours) AS place FROM e)
      SELECT EVENT_ID, VARIABLE AS source FROM t JOIN q USING (VARIABLE) WHERE place <= q.k"""),
    "j19_s16_complete_subjects": (complete, f"{_E} SELECT DISTINCT c_custkey AS SUBJECT_ID FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey IN (SELECT SUBJECT_ID FROM e WHERE VARIABLE = 'error' AND VALUE > 20)"),
    "s12_s14_o4_sampled_subjects": (sampled, f"SELECT SUBJECT_ID FROM (SELECT c_custkey AS SUBJECT_ID FROM customer) ORDER BY {_ORDER}, SUBJECT_ID LIMIT 50 OFFSET 25"),
    "s18_p8_stage_subjects": (stage_subjects, "SELECT c_custkey AS SUBJECT_ID, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"),
    "o8_difference": (difference, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 3"),
    "p1_p2_p3_converted": (converted, "SELECT event_id::INT AS EVENT_ID, user_id::SMALLINT AS USER_ID, value::FLOAT::DOUBLE AS VALUE, NULL::DOUBLE AS PROPS, event_type AS EVENT_TYPE FROM events"),
    "f1_f2_f6_f8_f9_f10_p13_cleaned": (cleaned, CLEAN_SQL),
    "f3_f4_f5_f7_f11_cleaned_texts": (cleaned_texts, TEXTS_SQL),
    "j11_episodic_data": (episodic, EPISODIC_SQL),
    "o1_o2_by_subject": (grouped, "SELECT user_id AS SUBJECT_ID, event_id AS EVENT_ID, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place, 1 AS tasks FROM events"),
    "f17_f21_codes": (scalar_codes, CODES_SQL),
    "f15_f16_demographic_codes": (demographic_codes, "SELECT c_custkey, [4, 2, 3, 1, 5, 0][(c_custkey % 6 + 1)::INT] AS ethnicity, [1, 2, 3, 0][(c_nationkey % 4 + 1)::INT] AS gender FROM customer"),
    "a14_rows_by_source": (source_rows, "SELECT event_type AS VARIABLE, count(*) AS n FROM events GROUP BY 1"),
    "a11_times_by_source": (source_times, f"{_E} SELECT VARIABLE, SUBJECT_ID, count(DISTINCT floor((k * 240 + hours) / 24)) AS n FROM e GROUP BY ALL"),
}
