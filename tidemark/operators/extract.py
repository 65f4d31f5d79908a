"""From relational records and an event log to stays, diagnoses and wide series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import codes

STAY = ["SUBJECT_ID", "HADM_ID", "ICUSTAY_ID"]


def whole_stays(stays: DataFrame) -> DataFrame:
    """Stays without a transfer of unit or ward; unknown ones go."""
    return stays.where("FIRST_CAREUNIT = LAST_CAREUNIT AND FIRST_WARDID = LAST_WARDID")


def with_stay_count(stays: DataFrame, least: int = 1, most: int = 1, key: str = "HADM_ID") -> DataFrame:
    """Stays of admissions that have from least to most stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return stays.withColumn("_n", n).where(F.col("_n").between(least, most)).drop("_n")


def merge_history(stays: DataFrame, admissions: DataFrame, patients: DataFrame, least: int = 1, most: int = 1) -> DataFrame:
    """Stays with their admission and patient; AGE at the stay's begin."""
    joined = whole_stays(stays).join(admissions, ["SUBJECT_ID", "HADM_ID"]).join(patients, "SUBJECT_ID")
    return with_stay_count(joined, least, most).withColumn("AGE", codes.age(F.col("INTIME"), F.col("DOB")))


def icu_history(merged: DataFrame, adult: int = 18) -> DataFrame:
    """adults' stays with mortality in the unit and in the hospital."""
    deaths = (F.col("DOD"), F.col("DEATHTIME"))
    in_unit = codes.died_within(F.col("INTIME"), F.col("OUTTIME"), *deaths)
    in_hospital = codes.died_within(F.col("ADMITTIME"), F.col("DISCHTIME"), *deaths)
    return merged.where(F.col("AGE") >= adult).withColumns({"MORTALITY_INUNIT": in_unit, "MORTALITY": in_hospital, "MORTALITY_INHOSPITAL": in_hospital})


def subject_info(merged: DataFrame, admission_info: DataFrame | None = None) -> DataFrame:
    """Demographics of each stay, for splitting; minors stay in. Without admission_info merged has them already."""
    cols = ["SUBJECT_ID", "ICUSTAY_ID", "DBSOURCE", "CAREUNIT", "WARDID", "ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "LANGUAGE", "ETHNICITY", "GENDER", "AGE"]
    info = merged
    if admission_info is not None:
        info = merged.drop(*[c for c in admission_info.columns if c in merged.columns and c not in ("SUBJECT_ID", "HADM_ID")])
        info = info.join(admission_info, ["SUBJECT_ID", "HADM_ID"])
    return info.withColumnsRenamed({"FIRST_CAREUNIT": "CAREUNIT", "FIRST_WARDID": "WARDID"}).select(*cols)


def diagnoses(records: DataFrame, titles: DataFrame, history: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Diagnoses of the stays in history, with titles and phenotype (null where a code has none)."""
    stays = history.select(*STAY).distinct()
    told = records.join(titles, "ICD9_CODE").join(stays, ["SUBJECT_ID", "HADM_ID"])
    return told.join(phenotypes.select("ICD9_CODE", F.col("phenotype").alias("HCUP_CCS_2015"), F.col("use_in_benchmark").cast("int").alias("USE_IN_BENCHMARK")), "ICD9_CODE", "left")


def recover_stays(events: DataFrame, history: DataFrame, value: str = "VALUE", strange: str | None = None) -> DataFrame:
    """Events of known admissions, with the stay filled in where it is missing; those of another stay go. strange: adds a column of this name, whether an event names another subject than its stay does, or none."""
    known = history.select("HADM_ID", F.col("ICUSTAY_ID").alias("_stay"), *([F.col("SUBJECT_ID").alias("_subject")] if strange else [])).distinct()
    joined = events.where(F.col("HADM_ID").isNotNull()).join(known, "HADM_ID").where("ICUSTAY_ID IS NULL OR ICUSTAY_ID = _stay")
    filled = joined.withColumn("ICUSTAY_ID", F.col("_stay")).withColumn(value, F.nullif(F.col(value), F.lit("None")))
    return filled.select(*events.columns, *([(~F.col("SUBJECT_ID").eqNullSafe(F.col("_subject"))).alias(strange)] if strange else []))


def with_variables(events: DataFrame, variables: DataFrame) -> DataFrame:
    """Events of mapped items, with their variable and label."""
    return events.join(variables, "ITEMID")


def value_order(value: Column, legacy: bool = False) -> Column:
    """What makes a text value the larger one: its number, before which any other text comes; by text alone if legacy."""
    return F.struct(value) if legacy else F.struct(value.try_cast("double").isNotNull(), value.try_cast("double"), value)


def pivot_events(events: DataFrame, variables: Sequence[str], by: Sequence[str] = ("SUBJECT_ID", "CHARTTIME"), name: str = "VARIABLE", value: str = "VALUE", legacy_order: bool = False) -> DataFrame:
    """One row for each time and a column for each variable, with the largest of its values.

    Each variable's largest value is found first, and only one narrow row of it is shuffled; columns are made last.
    """
    told = F.struct(value_order(F.col(value), legacy_order).alias("order"), F.col(value).alias("value"))
    largest = events.where(F.col(value).isNotNull()).groupBy(*by, name).agg(F.max(told).alias("_largest"))
    own = F.when(F.col(name).isNotNull(), F.struct(F.col(name), F.col("_largest.value")))
    rows = largest.groupBy(*by).agg(F.map_from_entries(F.collect_list(own)).alias("_told"))
    return rows.select(*by, *(F.try_element_at("_told", F.lit(v)).alias(v) for v in variables))


def series_with_stays(events: DataFrame, variables: Sequence[str], legacy_order: bool = False) -> DataFrame:
    """The wide series by subject and time, joined to the stays that have an event then."""
    wide = pivot_events(events, variables, legacy_order=legacy_order)
    return wide.join(events.select("SUBJECT_ID", "CHARTTIME", "ICUSTAY_ID").distinct(), ["SUBJECT_ID", "CHARTTIME"])


def episodes(series: DataFrame, stays: DataFrame, time: str = "CHARTTIME", row: Sequence[str] | None = None, days: float = 7.0) -> DataFrame:
    """Rows of each stay: those with its id, or within [INTIME, OUTTIME]. A row may belong to several stays.

    A row looks for its stays under its stay's id and under the span of `days` that it lies in, and a stay is put under
    its id and all its spans: one equi-join, in which the rows of a subject are spread over its stays and time. `days` is best
    about the length of a stay, which then is put under two spans or so. `row`
    names the columns that tell a subject's rows apart, whatever stay they name (by default the time, as in a pivoted
    series): of equal ones one stays in a stay. Where it is empty every row is one of its own, equal ones too.
    """
    span = lambda c: F.floor(F.unix_micros(c) / F.lit(days * 86_400_000_000)).cast("long")
    look = lambda by, at: F.struct(F.lit(by).alias("_by"), at.cast("long").alias("_at"))
    s = stays.select("SUBJECT_ID", F.col("ICUSTAY_ID").alias("_stay"), "INTIME", "OUTTIME").distinct()
    spans = F.when(F.col("INTIME") <= F.col("OUTTIME"), F.transform(F.sequence(span("INTIME"), span("OUTTIME")), lambda x: look("time", x)))
    put = s.withColumn("_put", F.explode(F.concat(F.array(look("id", F.col("_stay"))), F.coalesce(spans, F.array().cast("array<struct<_by:string,_at:bigint>>")))))
    own = series.withColumn("_put", F.explode(F.array(look("id", F.col("ICUSTAY_ID")), look("time", span(time)))))
    inside = F.col(time).between(F.col("INTIME"), F.col("OUTTIME")) & ~F.col("ICUSTAY_ID").eqNullSafe(F.col("_stay"))
    met = own.join(put, ["SUBJECT_ID", "_put"]).where((F.col("_put._by") == "id") | inside)
    rows = met.withColumn("ICUSTAY_ID", F.col("_stay")).drop("_stay", "_put", "OUTTIME")
    if row is not None and not row:  # a row meets a stay once: by its id, or else by time
        return rows
    return rows.dropDuplicates([*(row or ["SUBJECT_ID", time]), "ICUSTAY_ID"])


def hour_index(rows: DataFrame, time: str = "CHARTTIME", start: str = "INTIME") -> DataFrame:
    """Hours since the stay's begin instead of the time."""
    return rows.withColumn("hours", codes.hours_between(F.col(start), F.col(time))).drop(time, start)


def first_value(series: DataFrame, column: str, by: Sequence[str] = ("SUBJECT_ID", "ICUSTAY_ID"), time: str = "hours") -> DataFrame:
    """The first known value of a channel."""
    c = F.col(f"`{column}`")
    return series.where(c.isNotNull()).groupBy(*by).agg(F.min_by(c, time).alias(column))


def code_flags(rows: DataFrame, values: Sequence[str], by: str = "ICUSTAY_ID", code: str = "ICD9_CODE", prefix: str = "Diagnosis ") -> DataFrame:
    """A2: 0/1 for each of values, one row for each stay that has any diagnosis."""
    return rows.groupBy(by).agg(*(F.coalesce(F.max((F.col(code) == v).cast("int")), F.lit(0)).alias(f"{prefix}{v}") for v in values))


def phenotype_matrix(rows: DataFrame, groups: Sequence[str], by: str = "ICUSTAY_ID") -> DataFrame:
    """A3, O3: 0/1 for each benchmark phenotype, in the order of their names."""
    return code_flags(rows.where("USE_IN_BENCHMARK = 1"), sorted(groups), by, "HCUP_CCS_2015", "")


def episodic_data(history: DataFrame, series: DataFrame, flags: DataFrame) -> DataFrame:
    """One row a stay: static data, first weight and height, diagnosis flags. Stays without diagnosis rows go."""
    static = history.select(
        "SUBJECT_ID", "ICUSTAY_ID", "AGE", "LOS", "MORTALITY", codes.gender_code(F.col("GENDER")).alias("GENDER"), codes.ethnicity_code(F.col("ETHNICITY")).alias("ETHNICITY")
    )
    for c in ("Height", "Weight"):
        static = static.join(first_value(series, c), ["SUBJECT_ID", "ICUSTAY_ID"], "left")
    return static.join(flags, "ICUSTAY_ID")


def split_info(episodic: DataFrame, info: DataFrame) -> DataFrame:
    """J12."""
    return episodic.join(info, ["SUBJECT_ID", "ICUSTAY_ID"])


def processable(history: DataFrame, start_hours: float | None, precision: float = 1e-6) -> DataFrame:
    """Subjects that can give a sample: stay and admission last long enough; all of them without a task."""
    if start_hours is None:
        return history.select("SUBJECT_ID").distinct()
    days = (start_hours + precision) / 24
    return history.where((F.col("LOS") >= days) & (codes.hours_between(F.col("ADMITTIME"), F.col("DISCHTIME")) / 24 >= days)).select("SUBJECT_ID").distinct()


def subject_status(requested: DataFrame, known: DataFrame, able: DataFrame, done: DataFrame, key: str = "SUBJECT_ID") -> DataFrame:
    """What becomes of each requested subject: unknown, unprocessable, done or open."""
    mark = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    told = requested.select(key).distinct().join(mark(known, "_k"), key, "left").join(mark(able, "_a"), key, "left").join(mark(done, "_d"), key, "left")
    status = F.when(F.col("_k").isNull(), "unknown").when(F.col("_a").isNull(), "unprocessable").when(F.col("_d"), "done").otherwise("open")
    return told.select(key, status.alias("status"))


def first_with_samples(subjects: DataFrame, samples: DataFrame, n: int, seed: int = 42, key: str = "SUBJECT_ID") -> DataFrame:
    """N subjects in pseudo-random order of those that have samples, so that none has to be replaced later."""
    return subjects.select(key).distinct().join(samples.select(key).distinct(), key, "left_semi").orderBy(codes.random_order(F.col(key), seed), key).limit(n)


def cap_samples(events: DataFrame, n: int, source: str = "source", time: str = "CHARTTIME") -> DataFrame:
    """At most n distinct times in all, shared out by the sources' rows; of each source the first in time.

    What rounding leaves over goes to the sources one by one, by name.
    """
    sizes = events.groupBy(source).agg(F.count(F.lit(1)).alias("_rows"))
    all_of = Window.partitionBy(F.lit(1))
    share = sizes.withColumn("_k", F.floor(F.col("_rows") * F.lit(n) / F.sum("_rows").over(all_of)))
    share = share.withColumn("_left", F.lit(n) - F.sum("_k").over(all_of)).withColumn("_i", F.row_number().over(all_of.orderBy(source)))
    share = share.select(source, (F.col("_k") + (F.col("_i") <= F.col("_left")).cast("long")).alias("_k"))
    times = events.select(source, time).distinct().withColumn("_place", F.row_number().over(Window.partitionBy(source).orderBy(time)))
    first = times.where(F.col("_place") <= n)  # so many of a source at most, which each task picks before the shuffle
    kept = first.join(F.broadcast(share), source).where(F.col("_place") <= F.col("_k")).select(source, time)
    return events.join(kept, [source, time], "left_semi")


def by_subject(rows: DataFrame, sort_by: Sequence[str], key: str = "SUBJECT_ID") -> DataFrame:
    """O1, O2: a subject's rows together and in order."""
    return rows.repartition(key).sortWithinPartitions(key, *sort_by)


def difference(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows that one table has more often than the other, whatever their order.

    Both are counted in one pass, one up and the other down. With tasks, rows are dealt out to so many before they are
    counted: rows that hardly repeat are not worth a table in each task that reads them.
    """
    names = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*names).withColumn("_n", F.lit(1)).unionAll(b.toDF(*names).withColumn("_n", F.lit(-1)))
    both = both.repartition(tasks, *names) if tasks else both
    odd = both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return odd.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_n")).select(*names).toDF(*a.columns)
