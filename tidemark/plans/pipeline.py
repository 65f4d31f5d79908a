"""From raw tables to processed samples; each stage is kept as Parquet, and its subjects are not done again."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import channels, cleaning
from tidemark.operators import extract, features, split, tasks, timeseries
from tidemark.sources import raw, stores

TASKS = tuple(tasks.TASKS)
START_HOURS = {"IHM": 48.0, "DECOMP": 4.0, "LOS": 4.0, "PHENO": 1.0, "MULTI": None}


def check_inputs(storage: str | None, subject_ids: Sequence[int] | None, num_subjects: int | None, discretize: bool, engineer: bool, preprocess: bool, task: str | None) -> None:
    if subject_ids is not None and num_subjects is not None:
        raise ValueError("give subject ids or their number, not both")
    if (discretize or engineer or preprocess) and task is None:
        raise ValueError("a task is needed to preprocess, discretize or engineer")
    if task is not None and task not in TASKS:
        raise ValueError(f"unknown task {task}")
    if engineer and task == "MULTI":
        raise ValueError("features are not engineered for MULTI")
    if storage is None:
        raise ValueError("a storage folder is needed")


#: Columns of an admission that history does not have.
DEMOGRAPHICS = ("ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "LANGUAGE")


def extract_stays(spark: SparkSession, source: str, asked: DataFrame | None = None) -> DataFrame:
    """Stays with their admission, its demographics too, and their patient; with asked (HADM_ID), those of its admissions alone."""
    stays, admissions = raw.read_raw(spark, source, "ICUSTAYS"), raw.read_raw(spark, source, "ADMISSIONS")
    if asked is not None:
        stays, admissions = (t.join(asked, "HADM_ID", "left_semi") for t in (stays, admissions))
    return extract.merge_history(stays, admissions, raw.read_raw(spark, source, "PATIENTS"))


def extract_diagnoses(spark: SparkSession, source: str, history: DataFrame, definitions: Mapping[str, Mapping]) -> DataFrame:
    titles, phenotypes = raw.read_raw(spark, source, "D_ICD_DIAGNOSES"), raw.phenotype_codes(spark, definitions)
    return extract.diagnoses(raw.read_raw(spark, source, "DIAGNOSES_ICD"), stores.few(titles), history, F.broadcast(phenotypes))


def extract_events(events: DataFrame, history: DataFrame, staged: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Events with their stays, of the subjects of history alone. A stay of history tells that, but for an event that names another subject: those are met by subject, too."""
    found = staged(extract.recover_stays(events, stores.few(history), "VALUE", "_strange"), "events")
    strange = found.where("_strange")
    if strange.isEmpty():
        return found.drop("_strange")
    known = strange.join(history.select("SUBJECT_ID").distinct(), "SUBJECT_ID", "left_semi")
    return staged(found.where("NOT _strange").unionByName(known).drop("_strange"), "known-events")


def extract_series(events: DataFrame, history: DataFrame, variables: DataFrame) -> DataFrame:
    """The wide rows of each stay. Which rows a stay has is told by their times alone, and they are wide only after."""
    named = cleaning.clean(extract.with_variables(events, variables))
    wide = extract.pivot_events(named, channels.CHANNELS)
    met = extract.episodes(named.select("SUBJECT_ID", "CHARTTIME", "ICUSTAY_ID").distinct(), history)
    return extract.hour_index(wide.join(met, ["SUBJECT_ID", "CHARTTIME"])).select(*timeseries.KEYS, "hours", *(f"`{c}`" for c in channels.CHANNELS))


def extract_episodic(history: DataFrame, series: DataFrame, diagnoses: DataFrame, definitions: Mapping[str, Mapping]) -> DataFrame:
    codes = sorted({c for d in definitions.values() for c in map(str, d["codes"])})
    return extract.episodic_data(history, series, extract.code_flags(diagnoses, codes))


def extract_new(spark: SparkSession, source: str, extracted: str, definitions: Mapping[str, Mapping], varmap_path: str, start_hours: float | None, subject_ids: Sequence[int] | None, num_subjects: int | None) -> None:
    """Adds to the extracted tables what they lack: the subjects asked for that can give a sample and aren't there yet.

    Which subjects are open is settled first, from stays that are joined once, with subject_ids only those of their
    admissions. The events are read once, kept beside the storage, and the series made from these once, and from both
    what else there is; without an open subject no event log is opened.
    """
    with stores.measured_broadcasts(spark), stores.staging(spark, f"{extracted}/_staged") as staged:
        asked = None
        if subject_ids is not None:
            stays = raw.read_raw(spark, source, "ICUSTAYS").where(F.col("SUBJECT_ID").isin(*subject_ids))
            asked = stores.few(staged(stays.select("HADM_ID").distinct(), "asked"))
        stays = staged(extract_stays(spark, source, asked), "stays")
        able = extract.processable(extract.icu_history(stays), start_hours)
        if subject_ids is not None:
            able = able.where(F.col("SUBJECT_ID").isin(*subject_ids))
        done = stores.done_subjects(spark, extracted)
        open_ = staged(able.join(stores.few(done), "SUBJECT_ID", "left_anti").select("SUBJECT_ID").distinct(), "open")
        if open_.isEmpty():
            return
        closed = staged(stays.where("SUBJECT_ID IS NOT NULL").select("SUBJECT_ID").distinct().join(stores.few(open_), "SUBJECT_ID", "left_anti"), "closed")
        stays = staged(stores.of_subjects(stays, open_, closed), "open-stays")
        history, info = extract.icu_history(stays.drop(*DEMOGRAPHICS)), extract.subject_info(stays)
        diagnoses = staged(extract_diagnoses(spark, source, stores.few(history), definitions), "diagnoses")
        events = extract_events(raw.read_events(spark, source), history, staged)
        series = staged(extract_series(events, history, stores.few(raw.read_variable_map(spark, varmap_path))), "series")
        episodic = staged(extract_episodic(history, series, diagnoses, definitions), "episodic")
        tables = {"history": history, "info": info, "diagnoses": diagnoses, "events": events, "series": series, "episodic": episodic}
        if num_subjects is not None:  # those that are there already have samples
            first = extract.first_with_samples(able, episodic.select("SUBJECT_ID").unionByName(done.select("SUBJECT_ID")), num_subjects)
            tables = {n: t.join(first, "SUBJECT_ID", "left_semi") for n, t in tables.items()}
        stores.write_by_subject(tables, extracted)


EXTRACTED = ("history", "info", "diagnoses", "events", "series", "episodic")


def load_data(spark: SparkSession, source: str, storage: str, definitions: Mapping[str, Mapping], varmap_path: str, subject_ids: Sequence[int] | None = None, num_subjects: int | None = None, time_step_size: float = 1.0, impute_strategy: str = "previous", start_at_zero: bool = True, deep_supervision: bool = False, preprocess: bool = False, engineer: bool = False, discretize: bool = False, task: str | None = None) -> dict[str, DataFrame]:
    """Runs the stages asked for and returns the tables of the last one.

    Every stage has a folder for its own settings, and takes from the one before only the subjects that it doesn't hold
    yet (R4): extraction is shared by all tasks, samples by all ways to discretize or engineer them.
    """
    check_inputs(storage, subject_ids, num_subjects, discretize, engineer, preprocess, task)
    named = lambda **settings: split.fingerprint(definitions=definitions, variables=varmap_path, **settings)[:16]
    extracted = f"{storage}/extracted/{named()}"
    extract_new(spark, source, extracted, definitions, varmap_path, START_HOURS.get(task) if task else None, subject_ids, num_subjects)
    if not task:
        return {n: stores.read_subjects(spark, extracted, n) for n in EXTRACTED}
    processed = f"{storage}/processed/{task}-{named()}"

    def new(folder: str, of: str, names: Sequence[str]) -> dict[str, DataFrame]:
        done = stores.few(stores.done_subjects(spark, folder))
        return {n: stores.read_subjects(spark, of, n).join(done, "SUBJECT_ID", "left_anti") for n in names}

    groups = sorted(n for n, d in definitions.items() if d["use_in_benchmark"])
    with stores.measured_broadcasts(spark), stores.staging(spark, f"{processed}/_staged") as staged:
        own = new(processed, extracted, ("series", "episodic", "history", "diagnoses"))
        made = tasks.task_set(task, own["series"], own["episodic"].select(*timeseries.KEYS, "AGE", "LOS", "MORTALITY"), own["history"], own["diagnoses"], groups, timeseries.KEYS)
        stores.write_by_subject({"X": staged(made.x, "X"), "y": staged(made.y, "y")}, processed)
    stage, names = processed, ["X", "y"]
    if discretize:
        stage = f"{storage}/discretized/{task}-{named(step=time_step_size, strategy=impute_strategy, zero=start_at_zero, deep=deep_supervision)}"
        x, y = new(stage, processed, names).values()
        out = {"X": timeseries.discretize(x, time_step_size, impute_strategy, start_at_zero), "y": y}
        if deep_supervision:
            out["yds"] = timeseries.deep_supervision(out["X"], y)
        stores.write_by_subject(out, stage)
        names = list(out)
    elif engineer:
        stage = f"{storage}/engineered/{task}-{named()}"
        x, y = new(stage, processed, names).values()
        stores.write_by_subject({"X": features.engineered(features.ordinals(x), y), "y": y}, stage)
    return {n: stores.read_subjects(spark, stage, n) for n in names}
