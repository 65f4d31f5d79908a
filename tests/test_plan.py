"""The whole run from CSV files, twice, and its argument checks."""

import pytest

from tidemark.plans import pipeline
from tidemark.sources import stores

TABLES = {
    "PATIENTS": "row_id,subject_id,gender,dob,dod\n1,1,F,2060-01-01 00:00:00,\n2,2,M,2050-01-01 00:00:00,2100-01-03 20:00:00\n",
    "ADMISSIONS": "subject_id,hadm_id,admittime,dischtime,deathtime,ethnicity,diagnosis,admission_type,admission_location,discharge_location,insurance,language\n"
    "1,10,2100-01-01 00:00:00,2100-01-06 00:00:00,,WHITE,X,EMERGENCY,ER,HOME,P,\n2,20,2100-01-01 00:00:00,2100-01-06 00:00:00,2100-01-03 20:00:00,ASIAN,X,EMERGENCY,ER,HOME,P,\n",
    "ICUSTAYS": "subject_id,hadm_id,icustay_id,dbsource,first_careunit,last_careunit,first_wardid,last_wardid,intime,outtime,los\n"
    "1,10,100,cv,A,A,1,1,2100-01-01 00:00:00,2100-01-04 00:00:00,3.0\n2,20,200,mv,A,A,1,1,2100-01-01 00:00:00,2100-01-04 00:00:00,3.0\n",
    "D_ICD_DIAGNOSES": "icd9_code,short_title,long_title\n001,a,b\n",
    "DIAGNOSES_ICD": "subject_id,hadm_id,seq_num,icd9_code\n1,10,1,001\n2,20,1,001\n",
    "CHARTEVENTS": "subject_id,hadm_id,icustay_id,charttime,itemid,value,valueuom\n1,10,100,2100-01-01 02:30:00,1,70,bpm\n1,10,,2100-01-01 05:10:00,1,80,bpm\n2,20,200,2100-01-01 01:10:00,1,90,bpm\n2,20,999,2100-01-01 03:10:00,1,91,bpm\n",
    "LABEVENTS": "subject_id,hadm_id,charttime,itemid,value,valueuom\n1,10,2100-01-01 02:30:00,2,ERROR,\n1,10,2100-01-01 03:30:00,2,7.3,\n",
    "OUTPUTEVENTS": "subject_id,hadm_id,icustay_id,charttime,itemid,value,valueuom\n",
}
VARMAP = "LEVEL2,ITEMID,COUNT,STATUS,MIMIC LABEL\nHeart Rate,1,5,ready,HR\npH,2,5,ready,pH\n,3,5,ready,x\n"
DEFINITIONS = {"A": {"use_in_benchmark": True, "codes": ["001"]}}


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in TABLES.items():
        (folder / f"{name}.csv").write_text(text)
    (folder / "varmap.csv").write_text(VARMAP)
    return folder


def test_discretized_run(spark, source, tmp_path):
    run = lambda **k: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), task="IHM", preprocess=True, discretize=True, **k)
    out = run(subject_ids=[1])
    assert [(r.SUBJECT_ID, r.y) for r in out["y"].collect()] == [(1, 0)]
    out = run()  # only subject 2 is new
    x = {(r.SUBJECT_ID, r.bins): (r["Heart Rate"], round(r["pH"], 2)) for r in out["X"].collect()}
    assert x == {(1, 0): (86, 7.4), (1, 1): (86, 7.4), (1, 2): (70, 7.4), (1, 3): (70, 7.3), (1, 4): (70, 7.3), (1, 5): (80, 7.3), (2, 0): (86, 7.4), (2, 1): (90, 7.4)}
    assert sorted((r.SUBJECT_ID, r.y) for r in out["y"].collect()) == [(1, 0), (2, 1)]


@pytest.fixture(scope="module")
def alone(spark, source, tmp_path_factory):
    """Samples and labels of the LOS task in a storage of their own."""
    out = pipeline.load_data(spark, str(source), str(tmp_path_factory.mktemp("alone")), DEFINITIONS, str(source / "varmap.csv"), task="LOS", preprocess=True)
    return {n: sorted(map(str, out[n].collect())) for n in ("X", "y")}


def test_two_tasks_share_the_extraction(spark, source, tmp_path, alone):
    run = lambda **k: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), **k)
    run(task="IHM", preprocess=True)
    got = run(task="LOS", preprocess=True)
    for n in ("X", "y"):
        assert sorted(map(str, got[n].collect())) == alone[n]
    (folder,) = (tmp_path / "out" / "extracted").iterdir()
    assert stores.read_subjects(spark, str(folder), "history").count() == 2


@pytest.mark.parametrize("ends_at", [5, 11, None])
def test_a_run_that_broke_off_is_done_anew(spark, source, tmp_path, monkeypatch, ends_at, alone):
    """The ends_at-th write fails, once while events are staged and once in the middle of a batch; or, without one, the batch's commit."""
    from pyspark.sql import DataFrameWriter

    from tidemark.sources import commits

    run = lambda: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), task="LOS", preprocess=True)
    write, left = DataFrameWriter.parquet, [ends_at]

    def failing(self, path, *a, **k):
        left[0] -= 1
        if not left[0]:
            raise OSError("lost")
        return write(self, path, *a, **k)

    def no_commit(*a):
        raise OSError("lost")

    if ends_at is None:
        monkeypatch.setattr(commits, "put_if_absent", no_commit)
    else:
        monkeypatch.setattr(type(spark.range(0).write), "parquet", failing)
    with pytest.raises(OSError, match="lost"):
        run()
    monkeypatch.undo()
    got = run()
    for n in ("X", "y"):
        assert sorted(map(str, got[n].collect())) == alone[n]


def test_two_runs_at_once(spark, source, tmp_path, alone):
    from concurrent.futures import ThreadPoolExecutor

    run = lambda _: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), task="LOS", preprocess=True)
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(run, range(2)))
    for got in both:
        for n in ("X", "y"):
            assert sorted(map(str, got[n].collect())) == alone[n]


def test_each_event_log_is_read_once(spark, source, tmp_path, monkeypatch):
    """Every row that leaves an event log is counted where it is read; a second run, with nothing new, opens none."""
    from pyspark.sql import functions as F

    from tidemark.sources import raw

    seen = spark.sparkContext.accumulator(0)
    read = raw.read_events

    def counted(*a):
        @F.udf("string")
        def count(v):
            seen.add(1)
            return v

        return read(*a).withColumn("VALUE", count.asNondeterministic()("VALUE"))

    monkeypatch.setattr(raw, "read_events", counted)
    run = lambda task: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), task=task, preprocess=True)
    run("IHM")["X"].collect()
    assert seen.value == 6  # of CHARTEVENTS four rows, of LABEVENTS two
    run("LOS")["X"].collect()
    assert seen.value == 6
    assert not list((tmp_path / "out").glob("extracted/*/_staged/*"))


def test_some_subjects_first(spark, source, tmp_path):
    run = lambda **k: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), **k)
    one = {r.SUBJECT_ID for r in run(num_subjects=1)["history"].collect()}
    assert len(one) == 1
    assert {r.SUBJECT_ID for r in run(num_subjects=1)["history"].collect()} == one  # it is there already
    assert {r.SUBJECT_ID for r in run(num_subjects=2)["history"].collect()} == {1, 2}


@pytest.mark.parametrize("bad", [{"subject_ids": [1], "num_subjects": 1}, {"discretize": True}, {"task": "X"}, {"engineer": True, "task": "MULTI"}])
def test_bad_arguments(spark, source, tmp_path, bad):
    with pytest.raises(ValueError):
        pipeline.load_data(spark, str(source), str(tmp_path), DEFINITIONS, str(source / "varmap.csv"), **bad)


def test_nothing_is_dealt_out_by_item_or_code(spark, source, tmp_path, monkeypatch):
    """All rows have one of few items and codes: a shuffle by them would leave most tasks without work."""
    writer, plans = type(spark.range(0).write), []
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **k))[1])
    pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), task="IHM", preprocess=True)
    text = "\n".join(plans)
    assert "hashpartitioning(SUBJECT_ID" in text and "hashpartitioning(ITEMID" not in text and "hashpartitioning(ICD9_CODE" not in text


def test_some_subjects_cost_no_join_of_all_stays(spark, source, tmp_path, monkeypatch):
    seen, stay_tables = [], pipeline.extract_stays

    def told(*a):
        out = stay_tables(*a)
        seen.append([(r.SUBJECT_ID, r.ADMISSION_TYPE) for r in out.collect()])
        return out

    monkeypatch.setattr(pipeline, "extract_stays", told)
    run = lambda **k: pipeline.load_data(spark, str(source), str(tmp_path / "out"), DEFINITIONS, str(source / "varmap.csv"), **k)["history"].collect()
    assert {r.SUBJECT_ID for r in run(subject_ids=[2])} == {2}
    assert seen[0] == [(2, "EMERGENCY")]
    assert {r.SUBJECT_ID for r in run()} == {1, 2}


def test_an_admission_of_two_subjects_counts_whole(spark, source, tmp_path):
    """Admission 10 has a stay of either subject, so neither stay counts, also where one subject is asked for; and an event that names a subject that isn't there goes."""
    for name, more in {
        "ADMISSIONS": "2,10,2100-01-01 00:00:00,2100-01-06 00:00:00,,WHITE,X,EMERGENCY,ER,HOME,P,\n",
        "ICUSTAYS": "2,10,101,cv,A,A,1,1,2100-01-01 00:00:00,2100-01-04 00:00:00,3.0\n",
        "CHARTEVENTS": "1,20,200,2100-01-01 06:00:00,1,60,bpm\n2,20,200,2100-01-01 07:00:00,1,61,bpm\n,20,200,2100-01-01 08:00:00,1,62,bpm\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(TABLES[name] + more)
    for name in TABLES.keys() - {"ADMISSIONS", "ICUSTAYS", "CHARTEVENTS"}:
        (tmp_path / f"{name}.csv").write_text(TABLES[name])
    run = lambda **k: pipeline.load_data(spark, str(tmp_path), f"{tmp_path}/out", DEFINITIONS, str(source / "varmap.csv"), **k)
    both = run()
    assert run(subject_ids=[1])["history"].count() == 1
    assert [r.ICUSTAY_ID for r in both["history"].collect()] == [200] and [r.SUBJECT_ID for r in both["info"].collect()] == [2]
    assert sorted(r.VALUE for r in both["events"].collect()) == ["61", "90"]


def test_an_event_of_another_known_subject_stays(spark, source, tmp_path):
    for name in TABLES:
        (tmp_path / f"{name}.csv").write_text(TABLES[name] + ("1,20,200,2100-01-01 06:00:00,1,60,bpm\n" if name == "CHARTEVENTS" else ""))
    got = pipeline.load_data(spark, str(tmp_path), f"{tmp_path}/out", DEFINITIONS, str(source / "varmap.csv"))["events"]
    assert [(r.SUBJECT_ID, r.ICUSTAY_ID) for r in got.where("VALUE = '60'").collect()] == [(1, 200)]


@pytest.mark.parametrize("few", [0, 20_000])
def test_subjects_that_a_table_lacks(spark, tmp_path, monkeypatch, few):
    """The subjects to leave out are sent to the rows, or are too many for that."""
    monkeypatch.setattr(stores, "FEW_KEYS", few)
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "z"), (4, "w")], "SUBJECT_ID int, v string")
    b = spark.createDataFrame([(1, 1), (3, 1), (None, 1), (4, 1)], "SUBJECT_ID int, v int")
    stores.write_by_subject({"a": a.where("SUBJECT_ID = 4"), "b": b.where("SUBJECT_ID = 4")}, str(tmp_path))
    stores.write_by_subject({"a": a, "b": b}, str(tmp_path))
    got = [sorted((r.SUBJECT_ID, r.v) for r in stores.read_subjects(spark, str(tmp_path), n).collect()) for n in "ab"]
    assert got == [[(1, "x"), (1, "y"), (4, "w")], [(1, 1), (4, 1)]]
