"""Operators on small hand-written clinical tables, with the cases that the given tables don't hold."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import channels, cleaning, codes
from tidemark.operators import extract, features, metrics, models, running, samples, scale, split, stats, tasks, timeseries
from tidemark.sources import raw, stores

T0 = dt.datetime(2100, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def clean_one(spark, variable, value, unit="", label=""):
    row = spark.createDataFrame([(variable, value, unit, label)], "VARIABLE string, VALUE string, VALUEUOM string, MIMIC_LABEL string")
    out = cleaning.clean(row).collect()
    return out[0].VALUE if out else None


@pytest.mark.parametrize(
    ("variable", "value", "unit", "label", "want"),
    [
        ("Systolic blood pressure", "120/80", "", "", 120),
        ("Diastolic blood pressure", "120/80", "", "", 80),
        ("Diastolic blood pressure", "75", "", "", 75),
        ("Respiratory rate", ">60/minute", "", "", 60),
        ("Capillary refill rate", "Brisk", "", "", 0),
        ("Capillary refill rate", "Delayed", "", "", 1),
        ("Capillary refill rate", "odd", "", "", None),
        ("Glucose", "ERROR", "", "", None),
        ("pH", ".5", "", "", 0.5),
        ("Oxygen saturation", "0.98", "", "", 98),
        ("Temperature", "98.6", "", "", 37),
        ("Temperature", "36", "F", "", 20 / 9),
        ("Weight", "5", "lb", "", 5 * 0.453592),
        ("Weight", "160", "", "in oz", 10 * 0.453592),
        ("Height", "70", "inches", "", 178),
        ("Fraction inspired oxygen", "40", "%", "", 0.4),
        ("Fraction inspired oxygen", "0.4", "", "", 0.004),
        ("Fraction inspired oxygen", "40", "Torr", "", 40),
    ],
)
def test_cleaning(spark, variable, value, unit, label, want):
    got = clean_one(spark, variable, value, unit, label)
    assert got is None if want is None else float(got) == pytest.approx(want)


def test_guarded_oxygen_and_untouched_text(spark):
    row = spark.createDataFrame([("Fraction inspired oxygen", "0.4", None)], "VARIABLE string, VALUE string, VALUEUOM string")
    assert float(cleaning.clean(row, cleaning.cleaners(fio2_guard=True)).first().VALUE) == 0.4
    assert clean_one(spark, "Heart Rate", "fast") == "fast" and clean_one(spark, "Heart Rate", None) is None


def test_codes(spark):
    row = spark.createDataFrame([(T0, dt.datetime(2300, 5, 1), "WHITE - RUSSIAN", "BLACK OR AFRICAN", None, 23.9, 336.0)], "i timestamp, b timestamp, e string, e2 string, g string, h double, h2 double")
    got = row.select(
        codes.age(F.col("i"), F.col("b")), codes.ethnicity_code(F.col("e")), codes.ethnicity_code(F.col("e2")), codes.gender_code(F.col("g")), codes.custom_bin(F.col("h")), codes.custom_bin(F.col("h2")),
        codes.died_within(F.col("i"), F.col("i"), F.col("i")), codes.log_bin(F.lit(0.0)), codes.log_bin(F.lit(1e9)),
    ).first()
    assert list(got) == [90, 4, 2, 0, 0, 9, 1, 0, 9]


@pytest.fixture
def history(spark):
    stays = [(1, 10, 100, "cv", "A", "A", 1, 1, hours(0), hours(60), 2.5), (1, 11, 101, "cv", "A", "B", 1, 1, hours(500), hours(510), 0.4), (2, 20, 200, "mv", "A", "A", 2, 2, hours(0), hours(72), 3.0), (2, 20, 201, "mv", "A", "A", 2, 2, hours(80), hours(90), 0.4), (3, 30, 300, "mv", "A", "A", 2, 2, hours(0), hours(100), 4.2)]
    admissions = [(1, 10, hours(-1), hours(70), hours(50), "WHITE", "x"), (1, 11, hours(499), hours(520), None, "WHITE", "x"), (2, 20, hours(0), hours(99), None, "ASIAN", "x"), (3, 30, hours(0), hours(120), None, "ASIAN", "x")]
    patients = [(1, "F", dt.datetime(2060, 1, 1), None), (2, "M", dt.datetime(2000, 1, 1), None), (3, "M", dt.datetime(2083, 1, 1), None)]
    kinds = lambda t: ", ".join(f"{n} {'timestamp' if k == 'time' else k}" for n, k in raw.SCHEMAS[t].items())
    clinical = "SUBJECT_ID int, HADM_ID int, ADMITTIME timestamp, DISCHTIME timestamp, DEATHTIME timestamp, ETHNICITY string, DIAGNOSIS string"
    return extract.merge_history(spark.createDataFrame(stays, kinds("ICUSTAYS")), spark.createDataFrame(admissions, clinical), spark.createDataFrame(patients, kinds("PATIENTS")))


def test_history(history):
    merged = {r.ICUSTAY_ID: r.AGE for r in history.collect()}
    assert merged == {100: 40, 300: 17}  # moved stays and admissions with two stays go
    adult = extract.icu_history(history).collect()
    assert [(r.ICUSTAY_ID, r.MORTALITY, r.MORTALITY_INUNIT) for r in adult] == [(100, 1, 1)]
    assert [r.SUBJECT_ID for r in extract.processable(history, 61.0).collect()] == [3]


def test_stay_recovery_and_episodes(spark):
    history = spark.createDataFrame([(10, 100)], "HADM_ID int, ICUSTAY_ID int")
    events = spark.createDataFrame([(None, 100, "1"), (10, None, "2"), (10, 999, "3"), (10, 100, "None"), (77, 100, "5")], "HADM_ID int, ICUSTAY_ID int, VALUE string")
    assert sorted((r.ICUSTAY_ID, r.VALUE) for r in extract.recover_stays(events, history).collect() if r.VALUE) == [(100, "2")]
    assert extract.recover_stays(events, history).count() == 2
    series = spark.createDataFrame([(1, 5, hours(10), 1), (1, 9, hours(0), 2), (1, 9, hours(20), 3), (1, 9, hours(21), 4), (1, 5, hours(90), 5)], "SUBJECT_ID int, ICUSTAY_ID int, CHARTTIME timestamp, n int")
    stays = spark.createDataFrame([(1, 5, hours(0), hours(20))], "SUBJECT_ID int, ICUSTAY_ID int, INTIME timestamp, OUTTIME timestamp")
    got = extract.hour_index(extract.episodes(series, stays))
    assert sorted((r.n, r.hours) for r in got.collect()) == [(1, 10), (2, 0), (3, 20), (5, 90)]


def test_rows_of_stays_that_overlap(spark):
    """Against the plain condition: stays of a day to weeks, without an end, backwards, and rows that name other stays, none, or several."""
    rng = random.Random(7)
    stays = [(s, 10 * s + k, hours(a), None if k == 3 else hours(a + rng.choice([-5, 0, 3, 30, 400]))) for s in range(3) for k in range(5) for a in [rng.randrange(200)]]
    rows = [(s, rng.choice([None, *range(10 * s, 10 * s + 6)]), hours(t), float(t)) for s in range(4) for t in range(0, 300, 3) for _ in range(rng.choice([1, 1, 2]))]
    series = spark.createDataFrame(rows, "SUBJECT_ID int, ICUSTAY_ID int, CHARTTIME timestamp, n double")
    got = extract.episodes(series, spark.createDataFrame(stays, "SUBJECT_ID int, ICUSTAY_ID int, INTIME timestamp, OUTTIME timestamp"))
    want = {(r[0], s[1], r[2], r[3], s[2]) for r in rows for s in stays if r[0] == s[0] and (r[1] == s[1] or (s[3] is not None and s[2] <= r[2] <= s[3]))}
    assert sorted((r.SUBJECT_ID, r.ICUSTAY_ID, r.CHARTTIME, r.n, r.INTIME) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[SUBJECT_ID" in plan and "_at" in plan and "n#" not in plan.split("keys=[")[1].split("]")[0]


def test_pivot_orders(spark):
    events = spark.createDataFrame([(1, T0, "Heart Rate", "9"), (1, T0, "Heart Rate", "100"), (1, T0, "pH", None)], "SUBJECT_ID int, CHARTTIME timestamp, VARIABLE string, VALUE string")
    assert extract.pivot_events(events, ["Heart Rate", "pH"]).first()["Heart Rate"] == "100"
    old = extract.pivot_events(events, ["Heart Rate", "pH"], legacy_order=True).first()
    assert (old["Heart Rate"], old["pH"]) == ("9", None)


def test_bins_at_the_edges(spark):
    h = spark.createDataFrame([(-5e-7,), (0.0,), (0.9999999,), (1.0,), (1.000002,)], "h double")
    assert [r[0] for r in h.select(timeseries.bin_id(F.col("h"))).collect()] == [0, 0, 0, 0, 1]


def test_discretizer_is_whole(spark):
    names = channels.CHANNELS
    kinds = ", ".join(f"`{c}` string" for c in names)
    row = lambda h, **v: (1, 2, h, *(v.get(c) for c in names))
    rows = [row(2.5, **{"Heart Rate": "70", "Glascow coma scale total": "99"}), row(4.2, **{"Heart Rate": "80", "Glascow coma scale eye opening": "To Pain"})]
    out = timeseries.discretize(spark.createDataFrame(rows, f"SUBJECT_ID int, ICUSTAY_ID int, hours double, {kinds}"))
    assert len(out.columns) == 3 + 59
    got = {r.bins: r for r in out.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [got[i]["Heart Rate"] for i in range(5)] == [86, 86, 70, 70, 80]
    assert got[0]["Glascow coma scale total->15"] == 1 and got[2]["Glascow coma scale total->15"] == 0
    assert got[4]["Glascow coma scale eye opening->To Pain"] == 1 and got[3]["Glascow coma scale eye opening->4 Spontaneously"] == 1
    with pytest.raises(ValueError):
        timeseries.imputed(out, {"Heart Rate": 1.0}, "odd")


@pytest.fixture
def stay(spark):
    series = spark.createDataFrame([(1, 1, float(h), float(h)) for h in (-2, 1, 6, 30, 47, 50)] + [(2, 2, 1.0, 5.0), (3, 3, 1.0, 5.0)], "SUBJECT_ID int, ICUSTAY_ID int, hours double, v double")
    episodic = spark.createDataFrame([(1, 1, 2.0, 1), (2, 2, 47.9 / 24, 0), (3, 3, 3.0, None)], "SUBJECT_ID int, ICUSTAY_ID int, LOS double, MORTALITY int")
    stays = spark.createDataFrame([(1, 1, T0, hours(30)), (2, 2, T0, None), (3, 3, T0, None)], "SUBJECT_ID int, ICUSTAY_ID int, INTIME timestamp, DEATHTIME timestamp")
    return series, episodic, stays


def test_tasks(stay):
    series, episodic, stays = stay
    ihm = tasks.in_hospital_mortality(series, episodic)
    assert [(r.t, r.y) for r in ihm.y.collect()] == [(47, 1)] and ihm.x.count() == 4
    dec = {(r.SUBJECT_ID, r.t): r.y for r in tasks.decompensation(series, episodic, stays).y.collect()}
    assert dec[1, 6] == 0 and dec[1, 7] == 1 and max(t for s, t in dec if s == 1) == 30 and dec[2, 40] == 0
    los = {(r.SUBJECT_ID, r.t): r.y for r in tasks.length_of_stay(series, episodic).y.collect()}
    assert los[1, 5] == 43 and los[1, 48] == 0 and (3, 5) not in los and (1, 4) not in los
    with pytest.raises(ValueError):
        tasks.task_set("X", series, episodic, stays, None, [])


def test_statistics(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 1, 1.0, 4.0), (1, 1, 2.0, 9.0), (2, 2, 0.0, 7.0), (3, 3, 0.0, 5.0), (3, 3, 1.0, 5.0)], "SUBJECT_ID int, ICUSTAY_ID int, hours double, v double")
    y = spark.createDataFrame([(1, 1, 5.0), (1, 1, 1.0), (2, 2, 5.0), (3, 3, 5.0), (4, 4, 5.0)], "SUBJECT_ID int, ICUSTAY_ID int, t double")
    x = {(r.SUBJECT_ID, r.t): r.x for r in features.engineered(rows, y, ["v"]).collect()}
    assert x[1, 5.0][:6] == pytest.approx([1, 9, 14 / 3, 3.2998316, 0.2951, 3], abs=1e-3)
    assert x[1, 1.0][5] == 2 and x[2, 5.0][3:6] == [0, None, 1] and x[3, 5.0][4] is None and x[4, 5.0] == [None] * 42
    assert len(features.feature_names()) == 714


def test_splits(spark):
    counts = spark.createDataFrame([(i, 1 + i % 17) for i in range(300)], "SUBJECT_ID int, n int")
    shares = tasks.sample_shares(counts)
    out = split.ratio_split(shares, 0.2, 0.2, 10)
    sums = {r.split: r.s for r in out.join(shares, "SUBJECT_ID").groupBy("split").agg(F.sum("ratio").alias("s")).collect()}
    assert out.count() == out.select("SUBJECT_ID").distinct().count() == 300
    assert abs(sums["test"] - 0.2) < 0.01 and abs(sums["val"] - 0.2) < 0.01
    assert out.exceptAll(split.ratio_split(shares, 0.2, 0.2, 10)).isEmpty()
    for bad in ((-0.1, 0), (0, 1.1), (0.8, 0.8)):
        with pytest.raises(ValueError):
            split.ratio_split(shares, *bad)


def test_demographics(spark):
    info = spark.createDataFrame([(1, 20.0, "a"), (1, 70.0, "a"), (2, 30.0, "a"), (3, None, "a"), (4, 30.0, None), (5, 40.0, "b")], "SUBJECT_ID int, AGE double, UNIT string")
    ids = lambda s, **k: sorted(r.SUBJECT_ID for r in split.demographic_subjects(info, s, **k).collect())
    assert ids({"AGE": {"less": 60}}) == [2, 3, 4, 5] and ids({"AGE": {"leq": 40, "geq": 30}}) == [2, 3, 4, 5]
    assert ids({"UNIT": {"choice": "a"}}) == [1, 2, 3] and ids({"AGE": {"less": 60}}, invert=True) == []
    for bad in ({"X": {"less": 1}}, {"AGE": {}}, {"AGE": {"less": 1, "leq": 2}}, {"AGE": {"less": 1, "choice": [1]}}, {"AGE": {"less": 1, "geq": 2}}, {"AGE": {"about": 1}}, {"UNIT": {"choice": []}}):
        with pytest.raises(ValueError):
            split.check_settings(bad, info.columns)


def test_scalers_and_imputers(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (5.0, 5.0)], "a double, b double")
    filled = scale.impute(rows, scale.fit_imputer(rows, ["a"]))
    assert sorted(r.a for r in filled.collect()) == [1, 3, 3, 5]
    got = scale.scaled(filled, scale.fit_scaler(filled, ["a", "b"])).collect()
    assert {r.b for r in got} == {0} and {r.a for r in got} == {0, 0.5, 1}
    with pytest.raises(ValueError):
        scale.fit_scaler(rows, ["a"], "odd")


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(rows, "y", "p").first()[0] == 0.875
    assert metrics.roc_auc(rows.where("y = 0"), "y", "p").first()[0] is None
    k = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y int, p int")
    assert metrics.kappa(k, "y", "p").first()[0] == pytest.approx(0.4)
    assert metrics.kappa(k.where("y = 0 and p = 0"), "y", "p").first()[0] == 0
    assert metrics.calibration_error(rows, "y", "p").first()[0] == pytest.approx(0.05)


def test_prefix_sums_share_ties(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 1), (9.0, 1)], "p double, n int")
    assert sorted((r.p, r.cum_n) for r in running.prefix_sums(rows, [], "p", ["n"]).collect()) == [(1, 1), (2, 3), (2, 3), (9, 4)]
    flat = spark.createDataFrame([(5.0, 1), (5.0, 1)], "p double, n int")
    assert [r.cum_n for r in running.prefix_sums(flat, [], "p", ["n"], [], 4).collect()] == [2, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "PATIENTS.csv").write_text('row_id,subject_id,gender,dob,dod\n1,7,F,2060-01-01 00:00:00,\n2,8,NA,2060-01-01 00:00:00,2100-01-01 00:00:00\n')
    got = raw.read_raw(spark, str(tmp_path), "PATIENTS").orderBy("SUBJECT_ID").collect()
    assert got[0].DOD is None and got[1].GENDER == "NA" and got[1].DOD == T0
    assert raw.parse_phenotypes('"A b":\n  use_in_benchmark: true\n  codes:\n    - "001"\n    - "002"\nC:\n  use_in_benchmark: false\n  codes: ["001"]\n') == {"A b": {"use_in_benchmark": True, "codes": ["001", "002"]}, "C": {"use_in_benchmark": False, "codes": ["001"]}}
    assert raw.phenotype_rows({"A": {"use_in_benchmark": True, "codes": ["1"]}, "B": {"use_in_benchmark": False, "codes": [1]}}) == [("1", "B", False)]
    a, b = spark.createDataFrame([(1, 2), (3, 4)], "SUBJECT_ID int, v int"), spark.createDataFrame([(1, 5)], "SUBJECT_ID int, w int")
    stores.write_by_subject({"a": a, "b": b}, str(tmp_path / "s"))
    assert [r.SUBJECT_ID for r in stores.read_subjects(spark, str(tmp_path / "s"), "a").collect()] == [1]
    with pytest.raises(ValueError):
        stores.read_subjects(spark, str(tmp_path / "s"), "a", [1], 1)


def test_batches_and_statistics(spark):
    grid = spark.createDataFrame([(s, s, b, float(b)) for s in range(5) for b in range(s + 1)], "SUBJECT_ID int, ICUSTAY_ID int, bins int, v double")
    arrays = samples.stay_arrays(grid, ["v"]).withColumn("y", F.lit(1.0))
    got = samples.batches(arrays, 2, timeseries.KEYS, 1).collect()
    assert sorted(len(r.x) for r in got) == [1, 2, 2] and all(len({len(x) for x in r.x}) == 1 for r in got)
    assert samples.batch_count(arrays, 2).first()[0] == 2
    assert {r.bin: r.n for r in stats.histogram(grid, ["v"], 4).collect()} == {0: 5, 1: 4, 2: 3, 3: 3}


def test_rows_behind_the_watermark_go(spark, tmp_path):
    """Hourly bins of a stream with a delay of two hours: bins that the watermark has passed are closed, and take no late row."""
    from datetime import datetime, timedelta

    from tidemark.streaming import jobs

    begun = datetime(2100, 1, 1)
    stays = spark.createDataFrame([(1, begun)], "ICUSTAY_ID int, INTIME timestamp")
    batches = [[(0.5, 1.0), (1.5, 2.0)], [(9.5, 3.0), (1.7, 4.0)], [(0.7, 99.0), (9.7, 5.0)], [(20.5, 6.0)], [(21.5, 7.0)]]
    schema = "ICUSTAY_ID int, CHARTTIME timestamp, VARIABLE string, VALUE double"
    out = {}
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([(1, begun + timedelta(hours=h), "HR", v) for h, v in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        binned = jobs.hourly_bins(jobs.event_stream(spark, f"{tmp_path}/in", frame.schema), stays)
        query = binned.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        out = {r.bins: r.VALUE for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert n < 2 or 99.0 not in out.values()
    # the second batch was still in time for bin 1, the third too late for bin 0; what is behind 21 less two hours is closed
    assert out == {0: 1.0, 1: 4.0, 9: 5.0}


def test_correlations_of_many_columns(spark):
    """714 columns in one pass, with unknown values, against NumPy; and columns with large means, that don't vary, or that nothing knows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 714))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=300)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 2] += 1e9
    x[:, 3] = 5.0
    x[:, 4] = np.nan
    names = [f"f {i}" for i in range(714)]
    frame = spark.createDataFrame(pd.DataFrame(x, columns=names).astype("Float64"))
    got = {(r.a, r.b): r.r for r in stats.correlations(frame, names).collect()}
    assert len(got) == 714 * 715 // 2
    for i, j in [(0, 0), (0, 1), (1, 2), (2, 2), (17, 500), (600, 713)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)
    assert got[names[0], names[3]] is None and got[names[4], names[5]] is None and got[names[3], names[3]] is None
    assert stats.correlations(frame.limit(0), names[:2]).count() == 0


def test_cuts_by_binary_search(spark):
    """Counts above each cut against the plain condition, with scores on cuts, beyond them, unknown ones and one label only; no row is multiplied."""
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.1 else rng.randrange(2) if g != "one" else 1, rng.choice([None, -3.0, 9.0, rng.random(), rng.randrange(11) / 10])) for g in ("a", "b", "one") for _ in range(80)]
    frame = spark.createDataFrame(rows, "g string, y int, p double")
    for n in (2, 3, 11, 20):
        some = metrics.cuts(n)
        got = {(r.g, r.cut): (r.tp, r.fp, r.pos, r.neg) for r in metrics.curve(frame, "y", "p", some, ["g"]).collect()}
        for g in ("a", "b", "one"):
            own = [(y, p) for h, y, p in rows if h == g and y is not None and p is not None]
            for c in some:
                assert got[g, c] == (sum(y == 1 and p > c for y, p in own), sum(y == 0 and p > c for y, p in own), sum(y == 1 for y, _ in own), sum(y == 0 for y, _ in own))
    for made in (metrics.pr_auc(frame, "y", "p", 20, ["g"]), metrics.roc_auc_cuts(frame, "y", "p", 200), metrics.at_operating_point(frame, "y", "p", 0.5)):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert metrics.pr_auc(frame.limit(0), "y", "p", 20, ["g"]).count() == 0


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_neighbours_with_ties(spark, block_rows, monkeypatch):
    """Against all distances, with many equal ones, large numbers, and fewer rows than neighbours."""
    monkeypatch.setattr(models, "QUERIES", 3)
    monkeypatch.setattr(models, "EXACT", 5)
    rng = random.Random(8)
    rows = [(i, float(i % 3), [1e6 + rng.randrange(3), float(rng.randrange(3))]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, label double, x array<double>")
    got = {r.id: r.p for r in models.neighbours(frame, frame.where("id % 2 = 0"), 5, "id", block_rows).collect()}
    for i, _, x in rows[::2]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j, label) for j, label, y in rows if j != i)[:5]
        assert got[i] == pytest.approx(sum(n[2] for n in near) / 5)
    few = {r.id: r.p for r in models.neighbours(frame.where("id < 3"), frame.where("id = 1"), 5, "id").collect()}
    assert few == {1: pytest.approx((0.0 + 2.0) / 2)}
