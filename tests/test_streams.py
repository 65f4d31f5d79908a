"""Streams that keep a model, bins or counts from batch to batch: against plain loops, late rows, and runs that break off."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import timeseries
from tidemark.streaming import grids, jobs, online, rolling

SCHEMA = "id int, features array<double>, y int"


def write(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{folder}/in")


def plain_loop(batches, rate, l2):
    """Scores by id, made before learning."""
    w, b, out = [0.0, 0.0], 0.0, {}
    p = lambda x: 1 / (1 + math.exp(-(b + sum((v or 0.0) * c for v, c in zip(x, w, strict=True)))))
    for rows in batches:
        told = [(i, x, y, p(x)) for i, x, y in rows]
        out.update({i: q for i, _, _, q in told})
        known = [(x, q - y) for _, x, y, q in told if y is not None]
        if known:
            g = [sum(d * (x[k] or 0.0) for x, d in known) / len(known) for k in range(2)]
            b, w = b - rate * sum(d for _, d in known) / len(known), [c - rate * (g[k] + l2 * c) for k, c in enumerate(w)]
    return out, w, b


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(2)
    rows = [[(100 * k + i, [rng.gauss(0, 1), None if i == 3 else rng.random()], None if i % 7 == 0 else int(rng.random() < 0.5)) for i in range(40)] for k in range(3)]
    return [*rows, [(999, [0.5, 0.5], None)]]  # the last one has nothing to learn from


def test_scored_before_learned(spark, tmp_path, batches):
    for rows in batches:
        write(spark, rows, tmp_path)
        stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files=100)
        online.learn(stream, f"{tmp_path}/out", f"{tmp_path}/state", rate=0.3, l2=0.1).awaitTermination()
    got = {r.id: r.p for r in spark.read.parquet(f"{tmp_path}/out/scored").collect()}
    want, w, b = plain_loop(batches, 0.3, 0.1)
    assert got == pytest.approx(want, abs=1e-12)
    assert all(got[r[0]] == 0.5 for r in batches[0])
    assert online.weights_after(spark, f"{tmp_path}/out") == pytest.approx({-1: b, 0: w[0], 1: w[1]})
    told = {r.batch: r for r in online.progress(spark.read.parquet(f"{tmp_path}/out/scored")).collect()}
    assert set(told) == {0, 1, 2} and told[0].log_loss == pytest.approx(math.log(2))


def test_a_batch_that_broke_off_is_learned_once(spark, tmp_path, batches, monkeypatch):
    read = lambda: jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files=100)
    run = lambda: online.learn(read(), f"{tmp_path}/out", f"{tmp_path}/state", rate=0.3, l2=0.1).awaitTermination()
    write(spark, batches[0], tmp_path)
    run()
    write(spark, batches[1], tmp_path)
    with monkeypatch.context() as m:  # after the scores of batch 1 are written
        m.setattr(online, "gradient", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    got = {r.id: r.p for r in spark.read.parquet(f"{tmp_path}/out/scored").collect()}
    want, w, b = plain_loop(batches[:2], 0.3, 0.1)
    assert got == pytest.approx(want, abs=1e-12)
    assert online.weights_after(spark, f"{tmp_path}/out", 1) == pytest.approx({-1: b, 0: w[0], 1: w[1]})


def test_features_of_different_number_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 1)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="different number"):
        online.gradient(rows, {}).collect()
    assert online.gradient(rows.limit(0), {}).count() == 0
    assert [r.p for r in online.scored(rows, {-1: 0.0, 0: 1.0, 1: 1.0}).orderBy("id").collect()] == pytest.approx([1 / (1 + math.exp(-3)), 1 / (1 + math.exp(-1))])


T0 = datetime(2100, 1, 1)
EVENT = "ICUSTAY_ID long, CHARTTIME timestamp, INTIME timestamp, OUTTIME timestamp, VARIABLE string, VALUE double"


def event(stay, hours, name, value, length=30):
    begun = T0 + timedelta(hours=stay)
    return stay, begun + timedelta(hours=hours), begun, begun + timedelta(hours=length), name, value


def batch_grid(spark, rows, normal):
    series = spark.createDataFrame([(r[0], (r[1] - r[2]).total_seconds() / 3600, *((r[5] if r[4] == c else None) for c in normal)) for r in rows], "ICUSTAY_ID long, hours double, " + ", ".join(f"{c} double" for c in normal))
    by = ["ICUSTAY_ID"]
    grid = timeseries.dense_grid(timeseries.last_in_bin(timeseries.with_bins(series, 1.0, True, by), list(normal), by), by)
    return sorted(map(tuple, timeseries.imputed(grid, normal, "previous", by).select("ICUSTAY_ID", "bins", *normal).collect()))


def run_grid(spark, folder, rows, normal, delay):
    """One more file, and all that is there; each call goes on where the last one ended."""
    frame = spark.createDataFrame(rows, EVENT)
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with grids.keyed_state(spark):
        made = grids.filled_grid(jobs.event_stream(spark, f"{folder}/in", frame.schema), list(normal), list(normal.values()), delay)
        jobs.append(made, f"{folder}/out", f"{folder}/state").awaitTermination()
    return sorted(map(tuple, spark.read.schema(made.schema).parquet(f"{folder}/out").where("ICUSTAY_ID >= 0").collect()))


def test_grid_of_rows_out_of_order(spark, tmp_path):
    rng = random.Random(9)
    normal = {"HR": 86.0, "pH": None}
    rows = [event(s, h, rng.choice(list(normal)), rng.choice([None, rng.random()])) for s in range(4) for h in [0.0, 1.0, 2.0, 2.0, 29.5, *(rng.random() * 30 for _ in range(25))] if rng.random() < 0.7]
    rng.shuffle(rows)
    cut = len(rows) // 3
    last = event(-1, 1000, "HR", 1.0, 2000)
    got = None
    for part in (rows[:cut], rows[cut : 2 * cut], rows[2 * cut :], [last]):
        got = run_grid(spark, tmp_path, part, normal, "40 hours")
    assert got == batch_grid(spark, rows, normal)
    assert len({r[0] for r in got}) == 4


def test_late_rows_and_the_end_of_a_stay(spark, tmp_path):
    normal = {"HR": 0.0}
    assert run_grid(spark, tmp_path, [event(0, 0.5, "HR", 1.0, 10), event(0, 4.5, "HR", 2.0, 10)], normal, "2 hours") == [(0, 0, 1.0), (0, 1, 1.0)]
    # in time for bin 3, too late for bin 1; what lies outside of the stay doesn't count
    assert run_grid(spark, tmp_path, [event(0, 3.2, "HR", 9.0, 10), event(0, 1.5, "HR", 7.0, 10), event(0, 12.0, "HR", 8.0, 10), event(0, -1.0, "HR", 8.0, 10)], normal, "2 hours") == [(0, k, v) for k, v in enumerate([1.0, 1.0, 1.0, 9.0, 2.0])]
    # the stay ended with its last bin, and what comes behind the watermark starts no new one
    after = run_grid(spark, tmp_path, [event(0, 9.0, "HR", 5.0, 10), event(-1, 60, "HR", 1.0, 100)], normal, "2 hours")
    assert after == [(0, k, v) for k, v in enumerate([1.0, 1.0, 1.0, 9.0, 2.0])]


ROW = "key string, at long, id long, y int, p double, own int, told int"


def plain_rolling(rows, size, every):
    """(key, seen, n, auc, quadratic kappa) by sorting and counting each window anew."""
    out = []
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        for end in range(every, len(own) + 1, every):
            w = own[max(0, end - size) : end]
            pos, neg = ([min(9, math.floor(r[4] * 10 + 1e-9)) for r in w if r[3] == y and r[4] is not None] for y in (1, 0))
            auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
            told = [(r[5], r[6]) for r in w if r[5] is not None and r[6] is not None]
            o, e = sum((a - b) ** 2 for a, b in told), sum((a - b) ** 2 for a, _ in told for _, b in told)
            out.append((key, end, len(w), auc, (1 - o * len(told) / e if e else 0.0) if told else None))
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize(("size", "every"), [(7, 3), (5, 20), (100, 10)])
def test_rows_that_leave_a_window_are_taken_back(spark, tmp_path, size, every):
    rng = random.Random(size)
    rows = [(rng.choice("ab"), i, i % 3, rng.choice([0, 1, None]), rng.choice([None, rng.random(), 1.0]), rng.choice([0, 1, 2, None]), rng.randrange(3)) for i in range(90)]
    rows += [("c", 100 + i, 0, 1, 0.5, None, None) for i in range(20)]  # one label only, and no classes
    got = []
    for part in (rows[:40], rows[40:44], rows[44:]):
        frame = spark.createDataFrame(rng.sample(part, len(part)), ROW)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with grids.keyed_state(spark):
            stream = jobs.event_stream(spark, f"{tmp_path}/in", frame.schema)
            made = rolling.rolling_metrics(stream, "key", "at", "id", "y", "p", F.col("own"), F.col("told"), size, every, 10, 3, "quadratic")
            jobs.append(made, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        got = sorted(map(tuple, spark.read.schema(made.schema).parquet(f"{tmp_path}/out").collect()))
    want = plain_rolling(rows, size, every)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:] == tuple(x if x is None else pytest.approx(x) for x in w[3:])


def test_stays_of_a_bucket_are_filled_together(spark, tmp_path):
    rng, rows, got = random.Random(4), [], []
    schema = "ICUSTAY_ID long, hours double, v double"
    for part in range(3):
        new = [(s, 100.0 * part + h, rng.choice([None, None, rng.random()])) for s in range(50) for h in rng.sample(range(100), 4) if rng.random() < 0.5]
        spark.createDataFrame(rng.sample(new, len(new)), schema).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        rows += new
        stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files=2)
        query = jobs.forward_filled(stream, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        jobs.now(query, f"{tmp_path}/state").awaitTermination()
    want, last = [], {}
    for s, h, v in sorted(rows):
        last[s] = v if v is not None else last.get(s)
        want.append((s, h, last[s]))
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("ICUSTAY_ID", "hours", "v").collect()))
    assert got == want and len(got) > 50


class State:
    """What GroupState gives, with a clock that is set."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.clock, self.wait = None, False, False, 0, None

    def getCurrentProcessingTimeMs(self):
        return self.clock

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_each_stay_of_a_bucket_has_its_own_end():
    fill, state = jobs._filler(100), State()
    run = lambda rows: [tuple(r) for f in fill((0,), iter([pd.DataFrame(rows, columns=["ICUSTAY_ID", "hours", "v"])]), state) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    assert run([(1, 2.0, None), (1, 1.0, 5.0), (2, 1.0, None)]) == [(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, None)] and state.wait == 100
    state.clock = 60
    assert run([(2, 3.0, 7.0)]) == [(2, 3.0, 7.0)] and state.wait == 40
    state.clock, state.hasTimedOut = 101, True
    assert not list(fill((0,), iter([]), state)) and state.get[0] == [2] and state.wait == 59
    state.hasTimedOut = False
    assert run([(1, 4.0, None), (2, 4.0, None)]) == [(1, 4.0, None), (2, 4.0, 7.0)]
    state.clock, state.hasTimedOut = 300, True
    assert not list(fill((0,), iter([]), state)) and not state.exists


def test_batches_do_not_grow_with_the_files(spark, tmp_path):
    from tidemark.catalog import proxies

    spark.range(200).repartition(40).write.parquet(f"{tmp_path}/in")
    assert proxies.files_a_batch(spark, f"{tmp_path}/in", 2) == 5 and proxies.files_a_batch(spark, f"{tmp_path}/in", 8) == 8
