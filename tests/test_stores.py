"""Stored stages under runs at once and runs that break off."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.sources import commits, stores


def rows(spark, low, high, mark):
    """Two rows a subject, told apart by who wrote them."""
    return spark.range(low, high).select(F.col("id").cast("int").alias("SUBJECT_ID"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v"), F.lit(mark).alias("mark"))


def test_one_run_gets_each_number(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = sorted(pool.map(lambda b: (commits.commit(spark, f"{tmp_path}/c", b), b), [f"b{i}" for i in range(24)]))
    assert [n for n, _ in got] == list(range(24))
    assert sorted(map(tuple, commits.committed(spark, f"{tmp_path}/c").collect())) == got
    assert not [f for f in (tmp_path / "c").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_a_path_is_taken_once(spark, tmp_path):
    assert commits.put_if_absent(spark, f"{tmp_path}/x/1", "a")
    assert not commits.put_if_absent(spark, f"{tmp_path}/x/1", "b")
    assert (tmp_path / "x" / "1").read_text() == "a"


def test_two_runs_at_once(spark, tmp_path):
    """The same subjects twice: each is kept once, and with both of its rows from one run."""
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda mark: stores.write_by_subject({"a": rows(spark, 0, 20, mark)}, str(tmp_path)), ["one", "two"]))
    assert len(list((tmp_path / "a").glob("batch=*"))) == 2
    got = stores.read_subjects(spark, str(tmp_path), "a").collect()
    assert len(got) == 40 and {r.SUBJECT_ID for r in got} == set(range(20))
    assert len({r.mark for r in got}) == 1
    assert stores.done_subjects(spark, str(tmp_path)).count() == 20
    assert stores.read_subjects(spark, str(tmp_path), "a", ids=[3]).count() == 2


def test_many_runs_at_once_of_subjects_in_common(spark, tmp_path):
    spans = [(0, 12), (6, 18), (12, 24), (0, 24), (3, 9)]
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda k: stores.write_by_subject({t: rows(spark, *spans[k], str(k)) for t in "ab"}, str(tmp_path)), range(5)))
    a, b = (stores.read_subjects(spark, str(tmp_path), t).collect() for t in "ab")
    assert len(a) == len(b) == 48
    of = {r.SUBJECT_ID: r.mark for r in a}
    assert all(of[r.SUBJECT_ID] == r.mark for r in [*a, *b])  # both tables of a subject are from one run
    stores.write_by_subject({t: rows(spark, 0, 30, "late") for t in "ab"}, str(tmp_path))  # only new subjects
    late = stores.read_subjects(spark, str(tmp_path), "a").where("mark = 'late'").select("SUBJECT_ID").distinct().collect()
    assert sorted(r.SUBJECT_ID for r in late) == list(range(24, 30))


def test_a_run_that_broke_off_before_its_number(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(commits, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            stores.write_by_subject({"a": rows(spark, 0, 5, "lost")}, str(tmp_path))
    assert stores.done_subjects(spark, str(tmp_path)).count() == 0
    assert stores.read_subjects(spark, str(tmp_path), "a").count() == 0
    stores.write_by_subject({"a": rows(spark, 0, 5, "kept")}, str(tmp_path))
    got = stores.read_subjects(spark, str(tmp_path), "a").collect()
    assert len(got) == 10 and {r.mark for r in got} == {"kept"}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_every_subject_once_an_epoch(spark, n):
    subjects = stores.numbered_subjects(spark.range(n).select((F.col("id") * 3).cast("int").alias("SUBJECT_ID")).union(spark.sql("SELECT 0, NULL").select(F.lit(None).cast("int"))))
    assert sorted(r.number for r in subjects.collect()) == list(range(n))
    orders = []
    for epoch in range(3):
        got = sorted((r.draw, r.SUBJECT_ID) for r in stores.draw_subjects(subjects, n, n, epoch * n).collect())
        assert [d for d, _ in got] == list(range(epoch * n, (epoch + 1) * n)) and len({s for _, s in got}) == n
        orders.append([s for _, s in got])
    assert n < 10 or (orders[0] != orders[1] != orders[2] and orders[0] != sorted(orders[0]))
    # calls go on where the last one ended, over the ends of epochs, and a long one is the short ones together
    part = [(r.draw, r.SUBJECT_ID) for k in range(5) for r in stores.draw_subjects(subjects, n, n // 2 + 1, k * (n // 2 + 1)).collect()]
    whole = [(r.draw, r.SUBJECT_ID) for r in stores.draw_subjects(subjects, n, 5 * (n // 2 + 1)).collect()]
    assert sorted(part) == sorted(whole) == [(k, orders[k // n][k % n]) for k in range(5 * (n // 2 + 1)) if k < 3 * n] + [x for x in sorted(whole) if x[0] >= 3 * n]
    assert [s for _, s in sorted((r.draw, r.SUBJECT_ID) for r in stores.draw_subjects(subjects, n, n, 0, seed=1).collect())] != orders[0] or n < 10


def test_orders_are_even(spark):
    """A subject's places over many epochs, and neighbours' places in one, spread as chance would have it."""
    subjects = stores.numbered_subjects(spark.range(100).withColumnRenamed("id", "SUBJECT_ID"))
    drawn = [(r.draw, r.SUBJECT_ID) for r in stores.draw_subjects(subjects, 100, 100 * 100).collect()]
    first = [d % 100 for d, s in drawn if s == 17]
    assert len(first) == 100 and 40 < sum(first) / 100 < 60 and len(set(first)) > 45
    place = {s: d for d, s in drawn if d < 100}
    assert sum(abs(place[s] - place[s + 1]) for s in range(99)) / 99 == pytest.approx(100 / 3, rel=0.35)


def test_batches_of_an_epoch(spark):
    from tidemark.operators import samples

    numbered = spark.range(23).withColumnRenamed("id", "number")
    one, two = ({r.number: r.batch for r in samples.epoch_batches(numbered, 23, 5, e).collect()} for e in (0, 1))
    assert sorted(sum(b == k for b in one.values()) for k in range(5)) == [3, 5, 5, 5, 5]
    assert one != two
