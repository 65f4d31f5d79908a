"""The pipeline on a small corpus: what each stage has to drop, and nothing else."""

import random

import duckdb

import corpus_pipeline
from tidemark.llm import decontaminate, language_id, poisson_mix, secret_scan

EN = "the of and to in is that was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(EN) for _ in range(n))
    item = text(40)
    rows = [(i, text(80), "en", f"s{i % 3}") for i in range(60)]
    base = rows[0][1]
    rows += [(60, base, "en", "s1"), (61, base + " extra", "en", "s1"), (62, text(20) + " " + item + " " + text(20), "en", "s2")]
    rows += [(63, text(60) + " token = 'Zq8fK2mX7pLw4tRb'", "en", "s0"), (64, None, None, None), (65, "12 34", "en", "s0")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    gone = [{64, 65}, {60, 61}, {62}, {63}]
    left = {r[0] for r in rows}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(stage(spark, docs, str(tmp_path)), name)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if n < 4:
            left -= gone[n]
            assert docs.columns == columns and set(ids) == left, name
        else:
            assert set(ids) <= left and docs.columns == [*columns, "copies", "replica", "shuffle_key"]
            assert docs.where("replica >= copies").count() == 0


def test_a_run_against_brute_force(spark):
    """Every stage on the smallest given tables, against each text judged alone, all pairs, all items, and SQL."""
    where = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{where}/documents.parquet")
    rows = {r.doc_id: r for r in frame.collect()}
    judge = language_id.Judge(language_id.fit(frame))
    left = {}
    for i, r in rows.items():
        (lang,), (score,), (gain,) = judge.judged([r.text])
        if lang != "und" and score >= 0.5 and gain >= language_id.LEAST_GAIN:
            left[i] = r
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: decontaminate._SPACE.sub(" ", r.text.translate(low)).strip(" ").split(" ") for i, r in left.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                one, two = sorted((group[a], group[b]))
                group = {i: one if g == two else g for i, g in group.items()}
    left = {i: r for i, r in left.items() if group[i] == i}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    left = {i: r for i, r in left.items() if not any(decontaminate.distance(x, decontaminate.normal(r.text))[0] <= int(decontaminate.EDITS * len(x)) for x in items)}
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(list(left.values()), frame.schema).toPandas())
    live = {r[0] for r in con.execute(f"SELECT doc_id FROM ({secret_scan.ORACLE_SQL}) WHERE n_live > 0").fetchall()}
    left = {i: r for i, r in left.items() if i not in live}
    con.register("documents", spark.createDataFrame(list(left.values()), frame.schema).toPandas())
    want = con.execute(f"SELECT doc_id, copies, replica, shuffle_key FROM ({poisson_mix.ORACLE_SQL})").fetchall()
    got = corpus_pipeline.run(spark, where)
    assert sorted((r.doc_id, r.copies, r.replica, r.shuffle_key) for r in got.collect()) == sorted(want)
    assert 0 < len(left) < len(rows) and {r.doc_id: r.text for r in got.collect()}.items() <= {i: r.text for i, r in rows.items()}.items()


def test_odd_tables(spark, tmp_path):
    """An empty table; null and repeated ids, clashing columns and null texts: whole rows stay or go, and no stage fails."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(EN) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, replica string, gone_id long, leak_id long, held_id long, node long, id long"
    more = ("c", "r", 1, 2, 3, 4, 5)
    twice = text(90)
    rows = [(i, text(70), "en", "a", 0, *more) for i in range(30)] + [(None, text(70), None, None, None, *more), (None, twice, "en", "a", 0, *more), (7, text(60), "en", "b", 0, *more), (40, twice, "en", "b", 0, *more), (41, twice, "en", "b", 0, *more), (42, None, "en", "b", 0, *more)]
    spark.createDataFrame([(0, text(40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "replica").where("replica = 0").collect()]
    assert 41 not in ids and 42 not in ids and {i for i in ids if i is not None} <= set(range(30)) | {40}
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
