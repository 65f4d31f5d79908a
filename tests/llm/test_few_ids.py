"""Documents are not shuffled for the few that go, and words are told without work for each match or repeat."""

import random

import numpy as np
import pytest

from tidemark.llm import _common, decontaminate, language_id, secret_scan

ITEM = "a passage of the benchmark that should not be in the training text at all"


@pytest.mark.parametrize("most", [_common.FEW_KEYS, 0])
def test_few_ids_are_sent_to_the_documents(spark, monkeypatch, most):
    rows = [(1, "plain text", "s"), (2, f"before {ITEM} after", "s"), (2, "its second row", "s"), (None, f"x {ITEM}", "s"), (None, "y", "s"), (3, "password=Abc9kd83Jdk2mQ", "t"), (4, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(_common.few, "__defaults__", (most,))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept, want in ((decontaminate.without_leaks(docs, items), [1, 3, 4]), (secret_scan.without_live_secrets(docs), [None, None, 1, 2, 2, 4])):
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (most > 0) and ("SortMergeJoin" in plan) == (most == 0)
            assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_marks_are_in_every_match(spark):
    texts = ["PassWord: Abcdefgh1234", "passwd='Abcdefgh1234'", "SECRET=abcdefgh1234", "my token : abcdefgh1234", "API_KEY=abcdefgh1234", "apikey: abcdefgh1234", "pass word = abcdefgh1234", None]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.n_assign for r in secret_scan.digest(docs).collect()} == {i: int(i < 6) for i in range(8)}


def test_words_of_latin_texts_by_their_own_letters(monkeypatch):
    rng, general = random.Random(5), language_id._WORD
    latin = ["".join(chr(rng.randrange(1, 256)) for _ in range(rng.randrange(90))) for _ in range(2000)] + ["a m² ½x", "ÀÉ µ ª", "x" * 60, "", None]
    split = lambda t: [w for run in general.findall((t or "").lower()) for w in "".join(c if c.isalpha() else " " for c in run).split()]
    parts = lambda some: [w[i : i + language_id.PART] for w in some for i in range(0, len(w), language_id.PART)]
    want = [parts(split(t)) for t in latin]
    wide = ["Привет, мир m²", "İstanbul K", "中文 x½y"]
    assert [language_id.words(t) for t in wide] == [parts(split(t)) for t in wide]
    monkeypatch.setattr(language_id, "_WORD", None)  # not needed for these
    assert [language_id.words(t) for t in latin] == want


def test_arcs_against_plain_search():
    pieces = ["▁", "▁a", "a", "ab", "b", "abab", "ba", "é"]
    some = ["abab", "é", "xab", "b" * language_id.PART]
    lengths, _, groups = language_id.Lattice(pieces).arcs(some)
    got = {(end, size, int(w), int(p)) for end, size, words, of in groups for w, p in zip(words, of, strict=True)}
    marked = ["▁" + w for w in some]
    want = {(i + len(p), len(p), k, n) for k, w in enumerate(marked) for n, p in enumerate(pieces) for i in range(len(w)) if w.startswith(p, i)}
    want |= {(i + 1, 1, k, len(pieces)) for k, w in enumerate(marked) for i, c in enumerate(w) if c not in pieces}
    assert got == want and [g[:2] for g in groups] == sorted({g[:2] for g in got}) and lengths.tolist() == [len(w) for w in marked]


def test_known_words_are_scored_once_and_a_full_cache_starts_anew(monkeypatch):
    model = language_id.Model(["▁", "a", "b", "c"], ["x", "y"], np.array([[0.1, 0.5, 0.2, 0.1, 1e-7], [0.1, 0.1, 0.2, 0.5, 1e-7]]))
    texts = ["a b ab", "abc c", None, "12", "a a a b", "cab"]
    want = language_id.Scorer(model).sums(texts)
    scorer, asked = language_id.Scorer(model), []
    forward = scorer.lattice.forward
    monkeypatch.setattr(scorer.lattice, "forward", lambda some, p: (asked.extend(some), forward(some, p))[1])
    for _ in range(2):
        assert all((x == y).all() for x, y in zip(scorer.sums(texts), want, strict=True))
    assert sorted(asked) == ["a", "ab", "abc", "b", "c", "cab"]
    monkeypatch.setattr(language_id, "CACHE_WORDS", 6)
    scorer.sums(["bb"])
    assert list(scorer.rows) == ["bb"] and (scorer.sums(texts)[0] == want[0]).all()
