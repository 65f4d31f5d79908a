"""What a worker holds of a batch of texts, and of the arcs of words, is bounded."""

import numpy as np

from tidemark.llm import language_id


def test_texts_are_judged_in_slices_of_arrow_batches(spark):
    docs = spark.createDataFrame([(i, "the house of the people" if i % 3 else None, "en", 1.5) for i in range(1200)], "doc_id long, text string, lang string, x double")
    kept = language_id.accepted(docs)
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "ArrowEvalPython" not in text
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [tuple(r) for r in docs.where("text IS NOT NULL").orderBy("doc_id").collect()]


def test_arcs_of_bounded_words_give_the_same(monkeypatch):
    pieces = language_id.vocabulary()[:4000]
    lattice, p = language_id.Lattice(pieces), np.full((2, len(pieces) + 1), 1e-4)
    some, asked, arcs = [f"{'ab' * (i % 7)}{'xyz'[i % 3]}{'e' * (i % 5)}" for i in range(9000)], [], lattice.arcs
    monkeypatch.setattr(lattice, "arcs", lambda part: (asked.append(len(part)), arcs(part))[1])
    scores, used = lattice.forward(some, p), lattice.expected(some, np.ones(len(some)), p[0])
    assert max(asked) <= 4000 and sum(asked) == 18000
    monkeypatch.setattr(language_id, "ARC_WORDS", 10**6)
    assert (scores == lattice.forward(some, p)).all() and np.allclose(used, lattice.expected(some, np.ones(len(some)), p[0]))
