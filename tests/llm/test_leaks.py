"""Leaks by characters and in short items: whatever lies within the declared edits is found."""

import random

import pytest

from tidemark.llm import decontaminate

WORDS = ["".join(random.Random(i).choices("etaoinshrdlu", k=2 + i % 7)) for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def spoiled(rng, item, n):
    """item with n characters replaced, left out or put in."""
    for _ in range(min(n, len(item) - 1)):
        i = rng.randrange(len(item))
        item = item[:i] + rng.choice(["", "z", "z" + item[i]]) + item[i + 1 :] or "z"
    return item


def found(item, texts, edits=decontaminate.EDITS):
    items = decontaminate.Items([(7, item)], edits)
    return {r for r, _, _ in decontaminate.leaks_in([decontaminate.normal(t) for t in texts], items)}


@pytest.mark.parametrize("words", [4, 8, 16, 25, 39, 59])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_scattered_character_edits(words, share):
    rng = random.Random(words)
    item = text(rng, words)
    n = int(share * len(item))
    texts = [f"{text(rng, i)} {spoiled(rng, item, n)} {text(rng, 30)}" for i in range(25)]
    assert found(item, texts) == set(range(25))


@pytest.mark.parametrize("words", range(1, 16))
def test_exact_copies_of_short_items_at_every_alignment(words):
    rng = random.Random(words)
    item = text(rng, words)
    texts = [f"{text(rng, i)} {item.upper()} {text(rng, j)}" for i in range(8) for j in (0, 1, 30)]
    assert found(item, texts) == set(range(24))


def test_same_as_the_distance_alone():
    rng = random.Random(3)
    items = [text(rng, n) for n in (1, 2, 3, 5, 12, 30)] + ["a", "ab", "né à", "x" * 40]
    texts = [t for item in items for n in range(6) for t in [f"{text(rng, rng.randrange(9))} {spoiled(rng, item, n)} {text(rng, 5)}", spoiled(rng, item, n)]] + ["", "a", "x" * 300, "é"]
    texts = [decontaminate.normal(t) for t in texts]
    for edits in (0.0, 0.2, 0.5):
        got = {(r, i) for r, i, _ in decontaminate.leaks_in(texts, decontaminate.Items(list(enumerate(items)), edits))}
        assert got == {(r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if t and decontaminate.distance(decontaminate.normal(x), t)[0] <= int(edits * len(decontaminate.normal(x)))}


def test_items_far_longer_than_a_chunk_and_across_chunks(monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    monkeypatch.setattr(decontaminate, "MOST_BINS", 100)
    rng = random.Random(9)
    items = [text(rng, n) for n in (6, 20, 60, 300)]
    texts = [f"{text(rng, 7 * i)} {spoiled(rng, x, len(x) // 6)} {text(rng, 20)}" for i in range(20) for x in items]
    got = {(r, i) for r, i, _ in decontaminate.leaks_in(texts, decontaminate.Items(list(enumerate(items)), 0.2))}
    assert {(r, r % 4) for r in range(len(texts))} <= got


def test_shards_of_the_benchmark_and_white_space(spark, monkeypatch):
    rng = random.Random(11)
    items = [text(rng, n) for n in (5, 12, 20, 30, 45)]
    docs = [f"{text(rng, 9)} {x.replace(' ', ' ' * (4 * i + 1))} {text(rng, 9)}" for i, x in enumerate(items)] + [items[2].replace(" ", "\n\t" * 20), "é " * 30000 + items[3], None, ""]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (None, None)], "item_id long, text string")
    want = {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 2), (6, 3)}
    for most in (decontaminate.SHARD_BYTES, 60):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", most)
        got = [(r.doc_id, r.item_id) for r in decontaminate.digest(frame, bench).collect()]
        assert len(got) == len(set(got)) and set(got) == want
