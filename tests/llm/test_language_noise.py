"""Texts in no learned language go, however sure the share of the posterior is; clean texts stay."""

import random

from tidemark.llm import language_id

EN = "the house of the rising sun is where we were born and raised by people who had come over the great water many years before".split()
FR = "la maison du soleil levant est le lieu de notre naissance et les gens y sont venus par la grande eau depuis bien des ans".split()
FOREIGN = [
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "すべての人間は生まれながらにして自由であり",
]


def test_foreign_and_noise_go_and_clean_texts_stay(spark):
    rng = random.Random(2)
    clean = [" ".join(rng.choice((EN, FR)[i % 2]) for _ in range(rng.choice((3, 20, 300)))) for i in range(80)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n)) for n in (10, 60, 600)]
    noise += [" ".join(rng.choices(letters, k=200))]
    rows = [(i, t, ("en", "fr")[i % 2]) for i, t in enumerate(clean)] + [(100 + i, t, None) for i, t in enumerate(noise + FOREIGN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.accepted(docs).collect()} == set(range(80))
