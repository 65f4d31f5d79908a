"""Items are counted whole, by pieces that do not overlap: few hits a character, and the same leaks whichever pieces are taken."""

import random

import numpy as np

from tidemark.llm import decontaminate

WORDS = ["".join(random.Random(i).choices("etaoinshrdlu", k=2 + i % 7)) for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_no_more_entries_than_a_quarter_of_the_characters():
    items = decontaminate.Items([(i, text(random.Random(i), 20 + i)) for i in range(40)], 0.2)
    assert sum(len(g.entries) for g in items.groups) * decontaminate.GRAM <= sum(map(len, items.texts))
    assert sum(len(g.owners) for g in items.groups) == 40


def test_pieces_do_not_overlap_and_are_enough():
    draw = np.random.default_rng(1)
    for n, q, edits in [(1, 1, 0), (3, 1, 1), (1604, 4, 400), (4, 4, 0), (20, 4, 4), (81, 4, 16), (226, 4, 45), (2000, 4, 400), (9, 2, 3), (33, 3, 8)]:
        for often in (draw.random(n - q + 1) / 500, np.full(n - q + 1, 0.3)):
            at = decontaminate.chosen(often, q, edits)
            assert edits < len(at) <= n // q and at[0] >= 0 and at[-1] + q <= n and (np.diff(at) >= q).all()


def test_leaks_are_the_same_whatever_texts_the_pieces_were_chosen_by():
    rng = random.Random(5)
    items = [text(rng, n) for n in (4, 9, 20, 45, 60, 400)]
    texts = []
    for x in items * 4:
        for _ in range(len(x) // 6):
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice(["", "z", "z" + x[i]]) + x[i + 1 :]
        texts.append(f"{text(rng, rng.randrange(80))} {x} {text(rng, 9)}")
    found = [decontaminate.leaks_in(texts, decontaminate.Items(list(enumerate(items)), 0.2, by)) for by in ((), texts, ["zz"], [items[3]] * 50)]
    assert all(f == found[0] for f in found) and {(r, r % 6) for r in range(24)} <= {f[:2] for f in found[0]}


def test_normal_forms_of_text_and_of_bytes():
    for t in ["", " A\tB  é Ü \x0b\x0c\r\n z ", "\U0001f600 X", " a"]:
        assert decontaminate.normal_bytes(t.encode()) == decontaminate.normal(t)
    assert decontaminate.normal("É A  B\t\tC ") == "É a  b c" and decontaminate.normal_bytes(b"A \xff B") == "a b"
