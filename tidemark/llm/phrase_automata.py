"""Substring dedup by repeated-phrase automata.

Shards hold all stretches of text around some anchors, from all documents that have them. In a shard, phrases of 50
words whose hashes recur in different stretches are compiled into an Aho-Corasick automaton over the shard's words, and
the stretches of all documents are streamed through it: it tells where each phrase truly occurs, and so the first
document that has it. Text without a recurring anchor can't hold such a phrase and is not sent to any shard.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm._common import mix, word_hashes, words_of
from tidemark.llm._repeats import Unit, find, grams

WINDOW, GRAM = 50, 20
#: Segments whose phrases share an automaton.
SHARD = 1000


def _symbols(data: np.ndarray, offsets: np.ndarray):
    start, end, first = words_of(data, offsets)
    return word_hashes(data, start, end), first, start, end


def _summary(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray | None) -> tuple[int, str]:
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] if keep is None else [raw[a:b] for a, b, k in zip(start.tolist(), end.tolist(), keep.tolist(), strict=True) if k]
    return len(start), hashlib.sha256(b" ".join(words)).hexdigest()


UNIT = Unit(WINDOW, GRAM, _symbols, _summary, True)
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_TO_SPACE = bytes.maketrans(_SPACE, b" " * len(_SPACE))


#: Stands for all words that occur once in a shard, which no recurring phrase has.
_LONE = 1


def match(segments: list) -> list[np.ndarray]:
    """For each segment (anchor, place, low, high, number, windows, bytes), the least id in which each of its windows occurs."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(segments):
        b = min(len(segments), a + SHARD)
        while b < len(segments) and segments[b][0] == segments[b - 1][0]:
            b += 1
        out += _located(segments[a:b])
        a = b
    return out


def _located(segments: list) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    codes = [np.array([numbers.setdefault(w, len(numbers)) for w in s[6].translate(_TO_SPACE).split(b" ") if w]) for s in segments]
    often = np.bincount(np.concatenate(codes), minlength=len(numbers)) > 1
    letter = np.cumsum(often) - 1
    letter = np.where(often, np.where(letter < 0xD000, letter + 2, letter + 0x1000), _LONE).astype(np.uint32)  # no surrogates
    codes = [letter[c] for c in codes]
    texts = [c.tobytes().decode("utf-32-le") for c in codes]
    # confirm: hashes of phrases that recur, of those without a lone word
    hashes, places = [], []
    for i, (s, c) in enumerate(zip(segments, codes, strict=True)):
        h = grams(mix(c.astype(np.uint64)), WINDOW)[: s[5]]
        lone = np.cumsum(np.r_[0, c == _LONE])
        whole = np.flatnonzero(lone[WINDOW : WINDOW + len(h)] == lone[: len(h)])
        hashes.append(h[whole])
        places.append(np.stack([np.full(len(whole), i), whole], 1))
    _, first_of, times = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
    recurring = np.concatenate(places)[first_of[times > 1]].tolist()
    values = [np.full(s[5], s[2], np.int64) for s in segments]
    if not recurring:
        return values
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, (i, a) in enumerate(recurring):
        automaton.add_word(texts[i][a : a + WINDOW], n)
    automaton.make_automaton()
    first = np.full(len(recurring), np.iinfo(np.int64).max)
    met = []
    for s, t in zip(segments, texts, strict=True):
        found = np.array([(end - WINDOW + 1, n) for end, n in automaton.iter(t)], np.int64).reshape(-1, 2)
        found = found[found[:, 0] < s[5]]
        met.append(found)
        first[found[:, 1]] = np.minimum(first[found[:, 1]], s[2])
    for v, found in zip(values, met, strict=True):
        v[found[:, 0]] = first[found[:, 1]]
    return values


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, removed, spans, sha) per row of docs: words, words removed, runs of them, SHA-256 of the kept words.

    A word goes if a window of 50 words over it also starts in a row with a smaller id. Null texts have no words.
    Repeated rows don't remove each other, as their ids are equal; a null id is before all others.
    """
    return find(docs, UNIT, match, id_col, text_col)


def digest(docs: DataFrame) -> DataFrame:
    """op2's columns for documents, and n_spans (runs of removed words)."""
    r = repeats(docs)
    return r.select(r.id.alias("doc_id"), r.n.alias("n_words"), r.removed.alias("n_removed"), r.sha.alias("kept_sha256"), r.spans.alias("n_spans"))

#: The same in SQL: the hash of every window, so for small tables.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM k) WHERE m < doc_id),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INT, 1) AS new FROM g)),
o AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM b GROUP BY doc_id, run),
c AS (SELECT doc_id, list(x ORDER BY x) AS gone, any_value(m) AS m FROM (SELECT doc_id, unnest(range(a, z)) AS x, count(*) OVER (PARTITION BY doc_id) AS m FROM o) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS m FROM o GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x))) END, ' ')) AS kept_sha256, coalesce(m.m, 0)::BIGINT AS n_spans
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """By id: words, removed, sha; for tests."""
    words = {i: [w for w in (t or "").encode().translate(_TO_SPACE).split(b" ") if w] for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for j in range(len(words[i]) - WINDOW + 1):
            first.setdefault(tuple(words[i][j : j + WINDOW]), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - WINDOW + 1):
            if first[tuple(w[j : j + WINDOW])] < i:
                gone[j : j + WINDOW] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out
