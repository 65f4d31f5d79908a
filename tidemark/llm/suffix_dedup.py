"""Suffix-array dedup by sorting sampled suffixes and inducing the others.

Sampled are the suffixes at anchors (content-defined places). Shards are dealt by anchor, and Spark's external sort,
which spills to disk, brings an anchor's suffixes together; batches of whole anchors are then put in the order of their
next 200 bytes, with the common-prefix value of neighbours, and so are the bytes that stand before the anchors, read
backwards. Both orders induce for every suffix in between the class of its first 200 bytes: of a suffix that starts o
bytes before its anchor, o bytes are before the anchor and the rest after it.

Where this departs from external induced sorting: one level of samples in place of a recursion, and Spark's sort in
place of priority queues of its own. The order of all suffixes is never made: its tuples alone would take some 24 bytes
of disk for each byte of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm._common import mix
from tidemark.llm._repeats import Unit, find

WINDOW, GRAM = 200, 50
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))


def _symbols(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data) + 1)
    return _BYTES[data], np.asarray(offsets), at[:-1], at[1:]


def _summary(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray | None) -> tuple[int, str]:
    return len(data), hashlib.sha256((data if keep is None else data[keep]).tobytes()).hexdigest()


UNIT = Unit(WINDOW, GRAM, _symbols, _summary, False)


def _ordered(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row in the sorted order, and by rank the bytes that a row has in common with the one before."""
    n = len(rows)
    table = np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
    sizes = np.fromiter((min(len(r), width) for r in rows), np.int64, n)
    # Rows that the padding makes equal differ in their length: the shorter one comes first.
    order = np.lexsort((sizes, table.view(f"S{width}").ravel())) if width else np.arange(n)
    sorted_rows, sizes = table[order], sizes[order]
    common = np.zeros(n, np.int64)
    if n > 1 and width:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, common


def match(segments: list) -> list[np.ndarray]:
    """For each segment (anchor, place, low, high, number, windows, bytes), how often each of its windows occurs."""
    place = np.fromiter((s[1] for s in segments), np.int64, len(segments))
    number = np.fromiter((s[4] for s in segments), np.int64, len(segments))
    windows = np.fromiter((s[5] for s in segments), np.int64, len(segments))
    right, common_right = _ordered([s[6][s[1] :] for s in segments], WINDOW)
    left, common_left = _ordered([s[6][: s[1]][::-1] for s in segments], WINDOW - GRAM)
    values = [np.zeros(w, np.int64) for w in windows]
    for o in range(WINDOW - GRAM + 1):  # suffixes that start o bytes before their anchor
        some = np.flatnonzero((place >= o) & (place - o < windows))
        if not len(some):
            continue
        after, before = np.cumsum(common_right < WINDOW - o)[right[some]], np.cumsum(common_left < o)[left[some]]
        _, which = np.unique(after * (len(segments) + 1) + before, return_inverse=True)
        times = np.bincount(which, number[some]).astype(np.int64)[which]
        for i, t in zip(some.tolist(), times.tolist(), strict=True):
            values[i][place[i] - o] = t
    return values


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, removed, spans, sha) per row of docs: bytes, bytes removed, maximal runs of them, SHA-256 of the rest.

    A byte goes if a string of 200 bytes over it also starts anywhere else, in the same row or another. Null texts are
    empty. Repeated rows are two texts, so each loses what it shares with the other.
    """
    return find(docs, UNIT, match, id_col, text_col)


def digest(docs: DataFrame) -> DataFrame:
    """op4's columns for documents."""
    r = repeats(docs)
    return r.select(r.id.alias("doc_id"), r.n.alias("n_bytes"), r.removed.alias("n_removed"), r.spans.alias("n_spans"), r.sha.alias("kept_sha256"))

#: The same in SQL: the hash of every window, so for small tables.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200)::INT, 1) AS new FROM g)),
o AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM b GROUP BY doc_id, run),
q AS (SELECT o.doc_id, a, z, h, coalesce(lag(z) OVER (PARTITION BY o.doc_id ORDER BY a), 0) AS before FROM o JOIN d USING (doc_id)),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS m, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """By id: bytes, removed, spans, sha; for tests."""
    data = {i: (t or "").encode() for i, t in rows}
    count: dict[bytes, int] = {}
    for d in data.values():
        for j in range(len(d) - WINDOW + 1):
            count[d[j : j + WINDOW]] = count.get(d[j : j + WINDOW], 0) + 1
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for j in range(len(d) - WINDOW + 1):
            if count[d[j : j + WINDOW]] > 1:
                gone[j : j + WINDOW] = True
        gone = gone[:-1]
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return out
