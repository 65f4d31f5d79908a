"""Periodic runs of words by recompression.

The words of many documents, with a mark of its own between any two, become one string that is rewritten in turns: runs
of a letter become one letter (block compression), and then pairs of a left letter and a right letter do (pair
compression, each letter being left or right by a hash). The turns are the levels of a grammar that gives equal parts
of the string the same letters but for their ends. How far two places agree is found by going up the levels as long as
letters agree, and down again where they don't.

A run of period p holds a multiple p * k of p, counted from its document's start, whose word agrees with the word p
later. For all periods these grid places are n log n; where their words agree, exact extensions to both sides tell the
run. Documents are independent, so Spark deals them out as they are read, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import CRC_SQL, CRC_TABLE, mix, pieces

#: A run is at least so long, and twice its period.
SHORTEST = 12
#: Grid places that are compared at a time.
CHUNK = 1_000_000


class Level:
    """A string of letters, and how it is put together to the next level: up (parent of each) and down (first child of each parent)."""

    __slots__ = ("block", "down", "sym", "up")

    def __init__(self, sym: np.ndarray, starts: np.ndarray | None = None, block: bool = False):
        """starts: marks where a letter of the next level starts; None for the last level."""
        self.sym, self.block = sym, block
        if starts is not None:
            self.up = (np.cumsum(starts) - 1).astype(np.int32)
            self.down = np.append(np.flatnonzero(starts), len(sym)).astype(np.int32)

    def mirrored(self) -> Level:
        out = Level.__new__(Level)
        out.sym, out.block = self.sym[::-1], self.block
        if hasattr(self, "up"):
            out.up = (len(self.down) - 2 - self.up)[::-1]
            out.down = (len(self.sym) - self.down)[::-1]
        return out


def _renamed(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """A letter from first on for each distinct key."""
    distinct, place = np.unique(keys, return_inverse=True)
    return (first + place).astype(np.int32), first + len(distinct)


def grammar(sym: np.ndarray) -> list[Level]:
    """Levels from the string (int32, letters from 0) to a single letter."""
    letters, levels, turn = int(sym.max(initial=0)) + 1, [], 0
    while len(sym) > 1:
        starts = np.empty(len(sym), bool)
        starts[0] = True
        np.not_equal(sym[1:], sym[:-1], out=starts[1:])
        if not starts.all():
            level = Level(sym, starts, True)
            levels.append(level)
            length = np.diff(level.down)
            up = sym[level.down[:-1]].copy()
            many = np.flatnonzero(length > 1)
            up[many], letters = _renamed(up[many].astype(np.int64) * (int(length.max()) + 1) + length[many], letters)
            sym = up
        left = (mix(sym.astype(np.uint64) + np.uint64((turn << 40) + 1)) & np.uint64(1)).astype(bool)
        turn += 1
        pair = left[:-1] & ~left[1:]
        if not pair.any():
            continue
        starts = np.ones(len(sym), bool)
        starts[1:][pair] = False
        level = Level(sym, starts)
        levels.append(level)
        first = np.flatnonzero(pair)
        up = sym[level.down[:-1]].copy()
        up[level.up[first]], letters = _renamed(sym[first].astype(np.int64) << 32 | sym[first + 1], letters)
        sym = up
    levels.append(Level(sym))
    return levels


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each i != j, how many letters from there on agree. Both ends of the string need a letter that occurs once."""
    a, b, top = i.astype(np.int32), j.astype(np.int32), np.zeros(len(i), np.int32)
    active = np.flatnonzero(levels[0].sym[a] == levels[0].sym[b])
    for n, level in enumerate(levels[:-1]):
        if not len(active):
            break
        x, y = a[active], b[active]
        up_x, up_y = level.up[x], level.up[y]
        # Letters agree here. Where not both begin a letter above, these ones are passed over, and both do then.
        inside = np.flatnonzero((level.down[up_x] != x) | (level.down[up_y] != y))
        if len(inside):
            p, q = x[inside], y[inside]
            if level.block:
                left_p, left_q = level.down[up_x[inside] + 1] - p, level.down[up_y[inside] + 1] - q
                step, ends = np.minimum(left_p, left_q), left_p != left_q
            else:
                step, ends = 1, np.zeros(len(p), bool)
            x[inside], y[inside] = p + step, q + step
            stays = np.zeros(len(x), bool)
            stays[inside[ends]] = True
            a[active], b[active] = x, y
            active, x, y = active[~stays], x[~stays], y[~stays]
            # a pair's second letter, passed over, may be followed by letters that differ
            differs = level.sym[x] != level.sym[y]
            active, x, y = active[~differs], x[~differs], y[~differs]
            up_x, up_y = level.up[x], level.up[y]
        a[active], b[active], top[active] = up_x, up_y, n + 1
        above = levels[n + 1].sym
        active = active[above[up_x] == above[up_y]]
    for n in range(int(top.max(initial=0)), 0, -1):
        at = np.flatnonzero(top >= n)
        level = levels[n - 1]
        x, y = level.down[a[at]], level.down[b[at]]
        same = np.flatnonzero(level.sym[x] == level.sym[y])
        if level.block:
            p, q = a[at[same]], b[at[same]]
            step = np.minimum(level.down[p + 1] - level.down[p], level.down[q + 1] - level.down[q])
        else:
            step = 1
        x[same] += step
        y[same] += step
        a[at], b[at] = x, y
    return a.astype(np.int64) - i


def runs_of(sym: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; documents are sym[first : first + n], with letters that occur once around them."""
    levels = grammar(sym)
    back, size = [level.mirrored() for level in levels], len(sym)
    half = n // 2
    doc = np.repeat(np.arange(len(n)), half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (n[doc] - 1) // period
    ends = np.cumsum(count)
    found = [np.empty((0, 3), np.int64)]
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        c = count[a:b]
        p = np.repeat(period[a:b], c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        i = np.repeat(first[doc[a:b]], c) + k * p
        same = np.flatnonzero(sym[i] == sym[i + p])
        i, p = i[same], p[same]
        ahead = agreement(levels, i, i + p)
        behind = agreement(back, size - i, size - i - p)  # from i - 1 and i + p - 1 backwards
        whole = np.flatnonzero((ahead + behind >= p) & (ahead + behind + p >= SHORTEST))
        i, p, ahead, behind = i[whole], p[whole], ahead[whole], behind[whole]
        found.append(_least(np.stack([i - behind, i + p + ahead, p], 1)))
        a = b
    return tuple(_least(np.concatenate(found)).T)


def _least(rows: np.ndarray) -> np.ndarray:
    """Of (start, end, period) the least period of each stretch: its smallest, as stretches hold two of each; by start and period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _told(docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """For each document of words: (start, length, period) of its runs, and its kept words."""
    numbers: dict[bytes, int] = {}
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    first = np.cumsum(n + 1) - n  # a mark before each document, and one at the end
    sym = np.empty(int(n.sum()) + len(n) + 1, np.int32)
    for d, f in zip(docs, first.tolist(), strict=True):
        sym[f : f + len(d)] = [numbers.setdefault(w, len(numbers)) for w in d]
    marks = np.append(first - 1, len(sym) - 1)
    sym[marks] = len(numbers) + np.arange(len(marks))
    start, end, period = runs_of(sym, first, n)
    cover = np.zeros(len(sym) + 1, np.int32)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    keep = np.cumsum(cover) == 0
    cuts = np.searchsorted(start, first).tolist() + [len(start)]
    told, kept = [], []
    for d, f, a, b in zip(docs, first.tolist(), cuts, cuts[1:], strict=False):
        told.append(np.stack([start[a:b] - f, end[a:b] - start[a:b], period[a:b]], 1))
        kept.append(b" ".join(d if a == b else [w for w, k in zip(d, keep[f : f + len(d)].tolist(), strict=True) if k]))
    return told, kept


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct(start, length, period)> by start and period, collapsed string), one row per row of docs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, numbered from 0. A run is a stretch of words of smallest
    period q that is at least 12 and 2 q words long and that no neighbouring word extends. collapsed has the words left,
    joined by a space, when of each run only the first q words stay (a word goes if any run says so). Null and empty
    texts have no runs and no words. Null ids stay null, repeated rows get a result each, other columns aren't read. A
    task holds the words of 2 MB of texts, or of one longer text (some 250 bytes a word).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch):
                raw, cuts = data.tobytes(), offsets.tolist()
                told, kept = _told([raw[s:e].split() for s, e in zip(cuts, cuts[1:], strict=False)])
                rows = np.concatenate(told)
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=list(RUN.value_type))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, told)]).astype(np.int32), structs)
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, texts], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts with their periodic runs cut down to one period."""
    return find(docs, id_col, text_col).select("id", F.col("collapsed").alias("text"))


def with_periods(text: Column, key: Column) -> Column:
    """The text with a period planted where crc32 of the decimal key is a multiple of 10; null keys and texts without words stay as they are."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(key.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    made = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """op11's columns for documents."""
    rows = find(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    # The greatest length; of equal ones the least start, then the least period: runs are in that order.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] > x["length"], r).otherwise(x))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = rows.select("id", "runs", "collapsed", best.alias("best"), told.alias("told"))
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Joins equal words of a document, so for small tables: the matches of each distance are cut into stretches.
ORACLE_SQL = rf"""
WITH {CRC_TABLE},
  d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {CRC_SQL.format(id="doc_id")} AS h FROM documents, crc_table),
  planted AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END + 1] FOR i IN range(0, len(w))] ELSE w END AS w
    FROM (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d)),
  word AS (SELECT doc_id, i, w[i + 1] AS x FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM planted)),
  same AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
  stretch AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island HAVING count(*) >= p AND count(*) + p >= {SHORTEST}),
  run AS (SELECT doc_id, s, n, min(p) AS p FROM stretch GROUP BY ALL),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + n)) AS i FROM run),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
  told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS t, first(struct_pack(s := s, n := n, p := p) ORDER BY n DESC, s, p) AS best FROM run GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period, 1000 * best.n // best.p AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def brute(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, for tests."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - s >= p and i - s + p >= SHORTEST:
                out.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))
