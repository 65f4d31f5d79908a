"""Fixed-length windows that repeat across a corpus: what the two substring operators share.

Of every window's grams the least (by hash, leftmost first) is the window's anchor, so that equal windows have equal
anchors at the same place. Anchors that occur once rule out their windows without a look at the text. For the others,
the stretch of text under an anchor's windows is a segment; equal segments are told apart by number only, and different
segments of one anchor meet in one task, which finds the windows they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import BASE, INVERSE, keyed, mix, pieces, powers, stage

#: Different segments of one anchor beyond which its windows are segments of their own, so that no task gets a hot anchor; they are judged alike.
HOT = 20_000
#: Segments that are compared at a time (whole anchors).
BATCH = 4000
#: Hashed differently from the anchors: names of segments and windows.
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Unit:
    """What a window is made of.

    symbols(data, offsets): a 64-bit hash of each symbol, the symbols before each row, and each symbol's first and end
    byte. summary(data, start, end, keep): n, sha256 of what is kept (keep: a mask of the row's symbols, or None).
    """

    window: int
    gram: int
    symbols: Callable
    summary: Callable
    #: True where a window must start in a document of a smaller id; else it must start anywhere else.
    smaller: bool


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place; the last k - 1 places have none."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(INVERSE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * powers(BASE, n - k + 1))


def least(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least of the w grams from each place on (by the top 48 bits)."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    blocks = -(-len(g) // w) + 1
    top = np.full(blocks * w, 2**64 - 1, np.uint64)
    top[: len(g)] = g
    top &= np.uint64(0xFFFF_FFFF_FFFF_0000)
    top = top.reshape(blocks, w)
    at = np.arange(w, dtype=np.uint64)
    left = np.minimum.accumulate((top | at)[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(top | (at + np.uint64(w)), axis=1).ravel()
    i = np.arange(n)
    inside = i % w
    best = np.where(inside == 0, left[:n], np.minimum(left[:n], right[i + w - 1]))
    return i - inside + (best & np.uint64(0xFFFF)).astype(np.int64)


def anchors(h: np.ndarray, first: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """row, gram hash, place, first and last window start (places within the row) of each anchor."""
    g = grams(h, unit.gram)
    best = least(g, unit.window - unit.gram + 1)
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    i = np.arange(len(best))
    fits = first[1:][row[: len(best)]] - i >= unit.window
    i = i[fits]
    a, r = best[fits], row[: len(best)][fits]
    if not len(i):
        return (np.empty(0, np.int64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    last = np.r_[new[1:], len(i)] - 1
    base = first[r[new]]
    return r[new], g[a[new]], a[new] - base, i[new] - base, i[last] - base


def packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's bytes, compressed: texts are shuffled in this form."""
    raw = data.tobytes()
    return pa.array([pa.compress(raw[a:b], "zstd", asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())


def unpacked(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As pieces() of _common, for columns (…, z, size)."""
    z, sizes = batch.column(batch.schema.get_field_index("z")).to_pylist(), batch.column(batch.schema.get_field_index("size")).to_pylist()
    at = 0
    while at < len(z):
        end, total = at, 0
        while end < len(z) and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        parts = [pa.decompress(x, n, "zstd", asbytes=True) if n else b"" for x, n in zip(z[at:end], sizes[at:end], strict=True)]
        yield at, end, np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum(sizes[at:end])].astype(np.int64)
        at = end


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).view(np.int64) if x.dtype == np.uint64 else x)


def find(docs: DataFrame, unit: Unit, match: Callable, id_col: str, text_col: str) -> DataFrame:
    """(id, n, removed, spans, sha): one row per row of docs.

    match(segments): segments are (anchor, place of the anchor, ids' least, ids' largest, occurrences, windows, bytes)
    of whole anchors; gives for each an array over its windows: the least id that has the window where unit.smaller,
    else how often the window occurs.
    """
    rows = keyed(docs, id_col, text_col)
    text = rows.select("id", "dig", "no_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "dig", "no_id", "gram", "at", "lo", "hi", "n", "sha"]
        for batch in batches:
            for a, b, data, offsets in pieces(batch):
                h, first, start, end = unit.symbols(data, offsets)
                row, gram, at, lo, hi = anchors(h, first, unit)
                ids, digs, none = (batch.column(c).slice(a, b - a) for c in (0, 1, 2))
                told = [unit.summary(data[offsets[i] : offsets[i + 1]], start[first[i] : first[i + 1]] - offsets[i], end[first[i] : first[i + 1]] - offsets[i], None) for i in range(b - a)]
                m, rows_ = len(row), pa.array(row)
                empty = lambda kind, k: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays([ids, digs, none, *(empty(pa.int64(), b - a),), *(empty(pa.int32(), b - a),) * 3, pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told])], names)
                if m:
                    yield pa.RecordBatch.from_arrays([ids.take(rows_), digs.take(rows_), none.take(rows_), _longs(gram), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi)), empty(pa.int64(), m), empty(pa.string(), m)], names)

    table = stage(text.mapInArrow(scan, "id long, dig long, no_id boolean, gram long, at int, lo int, hi int, n long, sha string"), "repeats-anchors")
    marks = table.where("gram IS NOT NULL").select("id", "dig", "gram", "at", "lo", "hi")
    if unit.smaller:
        again = marks.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("gram")
    else:
        again = marks.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram")
    # Staged, so that a gram which very many rows have is a skewed join's, which is split, and not an aggregate's.
    again = stage(again, "repeats-again")
    listed = marks.join(again, "gram").groupBy("id", "dig").agg(F.collect_set(F.struct("at", "lo", "hi", "gram")).alias("marks"))  # of one document; equal rows' meet

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offsets)), packed(data, offsets)], ["id", "dig", "size", "z"])

    held = stage(rows.select("id", "dig", "text").mapInArrow(pack, "id long, dig long, size long, z binary").join(listed, ["id", "dig"]), "repeats-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments: every one with its name, and once a task with its bytes, its ids and number of occurrences in the task."""
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            every = batch.column(batch.schema.get_field_index("marks"))
            for a, b, data, offsets in unpacked(batch):
                h, first, start, end = unit.symbols(data, offsets)
                mark = every.slice(a, b - a)
                sizes = np.asarray(mark.value_lengths())
                flat = mark.flatten()
                row = np.repeat(np.arange(b - a), sizes)
                at, lo, hi = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "lo", "hi"))
                gram = flat.field("gram").to_numpy()
                begin, stop = first[row] + lo, first[row] + hi + unit.window
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ _SALT) * powers(INVERSE, len(h)), out=sums[1:])
                name = mix((sums[stop] - sums[begin]) * powers(BASE, len(h) + 1)[begin] + mix((stop - begin).astype(np.uint64) * np.uint64(BASE) + (at - lo).astype(np.uint64))).view(np.int64)
                ids = batch.column(0).slice(a, b - a).to_numpy()
                first_byte, end_byte = start[begin], end[stop - 1]
                raw = data.tobytes()
                for i, key in enumerate(zip(gram.tolist(), name.tolist(), strict=True)):
                    who = int(ids[row[i]])
                    known = seen.get(key)
                    if known is None:
                        seen[key] = [int(at[i] - lo[i]), who, who, 1, int(hi[i] - lo[i]) + 1, raw[first_byte[i] : end_byte[i]]]
                    else:
                        known[1], known[2], known[3] = min(known[1], who), max(known[2], who), known[3] + 1
                n = len(row)
                if n:
                    yield _segments(gram, name, [batch.column(c).slice(a, b - a).take(pa.array(row)) for c in (0, 1)], lo, None, n)
                if len(seen) > 200_000:
                    yield from _told(seen)
                    seen = {}
        yield from _told(seen)

    kinds = "gram long, name long, id long, dig long, lo int, at int, low long, high long, m long, windows int, bytes binary"
    segments = stage(held.mapInArrow(cut, kinds), "repeats-segments")
    bodies = segments.where("bytes IS NOT NULL").select("gram", "name", "at", "low", "high", "m", "windows", "bytes")
    crowded = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("gram")
    crowded = stage(crowded, "repeats-crowded")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments come in the order of their anchors; whole anchors are compared together."""
        waiting: list[tuple] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(waiting) >= BATCH and x[0] != waiting[-1][0]:
                    yield from _compared(waiting, match, unit)
                    waiting = []
                waiting.append(x)
        if waiting:
            yield from _compared(waiting, match, unit)

    runs = "gram long, name long, runs array<struct<a:int,b:int,v:long>>"
    plain = bodies.join(crowded, "gram", "left_anti") if not crowded.isEmpty() else bodies
    judged = plain.repartition("gram").sortWithinPartitions("gram", "name").mapInArrow(compare, runs)
    if not crowded.isEmpty():
        each, alone = _single(bodies.join(crowded, "gram"), unit)
        told = alone.repartition("gram").sortWithinPartitions("gram", "name").mapInArrow(compare, runs)
        told = told.select(F.col("gram").alias("one"), F.col("name").alias("two"), F.col("runs")[0]["v"].alias("v"))
        run = F.struct(F.col("o").alias("a"), (F.col("o") + 1).alias("b"), F.col("v"))
        back = each.join(told, ["one", "two"]).groupBy("gram", "name").agg(F.collect_list(run).cast(runs.split("runs ")[1]).alias("runs"))  # of one segment
        judged = judged.unionByName(back)
    own = segments.where("bytes IS NULL").select("gram", "name", "id", "dig", "lo")
    hits = own.join(judged, ["gram", "name"]).select("id", "dig", "lo", F.explode("runs").alias("r"))
    hit = F.col("r.v") < F.col("id") if unit.smaller else F.col("r.v") > 1
    spans = hits.where(hit).select("id", "dig", F.struct((F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b") + unit.window - 1).alias("b")).alias("s"))
    removed = spans.groupBy("id", "dig").agg(F.collect_set("s").alias("ranges"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(batch.schema.get_field_index("ranges")).to_pylist()
            for a, b, data, offsets in unpacked(batch):
                _, first, start, end = unit.symbols(data, offsets)
                out = []
                for i in range(b - a):
                    steps = np.zeros(int(first[i + 1] - first[i]) + 1, np.int64)
                    for r in ranges[a + i]:
                        steps[r["a"]] += 1
                        steps[r["b"]] -= 1
                    gone = np.cumsum(steps)[:-1] > 0
                    part = slice(first[i], first[i + 1])
                    sha = unit.summary(data[offsets[i] : offsets[i + 1]], start[part] - offsets[i], end[part] - offsets[i], ~gone)[1]
                    out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0, sha))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array([o[j] for o in out], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.string())))], ["id", "dig", "removed", "spans", "kept"])

    touched = held.select("id", "dig", "size", "z").join(removed, ["id", "dig"]).mapInArrow(drop, "id long, dig long, removed long, spans long, kept string").dropDuplicates(["id", "dig"])
    base = table.where("gram IS NULL").select("id", "dig", "no_id", "n", "sha")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return base.join(touched, ["id", "dig"], "left").select(
        F.when(~F.col("no_id"), F.col("id")).alias("id"), "n", zero("removed").alias("removed"), zero("spans").alias("spans"), F.coalesce("kept", "sha").alias("sha")
    )


def _segments(gram, name, owners, lo, told, n) -> pa.RecordBatch:
    names = ["gram", "name", "id", "dig", "lo", "at", "low", "high", "m", "windows", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = [pa.array(gram, pa.int64()), pa.array(name, pa.int64())]
    columns += [*owners, pa.array(lo.astype(np.int32))] if told is None else [pa.nulls(n, k) for k in kinds[2:5]]
    columns += [pa.nulls(n, k) for k in kinds[5:]] if told is None else [pa.array([t[j] for t in told], k) for j, k in enumerate(kinds[5:])]
    return pa.RecordBatch.from_arrays(columns, names)


def _told(seen: dict) -> Iterator[pa.RecordBatch]:
    keys, rows = list(seen), list(seen.values())
    for a in range(0, len(keys), 5000):
        part = keys[a : a + 5000]
        yield _segments([k[0] for k in part], [k[1] for k in part], None, None, rows[a : a + 5000], len(part))


def _compared(waiting: list[tuple], match: Callable, unit: Unit) -> Iterator[pa.RecordBatch]:
    """Joins what several tasks told of the same segment, and gives the runs of equal values over its windows."""
    merged: dict[tuple[int, int], list] = {}
    for gram, name, at, low, high, m, windows, body in waiting:
        known = merged.get((gram, name))
        if known is None:
            merged[gram, name] = [gram, at, low, high, m, windows, body]
        else:
            known[2], known[3], known[4] = min(known[2], low), max(known[3], high), known[4] + m
    values = match(list(merged.values()))
    out = []
    for v in values:
        cut = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        ends = np.r_[cut[1:], len(v)]
        out.append([{"a": int(a), "b": int(b), "v": int(v[a])} for a, b in zip(cut, ends, strict=True)])
    keys = list(merged)
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("v", pa.int64())]))
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, kind)], ["gram", "name", "runs"])


def _single(bodies: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """Of anchors with very many different segments: their windows (gram, name, o, one, two), named by 128 bits, and each
    different window once as a body of its own, so that equal ones are summed before they meet in a task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                data = np.frombuffer(cols["bytes"][i].as_py(), np.uint8)
                h, _, start, end = unit.symbols(data, np.array([0, len(data)]))
                one, two = grams(h, unit.window), grams(mix(h ^ _SALT), unit.window)
                n, raw = len(one), data.tobytes()
                same = lambda c, n=n, i=i: pa.array(np.full(n, cols[c][i].as_py()))
                held = pa.array([raw[a:b] for a, b in zip(start[:n].tolist(), end[unit.window - 1 :].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([same("gram"), same("name"), pa.array(np.arange(n, dtype=np.int32)), _longs(one), _longs(two), same("low"), same("high"), same("m"), held], ["gram", "name", "o", "one", "two", "low", "high", "m", "bytes"])

    each = bodies.mapInArrow(windows, "gram long, name long, o int, one long, two long, low long, high long, m long, bytes binary")
    each = stage(each, "repeats-windows")
    # min() of the bytes, which are the same, as first() would be
    summed = each.groupBy("one", "two").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("m").alias("m"), F.min("bytes").alias("bytes"))
    alone = summed.select(F.col("one").alias("gram"), F.col("two").alias("name"), F.lit(0).alias("at"), "low", "high", "m", F.lit(1).alias("windows"), "bytes")
    return each.select("gram", "name", "o", "one", "two").distinct(), alone
