"""Statistics of windows before each label: channels x sub-windows x six statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import channels
from tidemark.operators.timeseries import EPS, KEYS, quoted

#: Which part of a channel's time span, and how much of it in percent.
SUB_WINDOWS = [("first", 100), ("first", 10), ("first", 25), ("first", 50), ("last", 10), ("last", 25), ("last", 50)]
#: Labels, each counted once for a channel, of which the statistics are held before they are given out; a stay with more of them is looked at in parts.
TOLD = 20_000
STATISTICS = ["min", "max", "mean", "std", "skew", "len"]


def ordinals(series: DataFrame, values: Mapping[str, Mapping[str, float]] = channels.ORDINALS) -> DataFrame:
    """Categorical text to numbers; other text only if it is a number. Columns without values are cast."""

    def number(c: str) -> Column:
        table = F.create_map(*(F.lit(x) for k, v in values[c].items() for x in (k, float(v))))
        return F.coalesce(F.try_element_at(table, quoted(c).cast("string")), quoted(c).try_cast("double"))

    return series.select(*(number(c).alias(c) if c in values else quoted(c) for c in series.columns))


def sub_window(lo: Column, hi: Column, part: str, percent: int) -> tuple[Column, Column]:
    """The first or last percent of the span from lo to hi."""
    share = (hi - lo) * (percent / 100)
    return (lo, lo + share) if part == "first" else (hi - share, hi)


def statistics(rows: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """A8 as an aggregate over groups of rows."""
    c = F.col(value)
    varied = (F.count(c) > 1) & (F.min(c) != F.max(c))
    return rows.groupBy(*by).agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
        F.when(varied, F.skewness(c)).alias("skew"), F.nullif(F.count(c), F.lit(0)).cast("double").alias("len"),
    )


def extremes(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Minima of 1, 2, 4 ... values from each place on, so that any range of up to most values is covered by two of them."""
    out = [v]
    while 2 << (len(out) - 1) <= most:
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def least(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of the values from a to b (exclusive, above a)."""
    level = np.frexp(b - a)[1] - 1
    out = np.empty(len(a))
    for i, t in enumerate(tables):
        at = np.flatnonzero(level == i)
        out[at] = np.minimum(t[a[at]], t[b[at] - (1 << i)])
    return out


def searched(h: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, right: bool = False) -> np.ndarray:
    """The place of each x among the sorted values of h from its a to its b (exclusive), before or after equal ones."""
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        middle = (a + b) >> 1
        value = h[np.minimum(middle, len(h) - 1)]
        on = (a < b) & ((value <= x) if right else (value < x))
        a, b = np.where(on, middle + 1, a), np.where(on | (a >= b), b, middle)
    return a


def running(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of what precedes each place within its group; a group has a place more than values. Groups of like size are summed side by side."""
    size = np.diff(ends)
    out, kind = np.zeros(len(x) + len(size)), np.frexp(size)[1]
    for k in np.unique(kind[size > 0]):
        own = np.flatnonzero((kind == k) & (size > 0))
        inside = np.arange(size[own].max())[None, :] < size[own][:, None]
        place = (ends[own][:, None] + np.arange(inside.shape[1]))[inside]
        held = np.zeros(inside.shape)
        held[inside] = x[place]
        out[place + np.repeat(own, size[own]) + 1] = np.cumsum(held, 1)[inside]
    return out


def looked_up(h: np.ndarray, v: np.ndarray, ends: np.ndarray, ts: np.ndarray, group: np.ndarray, windows: Sequence[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of values v at hours h, sorted within the groups that ends tell apart: the labels ts of groups that have any before them, and their statistics, labels x windows x six.

    A window is a range of places, found by binary search; sums are differences of running sums of the centred values.
    """
    start = ends[:-1][group]
    before = np.where(np.isnan(ts), start, searched(h, ts + EPS, start, ends[1:][group]))
    some = np.flatnonzero(before > start)
    group, start, before = group[some], start[some], before[some]
    if not len(some):
        return some, np.empty((0, len(STATISTICS)))
    lo, hi = h[start], h[before - 1]
    edges = []
    for part, percent in windows:
        share = (hi - lo) * (percent / 100)
        edges.append((start, searched(h, lo + share + EPS, start, before)) if part == "first" else (searched(h, hi - share - EPS, start, before, True), before))
    first, end = (np.stack([e[i] for e in edges], 1).ravel() for i in (0, 1))
    group = np.repeat(group, len(windows))
    size = np.diff(ends)
    full = np.flatnonzero(size)
    centre, widest = np.zeros(len(size)), np.zeros(len(size))
    centre[full] = np.add.reduceat(v, ends[full]) / size[full]
    off = v - np.repeat(centre, size)
    widest[full] = np.maximum.reduceat(np.square(off), ends[full])
    centre, widest = centre[group], widest[group]
    n = (end - first).astype(float)
    m1, m2, m3 = ((x[end + group] - x[first + group]) / n for x in (running(off**p, ends) for p in (1, 2, 3)))
    most = int(n.max())
    low, high = least(extremes(v, most), first, end), -least(extremes(-v, most), first, end)
    constant = low == high
    second, third = np.maximum(m2 - m1 * m1, 0.0), m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    # Differences of running sums lose digits where a window is narrow; there, and in short ones, values are summed anew.
    anew = np.flatnonzero(~constant & ((n <= 8) | (second < 1e-4 * widest)))
    if len(anew):
        size = (end - first)[anew]
        starts = np.cumsum(size) - size
        some_v = v[np.repeat(first[anew] - starts, size) + np.arange(size.sum())]
        mean = np.add.reduceat(some_v, starts) / size
        off = some_v - np.repeat(mean, size)
        m1[anew], second[anew], third[anew] = mean - centre[anew], np.add.reduceat(off * off, starts) / size, np.add.reduceat(off**3, starts) / size
    spread = np.where(constant, 0.0, np.sqrt(second))
    with np.errstate(divide="ignore", invalid="ignore"):
        skew = np.where(constant, np.nan, third / spread**3)
    return some, np.stack([low, high, np.where(constant, low, centre + m1), spread, skew, n], 1)


def _asked(series: DataFrame, labels: DataFrame, values: Sequence[str], by: Sequence[str], time: str, t: str, how: str) -> DataFrame:
    """(by, _t, _h, _v0, _v1 ...): a row a stay, with its labels' times and its own rows in order.

    Labels are many more than the planner takes them for, so neither side may be broadcast by its estimate.
    """
    row = F.struct(F.col(time).cast("double").alias("h"), *(quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(values)))
    seen = series.where(F.col(time).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    seen = seen.select(*by, F.col("_r.h").alias("_h"), *(F.col(f"_r.v{i}").alias(f"_v{i}") for i in range(len(values))))
    asked = labels.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct(F.col(t).alias("t")))).alias("_t"))
    return asked.select(*by, F.col("_t.t").alias("_t")).hint("merge").join(seen, list(by), how)


def _pieces(batch: pa.RecordBatch, channels_: int, windows: Sequence[tuple[str, int]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch of stays by some TOLD labels times channels: the times of all labels, and of a piece the labels (their row and number), and the statistics with their place in labels x channels."""
    cut = lambda c: (x := batch.column(batch.schema.get_field_index(c)), x.offsets.to_numpy() - x.offsets[0].as_py())
    (times, t_ends), (hours, h_ends) = cut("_t"), cut("_h")
    times, hours = times.flatten(), hours.flatten().to_numpy(zero_copy_only=False)
    plain = times.cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = [batch.column(batch.schema.get_field_index(f"_v{c}")).flatten() for c in range(channels_)]
    known = [x.is_valid().to_numpy(zero_copy_only=False) for x in values]
    values = [x.to_numpy(zero_copy_only=False) for x in values]
    step = max(1, TOLD // channels_)
    i, at = 0, 0  # the next label is number `at` of all, in row i
    while at < len(plain):
        upto = min(at + step, len(plain))
        j = int(np.searchsorted(t_ends, at, "right")) - 1
        i = int(np.searchsorted(t_ends, upto, "left"))  # rows j to i (exclusive) have the labels
        rows = slice(h_ends[j], h_ends[i])
        row = np.repeat(np.arange(i - j), np.diff(h_ends[j : i + 1]))
        held = [known[c][rows] for c in range(channels_)]
        group = np.concatenate([row[k] + c * (i - j) for c, k in enumerate(held)])
        h, v = (np.concatenate([x[rows][k] for x, k in zip(of, held, strict=True)]) for of in ([hours] * channels_, values))
        ends = np.r_[0, np.cumsum(np.bincount(group, minlength=channels_ * (i - j)))]
        own = np.searchsorted(t_ends, np.arange(at, upto), "right") - 1 - j
        asked = np.concatenate([own + c * (i - j) for c in range(channels_)])
        some, told = looked_up(h, v, ends, np.tile(plain[at:upto], channels_), asked, windows)
        yield times, own + j, np.arange(at, upto), some, told
        at = upto


def _kinds(frame: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)


def windowed(series: DataFrame, labels: DataFrame, values: Sequence[str], by: Sequence[str] = KEYS, windows: Sequence[tuple[str, int]] = SUB_WINDOWS, time: str = "hours", t: str = "t") -> DataFrame:
    """(by, t, channel, stats), stats an array of a struct for each sub-window of what precedes the label.

    A stay's rows are sorted arrays into which all its labels look by binary search, those of many stays side by side:
    the work grows with the labels, not with labels times events. What meets in a task's memory is bounded by one stay, and results by TOLD labels beside it. A label
    without known values before it has no row for that channel; skew is null for constants and single values.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times, row, which, some, told in _pieces(batch, len(values), windows):
                if len(some):
                    columns = [pa.array(told[:, j], mask=np.isnan(told[:, j]) if n == "skew" else None) for j, n in enumerate(STATISTICS)]
                    stats = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(windows), pa.int32()), pa.StructArray.from_arrays(columns, STATISTICS))
                    label, channel = some % len(row), pa.array(values).take(pa.array(some // len(row)))
                    keys = [batch.column(j).take(pa.array(row[label])) for j in range(len(by))]
                    yield pa.RecordBatch.from_arrays([*keys, times.take(pa.array(which[label])), channel, stats], [*by, t, "channel", "stats"])

    rows = _asked(series, labels, values, by, time, t, "inner")
    stat = ", ".join(f"`{n}`: double" for n in STATISTICS)
    return rows.mapInArrow(look, f"{_kinds(rows, by)}, `{t}` {labels.schema[t].dataType.simpleString()}, channel string, stats array<struct<{stat}>>")


def engineered(series: DataFrame, labels: DataFrame, values: Sequence[str] = tuple(channels.CHANNELS), by: Sequence[str] = KEYS, windows: Sequence[tuple[str, int]] = SUB_WINDOWS, time: str = "hours", t: str = "t") -> DataFrame:
    """(by, t, x) with x the statistics as floats, by channel, then sub-window, then statistic (714 by default). A label's vector is made where its stay is, and not shuffled."""
    width = len(windows) * len(STATISTICS)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times, row, which, some, told in _pieces(batch, len(values), windows):
                x = np.full((len(row), len(values), width), np.nan, np.float32)
                missing = np.ones(x.shape, bool)
                label, channel = some % len(row), some // len(row)
                x[label, channel] = told.reshape(-1, width)
                gone = np.zeros(told.shape, bool)
                gone[:, STATISTICS.index("skew")] = np.isnan(told[:, STATISTICS.index("skew")])
                missing[label, channel] = gone.reshape(-1, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * (len(values) * width), pa.int32()), pa.array(x.ravel(), mask=missing.ravel()))
                keys = [batch.column(j).take(pa.array(row)) for j in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, times.take(pa.array(which)), lists], [*by, t, "x"])

    rows = _asked(series, labels, values, by, time, t, "left")
    return rows.mapInArrow(look, f"{_kinds(rows, by)}, `{t}` {labels.schema[t].dataType.simpleString()}, x array<float>")


def feature_names(values: Sequence[str] = tuple(channels.CHANNELS), windows: Sequence[tuple[str, int]] = SUB_WINDOWS) -> list[str]:
    return [f"{c}|{part} {percent}|{s}" for c in values for part, percent in windows for s in STATISTICS]


def flat(frame: DataFrame, names: Sequence[str], by: Sequence[str] = KEYS, t: str = "t") -> DataFrame:
    """A column for each feature."""
    return frame.select(*by, t, *(F.col("x")[i].alias(n) for i, n in enumerate(names)))


def series_window(series: DataFrame, part: str, percent: int, by: Sequence[str] = KEYS, time: str = "hours") -> DataFrame:
    """The first or last percent of each stay's rows by time span."""
    span = series.groupBy(*by).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    a, b = sub_window(F.col("_lo"), F.col("_hi"), part, percent)
    return series.join(span, list(by)).where((F.col(time) < b + EPS) & (F.col(time) > a - EPS)).drop("_lo", "_hi")
