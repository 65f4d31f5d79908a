"""Regular series from a stream of events, by state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues, ExpiredTimerInfo

from tidemark.operators.timeseries import EPS, bin_id

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which state with timers needs; their checkpoint holds its changes."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: Stays are dealt into so many groups, each with one state and one timer: a call of Python is a group's, not a stay's.
BUCKETS = 1024


def packed(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_pandas()


class _Grid(StatefulProcessor):
    """Of the stays of a bucket: the open bins, the next bin to be given out, and what the channels last were."""

    CELL = ["stay", "bin", "channel", "at", "value"]

    def __init__(self, step: float, normal: Sequence[float | None]):
        self.step_ms, self.normal = step * 3.6e6, np.array([np.nan if v is None else v for v in normal], float)
        self.names = [f"v{c}" for c in range(len(self.normal))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "stays binary, cells binary")

    def closes(self, begun: np.ndarray, number: np.ndarray) -> np.ndarray:
        """When no row that is still let through can belong to the bin: its end counts to it, with the tolerance of bin_id()."""
        return begun + np.ceil(self.step_ms * (number + 1 + EPS)).astype(np.int64) + 1

    def _keep(self, stays: pd.DataFrame, cells: pd.DataFrame) -> None:
        """With one timer: for the next bin of a stay that is due, or the end of one that has none."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not len(stays):
            self.held.clear()
            return
        self.held.update((packed(stays), packed(cells)))
        begun, ends, following, last = (stays[c].to_numpy() for c in ("begun", "ends", "following", "last"))
        self.handle.registerTimer(int(np.where(following <= last, self.closes(begun, following), ends + 1).min()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = got[(got["begun"] <= got["at"]) & (got["at"] <= got["ends"])]
        if not len(got):
            return
        stays = got.drop_duplicates("stay")[["stay", "begun", "ends"]].assign(following=np.int64(0), last=np.int64(-1), **dict.fromkeys(self.names, np.nan))
        cells = got[self.CELL].iloc[:0]
        if self.held.exists():
            known, cells = map(unpacked, self.held.get())
            new = stays[~stays["stay"].isin(known["stay"])]
            stays = pd.concat([known, new]) if len(new) else known
        stays = stays.set_index("stay", drop=False)
        got = got[got["bin"].to_numpy() >= stays["following"].reindex(got["stay"]).to_numpy()]
        best = got[got["value"].notna()][self.CELL]
        cells = pd.concat([cells, best]) if len(cells) else best
        cells = cells.astype({"bin": "int64", "channel": "int64"}).sort_values(self.CELL).drop_duplicates(self.CELL[:3], keep="last")
        latest = got.groupby("stay")["bin"].max().astype("int64")
        stays["last"] = np.maximum(stays["last"].to_numpy(), latest.reindex(stays.index, fill_value=-1).to_numpy())
        self._keep(stays, cells)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        stays, cells = map(unpacked, self.held.get())
        begun, following, last = (stays[c].to_numpy() for c in ("begun", "following", "last"))
        upto = np.floor((passed - begun) / self.step_ms).astype(np.int64)  # the last bin that is closed is one of the three before
        for _ in range(3):
            upto = upto - (self.closes(begun, upto) > passed)
        upto = np.maximum(np.minimum(upto, last), following - 1)
        # Of each stay a line of what was known, and then one of each bin that is given out.
        lines = upto - following + 2
        first = np.cumsum(lines) - lines
        row = np.repeat(np.arange(len(stays)), lines)
        bins = np.arange(len(row)) - first[row] + following[row] - 1
        values = np.full((len(row), len(self.names)), np.nan)
        values[first] = stays[self.names].to_numpy()
        own = pd.Index(stays["stay"]).get_indexer(cells["stay"])
        due = cells["bin"].to_numpy() <= upto[own]
        met, of = cells[due], own[due]
        values[first[of] + met["bin"].to_numpy() - following[of] + 1, met["channel"].to_numpy()] = met["value"].to_numpy()
        at = np.where(np.isnan(values), first[row][:, None], np.arange(len(row))[:, None])
        values = np.take_along_axis(values, np.maximum.accumulate(at, axis=0), 0)
        given = np.flatnonzero(bins >= following[row])
        stays[self.names] = values[first + lines - 1]
        stays["following"] = upto + 1
        open_ = ((stays["following"] <= stays["last"]) | (stays["ends"] >= passed)).to_numpy()
        self._keep(stays[open_], cells[~due])  # a stay that ends has given out all of its bins
        if len(given):
            told = np.where(np.isnan(values[given]), self.normal, values[given])
            yield pd.DataFrame({"stay": stays["stay"].to_numpy()[row[given]], "bins": bins[given].astype(np.int32), **{n: told[:, i] for i, n in enumerate(self.names)}})

    def close(self) -> None:
        pass


def filled_grid(events: DataFrame, channels: Sequence[str], normal: Sequence[float | None], delay: str, step: float = 1.0, key: str = "ICUSTAY_ID", time: str = "CHARTTIME", begun: str = "INTIME", ends: str = "OUTTIME", name: str = "VARIABLE", value: str = "VALUE", buckets: int = BUCKETS) -> DataFrame:
    """(key, bins, a column for each channel) from a stream of (key, time, begun, ends, name, value).

    Gives what last_in_bin(), dense_grid() and imputed("previous") give for the rows of a stay: the last known value of
    each channel in each bin, bins without rows too, and values carried on from the bins before, or the normal one. A
    bin is given out once the watermark, `delay` behind the latest row of the stream, has passed its end and a row of
    the stay, in it or in a later bin, is known; rows may come in any order until then, and count by their time. Rows
    behind the watermark go, and so do those outside the stay. The state of a stay is its open bins and a value a
    channel; it ends when the watermark has passed the stay's end; those of a bucket of stays are kept and looked at together. Start the query inside keyed_state(), in append mode.
    """
    ms = lambda c: F.floor(F.unix_micros(c) / 1000)
    hours = (F.unix_micros(time) - F.unix_micros(begun)) / 3.6e9
    numbers = F.create_map(*(F.lit(x) for i, c in enumerate(channels) for x in (c, i)))
    rows = events.withWatermark(time, delay).where(F.col(name).isin(*channels)).select(
        F.col(key).cast("long").alias("stay"), F.col(time), ms(begun).alias("begun"), ms(ends).alias("ends"), ms(time).alias("at"), bin_id(hours, step).alias("bin"), F.element_at(numbers, F.col(name)).alias("channel"), F.col(value).cast("double").alias("value")
    )
    schema = "stay long, bins int, " + ", ".join(f"v{i} double" for i in range(len(channels)))
    out = rows.withColumn("bucket", F.pmod(F.hash("stay"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(_Grid(step, normal), schema, "Append", "EventTime")
    return out.select(F.col("stay").alias(key), "bins", *(F.col(f"v{i}").alias(c) for i, c in enumerate(channels)))
