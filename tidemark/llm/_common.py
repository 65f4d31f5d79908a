"""What the operators of this subpackage share: staged tables, document keys, byte tokenising in NumPy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task turns into NumPy arrays at a time; one longer document is a piece of its own.
PIECE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all run on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors reach")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many keys are sent to every task.
FEW_KEYS = 100_000


def few(keys: DataFrame, name: str, most: int = FEW_KEYS) -> DataFrame:
    """keys, staged, and sent to every task where they are at most so many: the table that they meet is not shuffled then."""
    keys = stage(keys, name)
    return F.broadcast(keys) if keys.count() <= most else keys


class Scratch:
    """Staged tables that are needed only until a result is staged itself: a folder of them, and its removal."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def stage(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dig, text): text null as empty; (id, dig) names a row, and equal rows share it. A null id is the least long here, before all others, told apart by dig."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("dig"),
        F.col(id_col).isNull().alias("no_id"),
        text.alias("text"),
    )


def given_id() -> Column:
    """The id as it came in, for the frames made from keyed()."""
    return F.when(~F.col("no_id"), F.col("id"))


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with their UTF-8 bytes: (first row, end row, bytes, offsets from 0). Nulls are empty."""
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.string()), np.int32
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the output depends on all of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word (run of bytes other than 0x20 and 0x09-0x0D) and, by row, how many words came before it.

    Words end at the end of their row. The last result has one entry more than there are rows.
    """
    word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes and length alone: the same in every row, task and run."""
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(-length, kind="stable")
    counts = np.bincount(length)
    left = len(start) - np.cumsum(counts)  # words longer than i
    rows = order
    base = np.uint64(0x100000001B3)
    sorted_start = start[order]
    acc = np.full(len(start), 0xCBF29CE484222325, np.uint64)
    longest = min(len(counts) - 1, 64)
    for i in range(longest):
        k = int(left[i])
        acc[:k] = (acc[:k] ^ data[sorted_start[:k] + i]) * base
    for r in range(int(left[longest]) if longest < len(left) else 0):  # the few words of over 64 bytes
        at = order[r]
        rest = data[start[at] + longest : end[at]].astype(np.uint64)
        acc[r] = acc[r] * base + np.add.reduce(mix(rest + np.uint64(1)) * powers(BASE, len(rest)))
    out[rows] = acc
    return mix(out ^ (length.astype(np.uint64) * np.uint64(BASE)))


#: For SQL without the function: the table of crc32's remainders, and the crc32 of a decimal id by it.
CRC_TABLE = """crc_table AS (SELECT list(x ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS x FROM (SELECT unnest(range(0, 256)) AS i)))"""
CRC_SQL = "xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split({id}::VARCHAR, '')], lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295)"
