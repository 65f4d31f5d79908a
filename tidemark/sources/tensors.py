"""Samples as tensors of one shape: a data source that pads ragged arrays while it writes, and reads the files back.

A file holds Arrow record batches in which each tensor column is an array of fixed-size tensors, so that training code
maps it into memory without parsing. A manifest, written last, names the files that count, their rows and the shapes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_tensors.json"
#: Numbers of one record batch of a file, so that neither side holds more than some 64 MB of a tensor column at a time.
NUMBERS = 8_000_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> dict:
    files, root = _at(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def stacked(column: pa.Array, shape: Sequence[int]) -> pa.Array:
    """A column of numbers or (nested) lists as tensors of the shape, cut or filled up with zeros at the end of each axis; null is all zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, at = len(column), [np.arange(len(column))]
    fits = np.ones(n, bool)
    for size in shape:
        if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
            raise ValueError(f"a column of {column.type} has fewer axes than the shape {tuple(shape)}")
        length = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        at = [np.repeat(a, length) for a in at] + [place]
        fits = np.repeat(fits, length) & (place < size)
        column = column.flatten()
    values = column.to_numpy(zero_copy_only=False)
    values = np.nan_to_num(values) if column.null_count else values
    out = np.zeros((n, *shape), values.dtype if values.dtype.kind in "fiu" else np.float64)
    out[tuple(a[fits] for a in at)] = values[fits]
    return pa.FixedShapeTensorArray.from_numpy_ndarray(out) if n else pa.array([], pa.fixed_shape_tensor(pa.from_numpy_dtype(out.dtype), tuple(shape)))


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, shapes: Mapping[str, Sequence[int]], schema: StructType, overwrite: bool):
        self.path, self.shapes, self.schema, self.overwrite = path, shapes, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _at(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.arrow", 0, None
        files.create_dir(root)
        most = max(1, NUMBERS // max([1, *(int(np.prod(s)) for s in self.shapes.values())]))
        sink = None
        for batch in iterator:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                columns = [stacked(part.column(i), self.shapes[c]) if c in self.shapes else part.column(i) for i, c in enumerate(part.schema.names)]
                made = pa.RecordBatch.from_arrays(columns, part.schema.names)
                if out is None:
                    sink = files.open_output_stream(f"{root}/{name}")
                    out = pa.ipc.new_file(sink, made.schema)
                out.write_batch(made)
                rows += made.num_rows
        if out is not None:
            out.close()
            sink.close()
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _at(self.path)
        files.create_dir(root)
        kept = [] if self.overwrite or files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound else _manifest(self.path)["files"]
        told = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"schema": self.schema, "shapes": self.shapes, "files": kept + told}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Files without a manifest that names them are never read; those that are known go."""
        files, root = _at(self.path)
        for m in messages:
            if m is not None and m.rows:
                files.delete_file(f"{root}/{m.file}")


@dataclass
class _File(InputPartition):
    file: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        return [_File(f["file"]) for f in _manifest(self.path)["files"]] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, root = _at(self.path)
        with files.open_input_file(f"{root}/{partition.file}") as f:
            reader = pa.ipc.open_file(f)
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i)
                yield pa.RecordBatch.from_arrays([_lists(batch.column(c)) for c in self.names], self.names)


def _lists(column: pa.Array) -> pa.Array:
    """Tensors as nested lists."""
    if not isinstance(column, pa.FixedShapeTensorArray):
        return column
    values, n = pa.array(column.to_numpy_ndarray().reshape(-1)), len(column)
    for k in range(len(column.type.shape) - 1, -1, -1):
        size, many = column.type.shape[k], n * int(np.prod(column.type.shape[:k]))
        values = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * size), values)
    return values


class TensorSource(DataSource):
    """format("tensors"): option shape.<column> is "a,b,..." for each column to be written as tensors."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(_manifest(self.options["path"])["schema"]))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        given = {k.lower().removeprefix("shape."): [int(x) for x in v.split(",")] for k, v in self.options.items() if k.lower().startswith("shape.")}
        return _Writer(self.options["path"], {c: given[c.lower()] for c in schema.names if c.lower() in given}, schema, overwrite)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)


def longest(samples: DataFrame, columns: Mapping[str, Sequence[int]]) -> dict[str, list[int]]:
    """The shapes of columns, given what comes after their first axis, if that is as long as the longest: one row is collected."""
    told = samples.agg(*(F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in columns)).first()
    return {c: [max(0, told[c]), *more] for c, more in columns.items()}


def write_tensors(samples: DataFrame, path: str, shapes: Mapping[str, Sequence[int]], mode: str = "overwrite") -> None:
    """The columns named in shapes as tensors, the others as they are; a partition is a file."""
    samples.sparkSession.dataSource.register(TensorSource)
    writer = samples.write.format("tensors").mode(mode)
    for c, shape in shapes.items():
        writer = writer.option(f"shape.{c}", ",".join(map(str, shape)))
    writer.save(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """What was written, the tensors as arrays of their full shape."""
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensors").load(path)
