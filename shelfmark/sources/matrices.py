"""Matrices in .npy files as rows: a data source that reads headers where the scan is planned, and ranges of rows in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

FIELDS = StructType([StructField("file", StringType()), StructField("row", LongType()), StructField("embedding", ArrayType(FloatType()))])
COLUMNS = tuple(FIELDS.fieldNames())
#: rows of a batch
BATCH = 4096


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Rows [start, stop) of a matrix that begins at a byte of a file."""

    file: str
    at: int
    shape: tuple[int, int]
    kind: str
    by_column: bool
    start: int
    stop: int


def header(f) -> tuple[tuple[int, int], bool, np.dtype]:
    """(rows and columns, whether columns are contiguous, type) of an open file, which is left where the numbers begin."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(f)
    if len(shape) not in (1, 2) or kind.hasobject:
        raise ValueError(f"not a matrix of numbers: {shape} {kind}")
    return (shape if len(shape) == 2 else (shape[0], 1)), by_column, kind


class Matrices(DataSource):
    """Options: path, a file or a folder; rows, of a range; columns, of file, row and embedding."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        names = self.options.get("columns", ",".join(COLUMNS)).split(",")
        return StructType([f for f in FIELDS if f.name in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("rows", 100_000)), schema)


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, rows: int, schema: StructType):
        self.path, self.rows, self.names = path, max(1, rows), schema.fieldNames()

    def partitions(self) -> list[Range]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [root] if info.type == pafs.FileType.File else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.path.endswith(".npy"))
        out = []
        for name in files:
            with fs.open_input_file(name) as f:
                shape, by_column, kind = header(f)
                out += [Range(name, f.tell(), shape, kind.str, by_column, at, min(at + self.rows, shape[0])) for at in range(0, shape[0], self.rows)]
        return out or [Range("", 0, (0, 1), "<f4", False, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        for at in range(partition.start, partition.stop, BATCH):
            n = min(BATCH, partition.stop - at)
            columns = {"file": lambda n=n: pa.array([partition.file] * n, pa.string()), "row": lambda at=at, n=n: pa.array(np.arange(at, at + n)), "embedding": lambda at=at, n=n: _lists(self._numbers(fs, partition, at, n))}
            yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], names=self.names)

    def _numbers(self, fs: pafs.FileSystem, own: Range, at: int, n: int) -> np.ndarray:
        kind, (rows, dim) = np.dtype(own.kind), own.shape
        with fs.open_input_file(own.file) as f:
            if not own.by_column:
                return np.frombuffer(f.read_at(n * dim * kind.itemsize, own.at + at * dim * kind.itemsize), kind).reshape(n, dim)
            return np.stack([np.frombuffer(f.read_at(n * kind.itemsize, own.at + (c * rows + at) * kind.itemsize), kind) for c in range(dim)], axis=1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).astype(np.float32).ravel()))
