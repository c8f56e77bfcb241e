"""Vectors kept as a NumPy file: a data source planned by ranges of rows.

The driver reads the header alone; every task opens the file itself and reads
the bytes of its own rows.  ``path`` may be anything that Arrow's file systems
open (a local path, ``s3://``, ``hdfs://``).
"""

from __future__ import annotations

import io as _io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "index long, embedding array<float>"
#: Bytes of a partition, if the option ``bytes`` names no others; rows that a
#: task hands on at once.
BYTES, ROWS = 64 << 20, 4096
#: More than any header of the format takes.
HEADER = 1 << 16


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path.removeprefix("file:")
    return system.open_input_file(at)


def header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, kind of number, and where the numbers begin."""
    with _open(path) as f:
        head = _io.BytesIO(f.read_at(min(HEADER, f.size()), 0))
        size = f.size()
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 2 or fortran or kind.kind not in "fiu":
        raise ValueError(f"{path} holds no rows of numbers: shape {shape}, {kind}")
    if size < head.tell() + shape[0] * shape[1] * kind.itemsize:
        raise ValueError(f"{path} is shorter than its header says")
    return shape, kind, head.tell()


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.shape, self.kind, self.start = header(self.path)
        self.row = self.shape[1] * self.kind.itemsize
        self.rows = max(1, int(options.get("bytes", BYTES)) // max(1, self.row))

    def partitions(self) -> list[InputPartition]:
        n = self.shape[0]
        return [_Rows(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        width = self.shape[1]
        with _open(self.path) as f:
            for i in range(partition.first, partition.last, ROWS):
                n = min(ROWS, partition.last - i)
                data = np.frombuffer(f.read_at(n * self.row, self.start + i * self.row), self.kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n, dtype=np.int64)), lists], names=["index", "embedding"])


class NpySource(DataSource):
    """``spark.read.format("npy").option("path", ...).load()``: ``index`` and
    ``embedding`` of each row; the option ``bytes`` bounds a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_npy(spark: SparkSession, path: str, partition_bytes: int = BYTES) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("bytes", partition_bytes).load()


def read_npy_corpus(spark: SparkSession, vectors: str, metadata: str, partition_bytes: int = BYTES) -> tuple[DataFrame, dict[str, int]]:
    """A corpus of vectors and a JSON list of what is known of each, in the
    vectors' order; and how many of both there are.  A vector beyond the list
    has the text '' and is ``unknown`` otherwise; what is known of no vector is
    left out."""
    found = read_npy(spark, vectors, partition_bytes)
    kinds = "text string, category string, severity string, source string"
    # One file is one JSON value: a task reads it, and numbers what it read.
    info = spark.read.schema(kinds).option("multiLine", True).json(metadata).coalesce(1).withColumn("index", F.monotonically_increasing_id())
    counts = {"vectors": header(vectors)[0][0], "metadata": info.count()}
    known = lambda c, other: F.coalesce(F.col(c), F.lit(other)).alias(c)
    corpus = found.join(info, "index", "left").select(F.col("index").cast("int").alias("index"), known("text", ""), *(known(c, "unknown") for c in ("category", "severity", "source")), "embedding")
    return corpus, counts
