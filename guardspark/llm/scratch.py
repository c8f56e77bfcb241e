"""Intermediate tables in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests, a laptop) a temporary one is made.  Intermediates are written with
Spark's Parquet writer and read back, so that lineage ends there and a lost
executor never loses them.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="guardspark-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


class Scratch:
    """Writes intermediates and removes those no longer needed.  What is left
    when the driver ends goes then: results may be read until there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def table(self, df: DataFrame, name: str, arrow_rows: int | None = None, **options: str) -> DataFrame:
        """Write ``df`` and return the table read back, with ``path`` on it.
        ``arrow_rows``: rows that tasks hand to Python at once, where rows are
        long; the session's own number holds again afterwards."""
        self._n += 1
        path = f"{self.root}/{self._n:02d}-{name}"
        own = self.spark.conf.get(ARROW_ROWS)
        try:
            if arrow_rows:
                self.spark.conf.set(ARROW_ROWS, arrow_rows)
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(ARROW_ROWS, own)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that later steps do not read."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that this session gives to a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function for ``mapInArrow`` whose task hands freed memory back to the
    machine when it ends: its worker lives on through later stages."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return out


def lean_group(run):
    """The same for a function of ``applyInArrow``."""

    def out(table):
        try:
            return run(table)
        finally:
            _give_back()

    return out


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
