"""Inverted lists over vectors that skip what cannot match, and nothing else.

Centers are fitted by spherical k-means on a bounded sample; every vector then
goes to the list of its nearest center, sorted by its angle to it, and is cut
into chunks that know the least and greatest angle and length of their vectors.
For a query at angle ``a`` to a list's center and vectors at angles from ``low``
to ``high``, the angle between them is at least the gap of ``a`` to that range,
so ``|q| |x| cos(gap)`` bounds every product.  Lists and chunks whose bound is
below the threshold are skipped; all others are multiplied out, so results
equal those of a full scan.

Only centers and the lists' four bounds, at most ``LISTS`` rows, are sent to
all tasks.  A list of any size is many chunks, and a join on its number can be
split between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from guardspark.operators.semantic import sound

#: Lists at most, vectors that centers are fitted on at most, rounds of fitting.
LISTS, SAMPLE, ROUNDS = 256, 8_192, 8
#: Numbers in a chunk (2 MB) and queries in a block.
CHUNK, STEP = 250_000, 256
#: Bounds are wider by this much than rounding can make them wrong.
SLACK = 1e-6
CHUNKS = "list int, low double, high double, least double, most double, ids array<long>, data binary"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _angles(unit: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centers.T, -1.0, 1.0))


def fit_centers(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Directions of ``lists`` clusters at most."""
    unit = _unit(sample)
    rng = np.random.default_rng(seed)
    centers = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(ROUNDS):
        own = (unit @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, unit)
        held = np.bincount(own, minlength=len(centers)) > 0
        centers = np.where(held[:, None], _unit(sums), centers)
    return centers


def greatest_product(angle, length, low, high, least, most):
    """The greatest product that vectors between these angles and lengths can
    have with a query."""
    gap = np.maximum(0.0, np.maximum(angle - high, low - angle))
    cos = np.cos(np.minimum(gap, np.pi))
    return length * np.where(cos > 0, most, least) * cos + SLACK * (1 + length * most)


def _matrix(array: pa.Array, rows: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _lister(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column(1), b.num_rows))
                angle = _angles(unit, centers)
                own = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(angle[np.arange(len(own)), own]), b.column(0), b.column(1)], names=["list", "angle", "index", "embedding"])

    return run


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one list, in order of their angles, as chunks."""
    own, angles, ids, rows, size = None, [], [], [], 0

    def flush() -> pa.RecordBatch:
        data, angle = np.concatenate(rows), np.concatenate(angles)
        length = np.linalg.norm(data, axis=1)
        columns = [pa.array([x]) for x in (angle.min(), angle.max(), length.min(), length.max())]
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *columns, pa.array([np.concatenate(ids).tolist()], pa.list_(pa.int64())), pa.array([data.astype(np.float32).tobytes()], pa.binary())], names=["list", "low", "high", "least", "most", "ids", "data"])

    for b in batches:
        if not b.num_rows:
            continue
        number, data = b.column(0).to_numpy(), _matrix(b.column(3), b.num_rows)
        step = max(1, CHUNK // data.shape[1])
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for low, high in zip(cuts, cuts[1:]):
            for at in range(low, high, step):
                end = min(high, at + step)
                if rows and (number[at] != own or size + (end - at) * data.shape[1] > CHUNK):
                    yield flush()
                    angles, ids, rows, size = [], [], [], 0
                own = int(number[at])
                angles.append(b.column(1).to_numpy()[at:end])
                ids.append(b.column(2).to_numpy()[at:end])
                rows.append(data[at:end])
                size += (end - at) * data.shape[1]
    if rows:
        yield flush()


@dataclass
class VectorIndex:
    centers: np.ndarray
    bounds: np.ndarray  # low, high, least, most of each list
    chunks: DataFrame

    def search(self, queries: DataFrame, id_col: str, threshold: float, k: int = 3) -> DataFrame:
        """``id_col``, ``rank``, ``index`` and ``similarity`` of at most ``k``
        vectors from ``threshold`` on; similarities that are equal to nine
        digits go to the larger index.  Queries without a sound vector of the
        index's width match nothing.  With a threshold below all products, each
        query's nearest list first tells how near its ``k``-th match is."""
        rows = queries.select(id_col, "embedding").where(sound(F.col("embedding"), self.centers.shape[1]))
        rows = rows.withColumn("floor", F.lit(float(threshold)))
        if threshold < 0:
            near = self._scored(rows, id_col, k, 1)
            last = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).where(F.col("n") >= k)
            rows = rows.join(last.select(id_col, "least"), id_col, "left").withColumn("floor", F.coalesce(F.col("least") - 1e-8, "floor")).drop("least")
        return self._scored(rows, id_col, k)

    def pairs_left(self, queries: DataFrame, id_col: str, threshold: float) -> int:
        """Query and vector pairs that are multiplied out, for figures."""
        rows = queries.select(id_col, "embedding").where(sound(F.col("embedding"), self.centers.shape[1])).withColumn("floor", F.lit(float(threshold)))
        left = self._met(rows, id_col, None).mapInArrow(_counter, "n long")
        return left.agg(F.sum("n")).first()[0] or 0

    def _met(self, rows: DataFrame, id_col: str, nearest: int | None) -> DataFrame:
        kind = rows.schema[id_col].dataType.simpleString()
        blocks = rows.mapInArrow(_router(self.centers, self.bounds, to_arrow_type(rows.schema[id_col].dataType), nearest), f"list int, q_ids array<{kind}>, floors array<double>, angles array<double>, q_data binary")
        return blocks.join(self.chunks, "list")

    def _scored(self, rows: DataFrame, id_col: str, k: int, nearest: int | None = None) -> DataFrame:
        kind = rows.schema[id_col].dataType
        found = self._met(rows, id_col, nearest).mapInArrow(_scorer(id_col, to_arrow_type(kind), k), f"{id_col} {kind.simpleString()}, index long, similarity double")
        best = Window.partitionBy(id_col).orderBy(F.desc(F.round("similarity", 9)), F.desc("index"))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(id_col, "rank", "index", "similarity")


def _router(centers: np.ndarray, bounds: np.ndarray, id_type: pa.DataType, nearest: int | None):
    """Queries to the lists that they cannot do without, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, floor = _matrix(b.column(1), b.num_rows), b.column(2).to_numpy()
            length = np.linalg.norm(data, axis=1)
            angle = _angles(_unit(data), centers)
            most = greatest_product(angle, length[:, None], *bounds.T)
            wanted = most >= floor[:, None]
            if nearest:
                rank = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
                wanted &= rank < nearest
            for number in np.flatnonzero(wanted.any(axis=0)):
                at = np.flatnonzero(wanted[:, number])
                for i in range(0, len(at), STEP):
                    own = at[i : i + STEP]
                    ids = b.column(0).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([ids.to_pylist()], pa.list_(id_type)), pa.array([floor[own].tolist()]), pa.array([angle[own, number].tolist()]), pa.array([data[own].tobytes()], pa.binary())], names=["list", "q_ids", "floors", "angles", "q_data"])

    return run


def _open_rows(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries of a block, and which of them this chunk could still match."""
    floors, angles = (b.column(c)[r].values.to_numpy() for c in ("floors", "angles"))
    q = np.frombuffer(b.column("q_data")[r].as_buffer(), np.float64).reshape(len(floors), -1)
    chunk = [b.column(c)[r].as_py() for c in ("low", "high", "least", "most")]
    return q, floors, np.flatnonzero(greatest_product(angles, np.linalg.norm(q, axis=1), *chunk) >= floors)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(_open_rows(b, r)[2]) * len(b.column("ids")[r].values) for r in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])


def _scorer(id_col: str, id_type: pa.DataType, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q, floors, open_ = _open_rows(b, r)
                if not len(open_):
                    continue
                index = b.column("ids")[r].values.to_numpy()
                c = np.frombuffer(b.column("data")[r].as_buffer(), np.float32).reshape(len(index), -1).astype(np.float64)
                at, which, sims = [], [], []
                for i, row in zip(open_, q[open_] @ c.T):
                    near = np.flatnonzero(row >= floors[i])
                    near = near[np.lexsort((-index[near], -np.round(row[near], 9)))][:k]
                    at += [i] * len(near)
                    which += index[near].tolist()
                    sims += row[near].tolist()
                yield pa.RecordBatch.from_arrays([b.column("q_ids")[r].values.take(pa.array(at, pa.int64())), pa.array(which, pa.int64()), pa.array(sims, pa.float64())], names=[id_col, "index", "similarity"])

    return run


def build_index(corpus: DataFrame, path: str, lists: int = LISTS) -> VectorIndex:
    """Index all sound vectors of ``corpus`` (``index``, ``embedding``) as a
    table at ``path``; all have the width of the widest one, and lengths are
    not changed.  The sample are the vectors of least hash."""
    rows = corpus.select(F.col("index").cast("long").alias("index"), F.col("embedding").cast("array<float>").alias("embedding")).where("index IS NOT NULL AND embedding IS NOT NULL")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = rows.where(sound(F.col("embedding"), width))
    sample = rows.orderBy(F.xxhash64("index"), "index").limit(SAMPLE).select("embedding").toArrow()
    centers = fit_centers(_matrix(sample.column(0).combine_chunks(), sample.num_rows), min(lists, LISTS)) if sample.num_rows else np.ones((1, width))
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.mapInArrow(_lister(centers), "list int, angle double, index long, embedding array<float>")
    chunks = listed.repartitionByRange(parts, "list", "angle", "index").sortWithinPartitions("list", "angle", "index").mapInArrow(_chunker, CHUNKS)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    number = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>")
    number.coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before."""
    centers = np.array([r.center for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()])
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    bounds = np.tile([np.pi, 0.0, 0.0, 0.0], (len(centers), 1))
    for r in chunks.groupBy("list").agg(F.min("low"), F.max("high"), F.min("least"), F.max("most")).collect():
        bounds[r[0]] = r[1:]
    return VectorIndex(centers, bounds, chunks)
