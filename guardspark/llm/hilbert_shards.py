"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, their cell gets its index on a
Hilbert curve, rows are sorted by that index and cut into runs of equal count.
Neighbours on the curve are neighbours in every dimension, so a reader's
predicate on any of them touches few shards.

``write_shards`` writes whole rows in that order, a folder for each shard, and
the ranges of their columns beside them; ``read_between`` reads the shards whose
range meets a predicate.

Only ids, sizes, checksums and curve indexes are sorted, never texts.  The
global rank is each range partition's offset plus the place in it; the offsets
are one row per partition.

Defined results: nulls take cell 0 of a dimension; equal cells are ordered by
checksum, size and id, so equal texts that share their other metadata stand
together; repeated rows each take a slot; an empty table gives no rows.
Written rows that share an id, or have none, go to the least of its slots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.llm.scratch import free, Scratch, shuffle_width

#: Bits for each dimension.
BITS = 8


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``axes`` (n rows, d columns of values
    below 2 ** bits): binary axes to their transposed index, bit plane by bit
    plane, then interleaved."""
    x = axes.astype(np.int64).T.copy()
    d = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(d):
            set_ = (x[i] & plane) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        plane >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where((x[d - 1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def category_cell(c: Column, bits: int = BITS) -> Column:
    """A cell for a name: its hash, so that equal names share one."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits))).cast("long")


def size_cell(c: Column, bits: int = BITS) -> Column:
    """A cell for a size: eight steps for each doubling."""
    return F.least(F.lit((1 << bits) - 1), F.floor(8 * F.log2(F.coalesce(c, F.lit(0)).cast("double") + 1))).cast("long")


def range_cell(c: Column, low: float, high: float, bits: int = BITS) -> Column:
    """A cell for a value between two bounds."""
    top = (1 << bits) - 1
    scaled = (c.cast("double") - low) / max(high - low, 1) * top
    return F.coalesce(F.least(F.lit(top), F.greatest(F.lit(0), F.floor(scaled))), F.lit(0)).cast("long")


def hilbert_shards(df: DataFrame, cells: list[Column], ties: list[str], shards: int = 40, bits: int = BITS) -> DataFrame:
    """Add ``hilbert``, ``shard`` and ``slot``, which replace columns of these
    names; all others stay, whatever they are called.  Shards' counts differ by
    one at most.  ``df`` must be narrow: all its columns are sorted.  Null cells
    and ties come first; rows that are equal in all of them follow each other
    in any order; an empty table gives no rows."""
    curve = F.pandas_udf(lambda *a: pd.Series(hilbert_index(np.column_stack(a), bits)), "long")
    spark = df.sparkSession
    indexed = df.withColumn("hilbert", curve(*cells))
    keys = ["hilbert", *ties]
    at, part, row, n, before, whole, rank = own = [free(indexed, f"_{x}") for x in ("at", "part", "row", "n", "before", "all", "rank")]
    ordered = indexed.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    ordered = Scratch(spark).table(ordered.withColumn(at, F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumns({part: F.shiftright(at, 33), row: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    parts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    sooner = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(part, F.coalesce(F.sum(n).over(sooner), F.lit(0)).alias(before), F.sum(n).over(Window.partitionBy()).alias(whole))
    # One row per range partition: their number is the session's, not the data's.
    ranked = ordered.join(F.broadcast(parts), part).withColumn(rank, F.col(before) + F.col(row))
    # The first ``wide`` shards hold one row more than the others' ``each``.
    wide, each = F.expr(f"`{whole}` % {shards}"), F.expr(f"`{whole}` div {shards}")
    edge = f"(`{whole}` % {shards}) * (`{whole}` div {shards} + 1)"
    shard = F.when(F.col(rank) < F.expr(edge), F.expr(f"`{rank}` div (`{whole}` div {shards} + 1)")).otherwise(wide + F.expr(f"(`{rank}` - {edge}) div greatest(`{whole}` div {shards}, 1)"))
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * each + F.least(F.col("shard"), wide)
    return ranked.withColumn("slot", (F.col(rank) - start).cast("long")).drop(*own)


def write_shards(df: DataFrame, placed: DataFrame, path: str, by: list[str], id_col: str = "doc_id") -> DataFrame:
    """Write ``df`` in the order that ``placed`` (``id_col``, ``shard``,
    ``slot``) gives, under ``path``/rows, and return each shard's row number
    and least and greatest ``by``, which ``path``/ranges holds.  A shard spans
    many tasks and files, each a run of slots."""
    spark = df.sparkSession
    at = placed.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct("shard", "slot")).alias("_to")).hint("merge")
    rows = df.join(at, F.col(id_col).eqNullSafe(F.col("_id"))).select(*df.columns, F.col("_to.shard").alias("_shard"), F.col("_to.slot").alias("_slot"))
    rows = rows.repartitionByRange(shuffle_width(spark), "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot")
    rows.write.partitionBy("_shard").parquet(f"{path}/rows")
    ends = [f(F.col(c)).alias(f"{name}_{c}") for c in by for name, f in (("least", F.min), ("greatest", F.max))]
    written = spark.read.schema(df.withColumn("_shard", F.lit(0)).schema).parquet(f"{path}/rows")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in by]
    written.groupBy("_shard").agg(F.count(F.lit(1)).alias("rows"), *ends, *nulls).coalesce(1).write.parquet(f"{path}/ranges")
    return spark.read.parquet(f"{path}/ranges")


def read_between(spark, path: str, column: str, low, high) -> DataFrame:
    """Written rows whose ``column`` lies between two values; other shards'
    files are not opened.  The ranges have one row per shard."""
    ranges = spark.read.parquet(f"{path}/ranges")
    meet = ranges.where((F.col(f"least_{column}") <= F.lit(high)) & (F.col(f"greatest_{column}") >= F.lit(low))).select("_shard")
    wanted = [r[0] for r in meet.collect()]
    return spark.read.parquet(f"{path}/rows").where(F.col("_shard").isin(wanted) & F.col(column).between(low, high)).drop("_shard")


def op4_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), category_cell(F.col("lang")).alias("_lang"), category_cell(F.col("source")).alias("_source"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cells = [F.col("_lang"), F.col("_source"), size_cell(F.col("size")), range_cell(F.col("doc_id"), low or 0, high or 0)]
    out = hilbert_shards(narrow, cells, ["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
