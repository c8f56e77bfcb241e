"""Semantic layer: nearest known attacks by cosine.

Vectors travel as blocks, one row with ids and a matrix each, and every query
block meets every corpus block in a task that multiplies the two and keeps the
best of each query.  The side named by ``few`` is counted; while it is one block
it is broadcast, beyond that both sides are dealt out by block number.  Nothing
of either side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.operators.pattern import with_layer
from guardspark.schemas import SEVERITY_VERDICT, finding, no_findings

#: Numbers in a block: 16 MB of floats, 32 MB of doubles.
BLOCK = 4_000_000
#: Blocks of the smaller side that are dealt out under one number: the other
#: side is sent once for each number, so fewer numbers move less.
GROUP = 4
#: Queries that are multiplied at once.
STEP = 256
# The categories that findings may carry.
CATEGORIES = ("T-PI-D", "T-PI-I", "T-JB", "T-EXT", "T-EXF", "T-TOOL", "T-AGT", "T-ENC", "T-DOS", "T-OUT", "T-MEM", "T-CASC", "T-NG")


def _finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def sound(vector: Column, width: int) -> Column:
    """Whether a vector has so many numbers, all of them finite; false for null."""
    return F.coalesce((F.size(vector) == width) & _finite(vector), F.lit(False))


def corpus_width(corpus: DataFrame) -> int | None:
    """The width of a corpus's vectors.  None if it can't be searched: it has
    none, they differ in width, or some number is missing or not finite."""
    v = F.col("embedding")
    n, least, most, good = corpus.where(v.isNotNull()).agg(F.count(F.lit(1)), F.min(F.size(v)), F.max(F.size(v)), F.count_if(_finite(v))).first()
    return most if n and least == most and good == n and most else None


def _numbers(df: DataFrame) -> type:
    """The vectors' own type of numbers, in which blocks travel."""
    return np.float32 if df.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def _blocks(df: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``part``, ``ids``, ``width`` and ``data``: blocks of the rows that have
    a vector, numbered round and round from 0 to ``parts`` - 1."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    id_type, numbers = to_arrow_type(kind), _numbers(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> pa.RecordBatch:
            data = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([pa.array([at % parts], pa.int32()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(id_type)), pa.array([data.shape[1]], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["part", "ids", "width", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(numbers)
            rows.append(flat.reshape(b.num_rows, -1))
            ids.append(b.column(0))
            size += len(flat)
            if size >= BLOCK:
                yield flush()
                at, ids, rows, size = at + 1, [], [], 0
        if ids:
            yield flush()

    return df.where(F.col("embedding").isNotNull()).select(id_col, "embedding").mapInArrow(run, f"part int, ids array<{kind.simpleString()}>, width int, data binary")


def _scorer(id_col: str, types: tuple[type, type], threshold: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q, c = (np.frombuffer(b.column(x)[r].as_buffer(), t).astype(np.float64).reshape(len(b.column(y)[r].values), -1) for x, y, t in zip(("q_data", "data"), ("q_ids", "ids"), types, strict=True))
                index = b.column("ids")[r].values
                order = index.fill_null(-1).to_numpy()
                for i in range(0, len(q), STEP):
                    at, which, sims = [], [], []
                    for j, row in enumerate(q[i : i + STEP] @ c.T):
                        near = np.flatnonzero(row >= threshold)
                        near = near[np.lexsort((-order[near], -row[near]))][:k]
                        at += [i + j] * len(near)
                        which += near.tolist()
                        sims += row[near].tolist()
                    yield pa.RecordBatch.from_arrays([b.column("q_ids")[r].values.take(pa.array(at, pa.int64())), index.take(pa.array(which, pa.int64())).cast(pa.int64()), pa.array(sims, pa.float64())], names=[id_col, "index", "similarity"])

    return run


def top_matches(queries: DataFrame, corpus: DataFrame, id_col: str, threshold: float, k: int = 3, few: str = "corpus") -> DataFrame:
    """``id_col``, ``rank``, ``index`` and ``similarity`` of at most ``k``
    corpus vectors with a similarity from ``threshold`` on; ties go to the
    larger index, null indices stay.  ``few`` names the smaller side, "corpus"
    or "queries".  Rows without a vector, of another width than the corpus's
    widest, or with a number that is missing or not finite match nothing;
    queries with one id share their matches."""
    types = _numbers(queries), _numbers(corpus)
    small = corpus if few == "corpus" else queries
    width = corpus.agg(F.max(F.size("embedding"))).first()[0] or 1
    queries, corpus = (df.where(sound(F.col("embedding"), width)) for df in (queries, corpus))
    n = (corpus if few == "corpus" else queries).agg(F.count("embedding")).first()[0]
    wide, blocks = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * width // BLOCK)
    # As many numbers as keep all tasks busy, but none with more than ``GROUP`` blocks.
    parts = max(1, min(blocks, max(wide, -(-blocks // GROUP))))
    q, c = (_blocks(df, i, parts) for df, i in ((queries, id_col), (corpus.select(F.col("index").cast("long").alias("index"), "embedding"), "index")))
    q = q.select("part", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    if parts == 1:  # at most one block of the small side for each of its partitions, ``BLOCK`` numbers in all
        q, c = (q, F.broadcast(c)) if few == "corpus" else (F.broadcast(q), c)
        pairs = q.join(c, "part")
    else:
        # The small side's blocks are dealt by number, in as many copies as there are salts; the other side goes to every number.
        # More copies than the other side has blocks would be of no use.
        other = (queries if few == "corpus" else corpus).agg(F.count("embedding")).first()[0]
        salts = F.lit(max(1, min(wide // parts, -(-other * width // BLOCK))))
        everywhere = lambda d: d.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "salt": F.pmod(F.xxhash64("part", "data" if "data" in d.columns else "q_data"), salts).cast("int")})
        copied = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        q, c = (everywhere(q), copied(c)) if few == "corpus" else (copied(q), everywhere(c))
        pairs = q.join(c, ["part", "salt"])
    kind = queries.schema[id_col].dataType
    found = pairs.select("q_ids", "q_data", "ids", "data").mapInArrow(_scorer(id_col, types, threshold, k), f"{id_col} {kind.simpleString()}, index long, similarity double")
    best = Window.partitionBy(id_col).orderBy(F.desc("similarity"), F.desc("index"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(id_col, "rank", "index", "similarity")


def max_similarity(queries: DataFrame, corpus: DataFrame, id_col: str, few: str = "corpus") -> DataFrame:
    return top_matches(queries, corpus, id_col, -2.0, 1, few).select(id_col, F.col("similarity").alias("max_similarity"))


def similarity_verdict(s: Column, cfg: EngineConfig) -> Column:
    return F.when(s >= cfg.similarity_threshold, "block").when(s >= cfg.similarity_floor, "escalate").otherwise("allow")


def category_distribution(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def failed(rule_id: str, said: str, advice: str) -> Column:
    """The layer's struct where it could not do its work: it blocks."""
    f = finding("semantic", rule_id, "T-NG", "high", "block", 1.0, said, None, advice)
    return F.struct(F.lit("block").alias("verdict"), F.array(f).alias("findings"))


def embedding_failed(said: str = "no embedding") -> Column:
    return failed("SEM-EMB-001", f"Embedding computation failed: {said}", "Check the embedder and its model")


def corpus_failed(said: str = "the corpus has no vectors, or some that are broken") -> Column:
    """For a search that can't be made: nothing could be found by it."""
    return failed("SEM-CORP-001", f"Corpus search failed: {said}", "Check the corpus table and the embedder's width")


def closed_errors(embedding: Column, width: int | None) -> Column:
    """What a text's vector makes of the layer before any search; null if it
    can be searched for."""
    empty = F.when(F.lit(width is None), corpus_failed())
    misfit = F.when(F.size(embedding) != F.lit(width), corpus_failed("the vector has another width than the corpus"))
    return F.when(embedding.isNull(), embedding_failed()).when(~F.coalesce(_finite(embedding), F.lit(False)), embedding_failed("a number is missing or not finite")).otherwise(F.coalesce(empty, misfit))


def not_started() -> Column:
    """For a run that wants the layer and was given no corpus."""
    return failed("SEM-INIT-001", "Semantic layer did not start: no corpus", "Give the run a corpus")


def row_key(*columns: str) -> Column:
    """128 bits of what the search and the judge see of a row: rows that share
    an id, or have none, keep their own findings."""
    return F.concat_ws("-", F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit("second"), *columns)))


def semantic(df: DataFrame, corpus: DataFrame, cfg: EngineConfig, id_col: str = "request_id", few: str = "corpus", index=None) -> DataFrame:
    """From ``embedding`` to ``semantic``: verdict and findings by rank.  Rows
    that a layer before has blocked are not searched.  ``index``, a
    ``VectorIndex`` of the corpus, is searched instead of the whole corpus."""
    df = df if "_row" in df.columns else df.withColumn("_row", row_key(id_col, "embedding"))
    open_ = df.where(F.col("run_semantic")) if "run_semantic" in df.columns else df
    open_ = open_.select("_row", "embedding").dropDuplicates(["_row"])
    from_ = min(cfg.similarity_threshold, cfg.similarity_floor)
    found = index.search(open_, "_row", from_, cfg.top_k) if index is not None else top_matches(open_, corpus, "_row", from_, cfg.top_k, few)
    info = corpus.select(F.col("index").cast("long").alias("index"), "text", F.coalesce("category", F.lit("unknown")).alias("category"), "severity", "source").dropDuplicates(["index"])
    found = found.join(info, "index", "left")
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("T-PI-D")
    severity = F.when(F.col("severity").isin(*SEVERITY_VERDICT), F.col("severity")).otherwise("medium")
    said = F.concat(F.format_string("Close to a known attack, cosine %.2f: ", F.col("similarity")), F.substring(F.coalesce("text", F.lit("")), 1, 80))
    made = finding("semantic", F.format_string("SEM-%03d", F.col("rank")), category, severity, similarity_verdict(F.col("similarity"), cfg), F.col("similarity"), said, F.concat(F.lit("category="), F.coalesce("category", F.lit("?")), F.lit(" source="), F.coalesce("source", F.lit("?"))), F.concat(F.lit("Have the request read with "), category, F.lit(" in mind")))
    lists = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", made.alias("f")))), lambda x: x["f"]).alias("_sem"))
    df = df.join(lists, "_row", "left").withColumn("_sem", F.coalesce("_sem", no_findings()))
    return with_layer(df, "semantic", "_sem").drop("_sem", "_row")
