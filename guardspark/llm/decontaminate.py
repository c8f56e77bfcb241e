"""Benchmark decontamination by greedy string tiling.

Documents and test items become sequences of words (lower-cased, without
punctuation at the ends).  Windows of five words are the seeds.  A bitmap of
fixed size, built from the items' seeds, lets each document task keep only the
stretches of words that may match; an exact join of the seeds then gives the
(document, item) pairs whose seeds could reach the coverage.  Those pairs are
tiled: the longest match of unmarked words is found by Karp-Rabin hashes of
one length after another, all matches of that length are marked, and so on
down to five words.  The share of the item's words in tiles decides, so a
passage put back in another order is caught as well.

An item shorter than five words is its own seed.  Defined results: null and
empty texts match nothing, items without words never do; repeated rows are
judged one by one; null ids stay null, of items too; further columns are
dropped.  Items that share an id or have none are told apart by their words:
each distinct text is matched, and gives rows of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.llm.bitmaps import bitmap, member
from guardspark.llm.scratch import lean, Scratch

SEED_WORDS = 5
COVERAGE = 0.6
#: Bits of the seed bitmap: 2 MB, whatever the number of items.
BITMAP_BITS = 1 << 24
MULT = 0x9E3779B97F4A7C15
#: Different words that a worker remembers at once.
REMEMBERED = 500_000


class _WordHashes(dict):
    """Hash of each word as a signed 64-bit number; 0 if nothing is left of it."""

    def __missing__(self, word: str) -> int:
        import xxhash

        core = word.lower()
        while core and not core[0].isalnum():
            core = core[1:]
        while core and not core[-1].isalnum():
            core = core[:-1]
        value = xxhash.xxh64_intdigest(core.encode()) if core else 0
        value = value - (1 << 64) if value >> 63 else value
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_hashes = _WordHashes()


def words_of(text: str | None) -> np.ndarray:
    """A text's words as hashes."""
    found = (text or "").split()
    h = np.fromiter(map(_hashes.__getitem__, found), np.int64, len(found))
    return h[h != 0]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    w, m = words.view(np.uint64), np.uint64(MULT)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * m + w[j : len(words) - n + 1 + j]
    out ^= out >> np.uint64(29)
    return (out * m).view(np.int64)


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of the
    tiles, longest first.  Zeros in ``text`` match nothing."""
    free_i, free_t = np.ones(len(item), bool), text != 0
    tiles = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of unmarked windows of ``n`` words that both sides have."""
        def open_(free):
            return np.flatnonzero(np.convolve(free, np.ones(n, int), "valid") == n) if len(free) >= n else np.zeros(0, int)

        at_i, at_t = open_(free_i), open_(free_t)
        h_i, h_t = windows(item, n)[at_i], windows(text, n)[at_t]
        return at_i[np.isin(h_i, h_t)], at_t, h_t

    top = min(len(item), len(text))
    while top >= least:
        low, high = least - 1, top
        while low < high:  # if a length matches, all shorter ones do
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common(mid)[0]) else (low, mid - 1)
        if low < least:
            break
        at_i, at_t, h_t = common(low)
        h_i = windows(item, low)
        order = np.argsort(h_t, kind="stable")
        at_t, h_t = at_t[order], h_t[order]
        for i in at_i:
            if not free_i[i : i + low].all():
                continue
            for t in at_t[np.searchsorted(h_t, h_i[i]) : np.searchsorted(h_t, h_i[i], "right")]:
                if free_t[t : t + low].all() and (item[i : i + low] == text[t : t + low]).all():
                    free_i[i : i + low] = free_t[t : t + low] = False
                    tiles.append((int(i), int(t), low))
                    break
        top = low if len(common(low)[0]) else low - 1
    return tiles


def _item_words(items: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """Items with words: their words, the seed's length, and seeds by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, words_of(t.as_py())) for i, t in zip(b.column(0), b.column(1), strict=True)]
            rows = [(i, w, min(seed, len(w))) for i, w in rows if len(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32()), pa.array([windows(r[1], r[2]) for r in rows], pa.list_(pa.int64()))], names=["item", "item_words", "n", "seeds"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(run, f"item {kind}, item_words array<bigint>, n int, seeds array<bigint>")


def _stretches(lengths: list[int], seed_bits):
    """For each document with possible seeds: the words in them, zeros between
    stretches, and the seeds' distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seed_bits.value
        for b in batches:
            ids, words, seeds = [], [], []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                w = words_of(t.as_py())
                need, got = np.zeros(len(w), bool), []
                for n in lengths:
                    h = windows(w, n)
                    hit = np.flatnonzero(member(bits, h, BITMAP_BITS))
                    got.append(h[hit])
                    for j in range(n):
                        need[hit + j] = True
                if need.any():
                    at = np.flatnonzero(need)
                    gaps = np.flatnonzero(np.diff(at) > 1) + 1
                    ids.append(i.as_py())
                    words.append(np.insert(w[at], gaps, 0))
                    seeds.append(np.unique(np.concatenate(got)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["doc", "doc_words", "seeds"])

    return run


def _tiler(doc_type: str, item_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share, tiles, longest = [], [], []
            for n, iw, dw in zip(b.column("n"), b.column("item_words"), b.column("doc_words"), strict=True):
                item = np.array(iw.as_py(), np.int64)
                found = tile(item, np.array(dw.as_py(), np.int64), n.as_py())
                share.append(sum(x[2] for x in found) / len(item))
                tiles.append(len(found))
                longest.append(max((x[2] for x in found), default=0))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc"), b.column("item"), pa.array(share, pa.float64()), pa.array(tiles, pa.int64()), pa.array(longest, pa.int64())], names=["row", "doc_id", "item_id", "coverage", "n_tiles", "longest"])

    return run, f"row long, doc_id {doc_type}, item_id {item_type}, coverage double, n_tiles long, longest long"


def contamination(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", seed: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document row and item text with at least ``coverage`` of the
    item's words in tiles: ``doc_id``, ``item_id``, ``coverage``, ``n_tiles``,
    ``longest``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    items = _item_words(items, item_col, text_col, seed).dropDuplicates(["item", "item_words"])
    # Ids may repeat or be null: the joins go by a number of their own.
    items = scratch.table(items.withColumn("no", F.monotonically_increasing_id()), "items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # 1 to ``seed``
    seeds = items.select("no", F.size("item_words").alias("size"), "n", F.posexplode("seeds").alias("at", "seed"))
    seed_bits = spark.sparkContext.broadcast(bitmap(seeds, "seed", BITMAP_BITS))
    kind = docs.schema[doc_col].dataType.simpleString()
    found = docs.select(doc_col, text_col).mapInArrow(lean(_stretches(lengths, seed_bits)), f"doc {kind}, doc_words array<bigint>, seeds array<bigint>")
    found = scratch.table(found.withColumn("row", F.monotonically_increasing_id()), "stretches")
    places = scratch.table(seeds.groupBy("seed", "no", "size", "n").agg(F.collect_list("at").alias("at")), "seeds")
    pairs = found.select("row", F.explode("seeds").alias("seed")).join(places, "seed").groupBy("row", "no", "size", "n").agg(F.collect_list("at").alias("at"))
    # The words of the item that its shared seeds reach: no tiling covers more.
    starts = F.sort_array(F.flatten("at"))
    reach = F.aggregate(starts, F.struct((-F.col("n")).alias("last"), F.lit(0).alias("sum")), lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.col("n"), p - a["last"])).alias("sum")), lambda a: a["sum"])
    pairs = scratch.table(pairs.where(reach >= F.lit(coverage) * F.col("size")).select("row", "no"), "pairs")
    run, schema = _tiler(kind, items.schema["item"].dataType.simpleString())
    tiled = pairs.join(found.select("row", "doc", "doc_words"), "row").join(items.select("no", "item", "item_words", "n"), "no").mapInArrow(lean(run), schema)
    out = scratch.table(tiled.where(F.col("coverage") >= coverage), "contaminated")
    scratch.drop(items, found, places, pairs)
    return out


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items).drop("row")
