"""Removal of repeated byte strings with a sparse, distributed suffix array.

Every window of ``length`` bytes has an anchor: the k-gram of least hash in it,
the leftmost of equals.  Equal windows have their anchor at the same distance,
so only suffixes at anchors need sorting, about one for every 170 bytes.
Windows that follow each other and share an anchor form a segment.

1. Segments of all texts, with hashes of their k-gram and of their bytes.
   Those whose k-gram stands nowhere else cannot hold a repeat.
2. Equal segments form a class; a class with two members is repeated whole.
   Hot passages shrink to one class here, before anything is sorted.
3. Classes that share a k-gram with another class are sorted: each task sorts
   the suffixes from the anchors (to the right, and mirrored to the left),
   front-codes the run - the length shared with the suffix before, and the
   rest - and sends it to the partition of the k-gram.  There a loser tree
   merges the runs.  It keeps for each head the prefix known to be shared with
   the last suffix put out; of two heads the one with more comes first, and
   only equal ones are compared, from that point on.  Partitions grow in number
   with the classes, not in size.
4. The order and the shared lengths tell, for each distance d of anchor and
   window start, which classes agree on d bytes to the left and length - d to
   the right: a window is repeated if another class falls in the same pair of
   groups.  No pair of classes is ever formed.
5. Repeated windows go back to all members of their class and are cut out.

A k-gram of more than ``DENSE`` classes (a passage shorter than ``length`` in
very many surroundings) is dealt out first: for each ``STEP`` distances its
classes are grouped by all bytes that the windows at those distances have in
common, which are ``length`` - ``STEP`` + 1.  Equal windows lie in one group,
most others lie alone and leave.  A group that is still dense is dealt out once
more, by single windows, and needs only to be counted.  So no task holds more
than ``DENSE`` classes of one key, and no class is left out.  Joins on k-grams
and classes send the rows of keys with a large share of all rows (at most
``SHARE`` keys) to no shuffle: what they meet is broadcast.

Rows are told apart by id and MD5 of the text, segments by the hash of their
bytes, that of their k-gram, their length and their anchor's place.

Defined results: null and short texts keep every byte; rows that share an id or
have none are judged by their own texts; rows that repeat a
document count as further copies, so all their windows are repeated; further
columns are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.llm.bitmaps import bitmap, member
from guardspark.llm.scratch import Scratch, shuffle_width

LENGTH, GRAM = 400, 64
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes of a text that are hashed at once; windows that cross a cut are kept.
PIECE = 1 << 20
#: Bits of the bitmap over documents: 8 MB.
DOC_BITS = 1 << 26
#: Classes that a task sorts into one run.
RUN = 40_000
#: Classes that a task merges at once, about 1 kB each, and of one key.
PART, DENSE = 20_000, 4_096
#: Distances of anchor and window start that share a key of a dense k-gram.
STEP = 25
#: A key with one in this many of all rows is joined without a shuffle.
SHARE = 1_024
CLASS = ["kh", "c", "n", "off"]
#: Bytes of the key before a sorted suffix.
KEY = 16


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE ** i, its inverse, and a random number for each byte."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), x ^ (x >> np.uint64(29))


def _mix(x: np.ndarray, m: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(m)
    return x ^ (x >> np.uint64(29))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours: running minima within blocks of ``w``,
    from both ends."""
    n = len(a)
    padded = np.full(-(-n // w) * w, a.dtype.type(np.iinfo(a.dtype).max))
    padded[:n] = a
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """First window, number of windows, anchor's distance from the first, hash
    of the k-gram and hash of the bytes, for each segment of a text."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[at : at + PIECE + length - 1]
        up, down, of = _powers(PIECE + length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of[part] * down[: len(part)], dtype=np.uint64)])
        grams = _mix((sums[gram:] - sums[:-gram]) * up[: len(part) - gram + 1], 0x94D049BB133111EB)
        ranked = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(ranked, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        c = _mix((sums[last + length] - sums[first]) * up[first], 0xD6E8FEB86659FD93)
        out.append([first + at, last - first + 1, anchor[first] - first, grams[anchor[first]].view(np.int64), c.view(np.int64)])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def _bytes(scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), np.uint8) if scalar.is_valid else np.zeros(0, np.uint8)


def _segmenter(id_type: pa.DataType, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, h, found = [], [], [[] for _ in range(5)]
            for i, t in enumerate(b.column(1)):
                data = _bytes(t)
                s = segments(data, length, gram)
                if len(s[0]):
                    rows.append(np.full(len(s[0]), i))
                    h += [hashlib.md5(data, usedforsecurity=False).digest()] * len(s[0])
                    for x, y in zip(found, s, strict=True):
                        x.append(y)
            if rows:
                s, n, off, kh, c = (np.concatenate(x) for x in found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(h, pa.binary()), pa.array(s), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(kh), pa.array(c)], names=["id", "h", "s", "n", "off", "kh", "c"])

    return run


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    top = min(len(a), len(b))
    while at < top:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            n = min(len(x), len(y))
            d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (d.bit_length() + 7) // 8
        at += 32
    return top


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared lengths, lengths of the rests, and the rests of a sorted run."""
    shared = np.zeros(len(strings), np.uint32)
    for i in range(1, len(strings)):
        shared[i] = shared_prefix(strings[i - 1], strings[i])
    rests = [s[n:] for s, n in zip(strings, shared.tolist(), strict=True)]
    return shared, np.fromiter(map(len, rests), np.uint32, len(rests)), b"".join(rests)


def decode_run(shared: np.ndarray, lens: np.ndarray, rests: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 0, b""
    for n, size in zip(shared.tolist(), lens.tolist(), strict=True):
        last = last[:n] + rests[at : at + size]
        at += size
        yield n, last


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """Merge front-coded runs: which run is next, and how much its string
    shares with the one put out before it."""
    k = len(runs)
    head: list[bytes | None] = []
    for r in runs:
        head.append(next(r, (0, None))[1])
    known = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the winner's."""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared_prefix(head[a], head[b], known[a])
        if head[a][n : n + 1] <= head[b][n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while head[best] is not None:
        yield best, known[best]
        known[best], head[best] = next(runs[best], (0, None))
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def repeated_windows(f_order, f_shared, b_order, b_shared, low, high, length: int) -> Iterator[tuple[int, int, int]]:
    """(class, least d, greatest d) of windows that another class of the same
    k-gram has too.  Orders list the classes as sorted to the right and to the
    left, with what each shares with the one before (the k-gram not counted to
    the left); ``low`` to ``high`` are a class's own distances."""
    g = len(f_order)
    if g < 2 or f_shared[1:].max() + b_shared[1:].max() < length:
        return
    edges = np.unique(np.concatenate([length - f_shared[1:], b_shared[1:] + 1, low, high + 1]))
    edges = edges[(edges >= low.min()) & (edges <= high.max() + 1)]
    by_f, by_b = np.empty(g, np.int64), np.empty(g, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        by_f[f_order] = np.cumsum(np.r_[0, f_shared[1:] < length - a])
        by_b[b_order] = np.cumsum(np.r_[0, b_shared[1:] < a])
        has = np.flatnonzero((low <= a) & (high >= a))
        _, same, count = np.unique(by_b[has] * g + by_f[has], return_inverse=True, return_counts=True)
        for i in has[count[same] > 1]:
            yield int(i), int(a), int(b) - 1


RUNS = "part int, side int, shared binary, lens binary, rests binary, labels binary"
#: What the sorted suffixes stand for: the class and its distances.
LABEL = [*CLASS, "low", "high"]


def _spreader(id_type: pa.DataType, step: int, length: int):
    """Classes by what their windows have in common, ``step`` distances each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, h, found, keys = [], [], [], []
            for i, (t, own) in enumerate(zip(b.column("text"), b.column("classes"), strict=True)):
                data, digest = bytes(t.as_buffer()), b.column("h")[i].as_py()
                for r in own.as_py():
                    anchor = r["s"] + r["off"]
                    for first in range(r["low"] // step * step, r["high"] + 1, step):
                        common = data[anchor - first : anchor - first - step + 1 + length]
                        rows.append(i)
                        h.append(digest)
                        found.append((r["s"], *(r[c] for c in CLASS), max(first, r["low"]), min(first + step - 1, r["high"])))
                        keys.append(hashlib.blake2b(common, digest_size=KEY, key=b"%d %d" % (r["kh"], first)).digest())
            cols = np.array(found, np.int64).reshape(-1, 7).T
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(h, pa.binary()), *(pa.array(x, pa.int64()).cast(y) for x, y in zip(cols, types, strict=True)), pa.array(keys, pa.binary())], names=["id", "h", "s", *LABEL, "key"])

    return run


def _sorter(parts: int, length: int, gram: int):
    """Sorted, front-coded runs of both sides of the classes in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUNS.split(", ")]
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, rows in held.items():
                for side in (0, 1):
                    ordered = sorted(rows, key=lambda r: r[side])
                    coded = front_code([r[side] for r in ordered])
                    labels = np.array([r[2] for r in ordered], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([side], pa.int32()), pa.array([coded[0].tobytes()]), pa.array([coded[1].tobytes()]), pa.array([coded[2]]), pa.array([labels.tobytes()])], names=names)
            held.clear()

        for b in batches:
            for t, classes in zip(b.column("text"), b.column("classes"), strict=True):
                data = bytes(t.as_buffer())
                for r in classes.as_py():
                    anchor = r["s"] + r["off"]
                    key = r["key"] or r["kh"].to_bytes(KEY, "big", signed=True)
                    right = key + data[anchor : anchor - r["low"] + length]
                    left = key + data[anchor : anchor + gram] + data[anchor - r["high"] : anchor][::-1]
                    held.setdefault(zlib.crc32(key) % parts, []).append((right, left, [r[c] for c in LABEL]))
                    size += 1
                if size >= RUN:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _merger(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sides = []
        for side in (0, 1):
            own = [r for r in rows if r["side"] == side]
            labels = [np.frombuffer(r["labels"], np.int64).reshape(-1, len(LABEL)) for r in own]
            merged = merge_runs([decode_run(np.frombuffer(r["shared"], np.uint32), np.frombuffer(r["lens"], np.uint32), r["rests"]) for r in own])
            which, shared = np.array(list(merged), np.int64).reshape(-1, 2).T
            # Within a run strings come in order, so the i-th of a run is its i-th label.
            order = np.argsort(which, kind="stable")
            sorted_ = np.empty((len(which), len(LABEL)), np.int64)
            sorted_[order] = np.concatenate(labels)
            sides.append((sorted_, shared - KEY))
        (right, f), (left, b) = sides
        start_f, start_b = (np.flatnonzero(np.r_[True, x[1:] < gram]) for x in (f, b))
        out = []
        for k, (i, j) in enumerate(zip(start_f, start_b, strict=True)):
            end = start_f[k + 1] if k + 1 < len(start_f) else len(f)
            g = end - i
            if g < 2:
                continue
            own = right[i:end]
            place = {tuple(x): p for p, x in enumerate(own.tolist())}
            b_order = np.array([place[tuple(x)] for x in left[j : j + g].tolist()])
            for p, a, z in repeated_windows(np.arange(g), f[i:end], b_order, b[j : j + g] - gram, own[:, 4], own[:, 5], length):
                out.append((*own[p, :4].tolist(), a, z))
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(x, pa.int32()) for x in cols[2:]]], names=LABEL)

    return run


def _cutter(length: int):
    """Texts without their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, starts, ends = [], [], []
            for t, windows in zip(b.column("text"), b.column("windows"), strict=True):
                data = bytes(t.as_buffer()) if t.is_valid else b""
                spans: list[list[int]] = []
                for w in sorted((w["a"], w["z"] + length) for w in windows.as_py() or ()):
                    if spans and w[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], w[1])
                    else:
                        spans.append(list(w))
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                starts.append([s[0] for s in spans])
                ends.append([s[1] for s in spans])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in b.column("text")], pa.int64()), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["id", "n_bytes", "kept", "starts", "ends"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id_col``, ``n_bytes``, ``kept`` (bytes left), ``starts`` and ``ends``
    of the removed runs, one row per input row."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = df.schema[id_col].dataType.simpleString(), to_arrow_type(df.schema[id_col].dataType)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = docs.mapInArrow(_segmenter(id_type, length, gram), f"id {kind}, h binary, s long, n int, off int, kh long, c long")
    found = scratch.table(found, "segments")
    keyed = docs.withColumn("h", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    rows = F.count(F.lit(1)).alias("rows")
    twice = scratch.table(found.groupBy("kh").agg(rows).where("rows > 1"), "grams")
    shared = scratch.table(_meet(found, twice, ["kh"], twice, found.count()).drop("rows"), "shared")
    scratch.drop(found, twice)
    classes = scratch.table(shared.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "h", "s")).alias("r")), "classes")
    several = scratch.table(classes.groupBy("kh").agg(rows).where("rows > 1"), "several")
    low = (F.col("off") - F.col("n") + 1).alias("low")
    sort = _meet(classes, several, ["kh"], several, classes.count()).select("r.*", *CLASS, low, F.col("off").alias("high"), F.lit(None).cast("binary").alias("key"), "rows")
    sort = scratch.table(sort, "to-sort")
    # Dense k-grams go on by groups of like surroundings, and what is still dense by windows.
    sorts, windows, dense = [sort], None, sort.where(F.col("rows") > DENSE)
    for step in (STEP, 1):
        if dense.isEmpty():
            break
        schema = f"id {kind}, h binary, s long, kh long, c long, n int, off int, low int, high int, key binary"
        spread = scratch.table(_texts(keyed, dense).mapInArrow(_spreader(id_type, step, length), schema), "spread")
        keys = scratch.table(spread.groupBy("key").agg(rows).where("rows > 1"), "keys")
        dense = scratch.table(_meet(spread, keys, ["key"], keys, spread.count()), "dense")
        scratch.drop(spread, keys)
        if step == 1:  # whoever shares a key shares the window
            windows = dense
        else:
            sorts.append(dense)
            dense = dense.where(F.col("rows") > DENSE)
    calm = reduce(DataFrame.unionByName, [x.where(F.col("rows") <= DENSE).drop("rows") for x in sorts])
    parts = max(shuffle_width(spark), calm.count() // PART + 1)
    runs = _texts(keyed, calm).select("text", "classes").mapInArrow(_sorter(parts, length, gram), RUNS)
    merged = runs.groupBy("part").applyInArrow(_merger(length, gram), "kh long, c long, n int, off int, low int, high int")
    whole = classes.where("members > 1").select(*CLASS, low, F.col("off").alias("high"))
    hits = merged.unionByName(whole)
    hits = scratch.table(hits.unionByName(windows.select(LABEL)) if windows else hits, "hits")
    # A window at distance d starts at anchor - d.
    anchor = F.col("s") + F.col("off")
    sizes = classes.select(*CLASS, F.col("members").alias("rows"))
    cut = _meet(shared, hits, CLASS, sizes, shared.count()).select("id", "h", (anchor - F.col("high")).alias("a"), (anchor - F.col("low")).alias("z"))
    cut = scratch.table(cut.groupBy("id", "h").agg(F.collect_set(F.struct("a", "z")).alias("windows")), "cut")
    scratch.drop(shared, classes, several, *sorts, *([windows] if windows else []), hits)
    flagged = _flag(keyed, cut)
    schema = f"id {kind}, n_bytes long, kept binary, starts array<bigint>, ends array<bigint>"
    changed = _join(flagged.where("maybe"), cut, "left").select("id", "text", "windows").mapInArrow(_cutter(length), schema)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    none = F.array().cast("array<bigint>")
    same = flagged.where("not maybe").select("id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("kept"), none.alias("starts"), none.alias("ends"))
    return changed.unionByName(same).withColumnRenamed("id", id_col)


def _meet(many: DataFrame, few: DataFrame, on: list[str], sizes: DataFrame, total: int) -> DataFrame:
    """Inner join on keys of which ``many`` holds ``rows`` rows each, by
    ``sizes``, of ``total`` in all.  Fewer than ``SHARE`` keys can hold more
    than that part of the rows, so their side of ``few`` is small."""
    hot = F.broadcast(sizes.where(F.col("rows") * SHARE > total).select(on))
    calm = many.join(hot, on, "left_anti").join(few.hint("merge"), on)
    return many.join(F.broadcast(few.join(hot, on, "left_semi")), on).unionByName(calm)


def _texts(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """Each text with the list of its classes among ``rows``."""
    # Only documents of such classes are moved; the bitmap over them has a fixed size.
    lists = rows.groupBy("id", "h").agg(F.collect_list(F.struct("s", *LABEL, "key")).alias("classes"))
    # Rows of one repeated document carry the same classes: one of them is enough.
    return _join(_maybe(keyed, rows), lists, "inner").dropDuplicates(["id", "h"]).select("id", "h", "text", "classes")


def _key(id_, h):
    return F.xxhash64(id_, h)


def _flag(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """``keyed`` with ``maybe``: false where the row is surely not in ``ids``."""
    sent = keyed.sparkSession.sparkContext.broadcast(bitmap(ids.select(_key("id", "h").alias("k")), "k", DOC_BITS))

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(member(sent.value, k.to_numpy(), DOC_BITS))

    return keyed.withColumn("maybe", maybe(_key("id", "h")))


def _maybe(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    return _flag(keyed, ids).where("maybe").drop("maybe")


def _join(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """By id (null equals null) and digest, by merge at every size."""
    other = by_doc.withColumnsRenamed({"id": "_id", "h": "_h"}).hint("merge")
    return docs.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), how)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the repeated bytes counted and a digest of the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
