"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments A, B, C of 22, 21 and 21 bits,
each a word of the binary Golay code (23, 12) with leading zeros.  Every word
lies within 3 bits of exactly one codeword.  A word's indices are those of all
codewords within 4 bits: one where the nearest is at most 2 bits away, six
otherwise.  Two words that differ in one bit or none share an index, since the
nearest codeword of one is within 4 bits of the other.

At most 3 differing bits over three segments leave two cases:

* no segment differs in more than one bit: an index of A, an index of B and one
  half of C agree (a bit cannot lie in both halves);
* one segment differs in two bits or more: of the other two one is equal and
  the other differs in one bit at most, so that the equal segment and an index
  of the other agree.

Both give keys of at least 33 bits, some 88 for a fingerprint.  Distinct
fingerprints meet under equal keys and are verified there.  Under each key only
a spanning forest of the verified links is kept, so a dense group of near
copies gives as many links as it has members, not all pairs; components are
the same.

Defined results: a null text and one without words have fingerprint zero; rows
with a null id have one too and lend no id; repeated rows share a component;
further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.llm.components import components
from guardspark.llm.scratch import Scratch, lean, shuffle_width

#: Generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEED = 42
#: Lowest bit and width of A, B and C.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs longer than this are linked by search instead of pair by pair.
RUN = 16


def _remainder(x: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder by the generator."""
    x = x.copy()
    for b in range(22, 10, -1):
        x ^= np.where((x >> b) & 1, GENERATOR << (b - 11), 0)
    return x


def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight 4 or less, and how many
    of the six places are in use."""
    errors = np.zeros((2048, 6), np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for w, s in zip(words, _remainder(words), strict=True):
            errors[s, used[s]] = w
            used[s] += 1
    return errors, used


_tables: list = []


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each 23-bit word, as n rows of
    six, and which of them are in use."""
    if not _tables:
        _tables.extend(_cosets())
    errors, used = _tables
    s = _remainder(words)
    return (words[:, None] ^ errors[s]) >> 11, np.arange(6) < used[s][:, None]


def fuzzy_keys(fp: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """All keys of some fingerprints: positions in ``fp`` and keys.  Where at
    most two bits differ, a segment is equal and another differs in one bit or
    none; if so, they do for A and B, B and C, or C and A in this order, and
    keys of these three kinds are enough: some 16."""
    fp = fp.view(np.uint64)
    parts = [((fp >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    coded = [golay_indices(p) for p in parts]
    at, keys = [], []

    def add(kind: int, payload: np.ndarray, mask: np.ndarray) -> None:
        row, _ = np.nonzero(mask)
        at.append(row)
        keys.append((payload[mask] << 3) | kind)

    if bits <= 2:
        for equal, near in ((0, 1), (1, 2), (2, 0)):
            index, used = coded[near]
            add(equal, (parts[equal][:, None] << 12) | index, used)
        return np.concatenate(at), np.concatenate(keys)
    (a, in_a), (b, in_b) = coded[0], coded[1]
    both = ((a[:, :, None] << 12) | b[:, None, :]).reshape(len(fp), 36)
    mask = (in_a[:, :, None] & in_b[:, None, :]).reshape(len(fp), 36)
    for kind, half in enumerate((parts[2] & 0x7FF, parts[2] >> 11)):
        add(kind, (both << 11) | half[:, None], mask)
    kind = 2
    for equal in range(3):
        for near in range(3):
            if equal != near:
                index, used = coded[near]
                add(kind, (parts[equal][:, None] << 12) | index, used)
                kind += 1
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = np.array([digest(join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)), strict=False)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fp``, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def _keyer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(all_), 4096):
                fp = all_[i : i + 4096]
                at, keys = fuzzy_keys(fp, bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], names=["key", "fp"])

    return run


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= bits


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys; ``key`` is sorted."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    # Short runs: each row with the row ``off`` places on.
    short = np.repeat(sizes <= RUN, sizes)
    for off in range(1, min(RUN, int(sizes.max(initial=1)))):
        i = np.flatnonzero((key[off:] == key[:-off]) & short[off:])
        if not len(i):
            break
        i = i[_near(fp[i], fp[i + off], bits)]
        left.append(fp[i])
        right.append(fp[i + off])
    # Long runs: search from one fingerprint to all that are still unreached.
    for k in np.flatnonzero(sizes > RUN):
        rest = fp[starts[k] : starts[k] + sizes[k]]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                v = front.pop()
                near = _near(rest, np.full(1, v), bits)
                found = rest[near]
                if len(found):
                    left.append(np.full(len(found), v))
                    right.append(found)
                    front.extend(found)
                    rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _linker(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k, f):
            a, b = _links(k, f, bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if last:
                yield out(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield out(key, fp)

    return run


def golay_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """``a`` and ``b``: links of distinct fingerprints ``fp`` that differ in
    ``bits`` or fewer, as far as their components need them."""
    spark = fps.sparkSession
    keyed = fps.select("fp").repartition(shuffle_width(spark)).mapInArrow(lean(_keyer(bits)), "key long, fp long")
    sorted_ = keyed.repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
    return sorted_.mapInArrow(lean(_linker(bits)), "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` for every row of ``df``: the
    smallest id that links of ``bits`` or fewer differing bits reach."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find at most 3 differing bits")
    scratch = Scratch(df.sparkSession)
    docs = scratch.table(fingerprints(df, id_col, text_col, words), "fingerprints")
    fps = scratch.table(docs.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    roots = components(golay_links(fps, bits), scratch)
    rooted = fps.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.table(rooted.join(least, "root").select("fp", "component_id"), "named")
    scratch.drop(fps, roots, rooted)
    return docs.join(named, "fp").select(id_col, "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_copies(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
