"""Near copies by the similarity of their word shingles.

A text is the set of its shingles of five words; two texts are near copies if
their sets have a Jaccard similarity of 0.8 or more.  Equal sets become one
node first.  The near ones meet by the SimHash of their set and its Golay keys
(``simhash``): fingerprints of 2 or fewer differing bits, and equal ones, are
candidates, verified on the whole sets.  At a similarity of 0.8 a SimHash
differs in some 10 bits, so this finds the groups of close copies only; what
lies in one component by then is not compared again.  Candidates between
components come from MinHash: 24 keys of five minima each, so that
a pair of similarity 0.8 shares a key with a probability of 0.9999 and any more
similar pair with a higher one.  A fingerprint of 2,048 further minima, one
bit each, is compared within the join: a pair of similarity 0.8 differs in 205
bits on average and in more than ``limit`` with a probability of 0.00003 (parts
of it are compared first, likewise).  A
pair is compared under the first key that it shares only.  What is left is
verified on the whole sets.

All pairs of a short run of equal keys are compared.  A long run (a dense group
of near copies) begins with its first node against all others.  As long as its
rest lies in several components, nodes outside of its largest component follow,
each against the whole run, 16 in the second round and 16 times as many in each
further one.  A node that was compared with all others leaves the run; no
run is cut: rounds go on until each is one component or used up.

Defined results: texts without words are near copies of each other, and of no
others; rows with a null id have a component too and lend no id; repeated rows
share a component; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.bitmaps import bitmap, member
from guardspark.llm.components import components
from guardspark.llm.scratch import lean, Scratch
from guardspark.llm.simhash import golay_links, majority

WORDS, SIMILARITY = 5, 0.8
BANDS, MINIMA = 24, 5
#: Bits in which SimHashes may differ.  Keys for 3 take five times the room, and
#: the minima find such pairs too.
BITS_APART = 2
#: Bits of a node's fingerprint, kept as 64-bit numbers.
BITS = 2048
#: All pairs of runs up to this length are compared in the first round.
RUN = 32
#: Nodes of a long run compared with all of it in the second round, and how
#: many times as many in each further one.
WIDTH, GROWTH = 16, 16
SEED = 42
#: Texts, or pairs of sets, that a task hands to Python at once.
ROWS = 500
#: Shingles that are multiplied at once.
PART = 64
#: Bits of the bitmap over nodes whose sets are wanted: 8 MB.
NODE_BITS = 1 << 26
_rng = np.random.default_rng(SEED)
_MULT = _rng.integers(0, 1 << 32, BANDS * MINIMA + BITS, np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
WORDS_OF_BITS = [f"f{i}" for i in range(BITS // 64)]


def limit(similarity: float, bits: int = BITS) -> int:
    """Differing bits up to which a pair may have this similarity."""
    p = (1 - similarity) / 2
    return int(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) <= words:
        return np.array([digest(join(tokens), SEED)], np.uint64)
    return np.unique(np.array([digest(join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)), strict=False)], np.uint64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash function."""
    least = np.full(len(_MULT), np.iinfo(np.uint32).max, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    products = np.empty((min(PART, len(h)), len(_MULT)), np.uint32)
    for i in range(0, len(h), PART):
        some = h[i : i + PART, None]
        np.minimum(least, np.multiply(some, _MULT, out=products[: len(some)]).min(axis=0), out=least)
    return least


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and the fingerprint; no key of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(BITS // 64, np.int64)
    least = _minima(hashes)
    keys = np.arange(BANDS, dtype=np.uint64)
    for m, column in zip(_MIX, least[: BANDS * MINIMA].reshape(BANDS, MINIMA).T.astype(np.uint64), strict=True):
        keys = (keys ^ column) * m
        keys ^= keys >> np.uint64(29)
    rest = least[BANDS * MINIMA :]
    bits = ((rest ^ (rest >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of sorted distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sets(id_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        longs = pa.list_(pa.int64())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [shingles(t.as_py(), words) for t in part.column(1)]
                fp = pa.array([majority(h) for h in found], pa.int64())
                sig = [xxhash.xxh3_128_digest(h.tobytes()) for h in found]
                keys, bits = zip(*map(sketch, found), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sig, pa.binary()), fp, pa.array(keys, longs), pa.array(bits, longs), pa.array([h.view(np.int64) for h in found], longs)], names=[id_col, "sig", "fp", "keys", "bits", "shingles"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[x.values.to_numpy().view(np.uint64) for x in batch.column(c)] for c in (2, 3)]
            yes = pa.array([jaccard(a, b) >= least for a, b in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), batch.column(1).filter(yes)], names=["a", "b"])

    return run


def _candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the rows that are pivots with all rows of their run that lie in
    another component, as far as sizes and fingerprints allow, under the first
    key that both share (``band`` counts the keys before it)."""
    names = ["key", "no", "band", "root", "pivot", "n", "keys", *WORDS_OF_BITS]
    a = rows.where("pivot").select("key", *(F.col(c).alias(f"{c}_a") for c in names[1:]))
    differing = lambda some: sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in some), F.lit(0)) <= limit(similarity, 64 * len(some))
    alike = differing(WORDS_OF_BITS[:4]) & differing(WORDS_OF_BITS[:12]) & differing(WORDS_OF_BITS)
    sized = F.least("n", "n_a") >= F.lit(similarity) * F.greatest("n", "n_a") - 1e-6
    once = ~F.col("pivot") | (F.col("no") > F.col("no_a"))
    first = ~F.arrays_overlap(F.slice("keys", F.lit(1), F.col("band")), F.slice("keys_a", F.lit(1), F.col("band")))
    both = a.join(rows.select(names), (a["key"] == rows["key"]) & (F.col("root") != F.col("root_a")) & once & sized & alike & first)
    return both.select(F.least("no", "no_a").alias("a"), F.greatest("no", "no_a").alias("b"))


def _golay_pairs(nodes: DataFrame, least: DataFrame) -> DataFrame:
    """Pairs of nodes whose SimHash is equal, or near by its Golay keys: each
    node with the ``least`` one of its SimHash, and these by the links of theirs."""
    equal = nodes.select("fp", "no").join(least, "fp").where("no <> least").select(F.col("least").alias("a"), F.col("no").alias("b"))
    found = golay_links(least, BITS_APART).distinct()
    for x in "ab":
        found = found.join(least.select(F.col("fp").alias(x), F.col("least").alias(f"at_{x}")), x)
    return equal.union(found.select(F.least("at_a", "at_b"), F.greatest("at_a", "at_b")))


def _wanted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without rows that are surely not among ``rows``."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(rows.select(F.xxhash64("rep").alias("k")), "k", NODE_BITS))

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(member(sent.value, k.to_numpy(), NODE_BITS))

    return docs.where(maybe(F.xxhash64("row")))


def _share(no: Column, turn: int) -> Column:
    """A number from 0 to 1 that is new for each node and round."""
    return F.pmod(F.xxhash64(no, F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``id_col`` and ``component_id`` for every row of ``df``: the smallest id
    that links of at least ``similarity`` reach."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(id_col, text_col).mapInArrow(lean(_sets(id_col, words)), f"{id_col} {kind}, sig binary, fp long, keys array<bigint>, bits array<bigint>, shingles array<bigint>")
    docs = scratch.table(docs.withColumn("row", F.monotonically_increasing_id()), "sets", arrow_rows=ROWS)
    # One node for equal sets; one of their rows stands for them.
    nodes = docs.groupBy("sig").agg(F.min(id_col).alias("first"), F.min(F.struct("row", F.size("shingles").alias("n"), "fp", "keys", "bits")).alias("r"))
    nodes = scratch.table(nodes.select("sig", "first", F.col("r.row").alias("rep"), "r.n", "r.fp", "r.keys", "r.bits", F.col("r.row").alias("no")), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        pairs = scratch.table(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = scratch.table(_wanted(docs.select("row", "shingles"), ends), "ends")  # with a few that no pair asks for
        a, b = (sets.select(F.col("row").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        new = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(lean(_similar(similarity)), "a long, b long")
        new = scratch.table(new, "similar", arrow_rows=ROWS)
        scratch.drop(pairs, sets)
        return new

    least = scratch.table(nodes.groupBy("fp").agg(F.min("no").alias("least")), "simhashes")
    links = verified(_golay_pairs(nodes, least))
    scratch.drop(least)
    roots, done = components(links, scratch), [links]
    keyed = nodes.select("no", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("run")).where("run > 1")
    keyed = keyed.join(shared, "key").join(roots.select(F.col("a").alias("no"), F.col("b").alias("root")), "no", "left")
    keyed = scratch.table(keyed.select("key", "no", "band", F.coalesce("root", "no").alias("root"), "run"), "shared")
    # A run within one component holds nothing to compare.
    runs = keyed.groupBy("key").agg(F.min("no").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    met, keyed = keyed, scratch.table(keyed.join(runs, "key").select("key", "no", "band", "root", ((F.col("run") <= RUN) | (F.col("no") == F.col("least"))).alias("pivot"), (F.col("run") > RUN).alias("goes_on")), "keyed")
    scratch.drop(met)
    sketches = nodes.select("no", "n", "keys", *(F.col("bits")[i].alias(c) for i, c in enumerate(WORDS_OF_BITS)))
    turn = 0
    while True:
        new = verified(_candidates(keyed.join(sketches, "no"), similarity))
        done.append(new)
        if not new.isEmpty():
            links = links.unionByName(new)
            scratch.drop(roots)
            roots = components(links, scratch)
        # Long runs go on without their pivots where the rest lies in several components.
        rest = keyed.where("goes_on AND NOT pivot").select("key", "no", "band")
        rest = rest.join(roots.select(F.col("a").alias("no"), F.col("b").alias("to")), "no", "left").select("key", "no", "band", F.coalesce("to", "no").alias("root"))
        rest = scratch.table(rest, "rest")
        sizes = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
        open_ = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        outside = (F.col("root") != F.col("most.root")) & (_share(F.col("no"), turn) * (F.col("all") - F.col("most.size")) < WIDTH * GROWTH**turn)
        going = scratch.table(rest.join(open_, "key").select("key", "no", "band", "root", outside.alias("pivot"), F.lit(True).alias("goes_on")), "going")
        scratch.drop(keyed, rest)
        keyed = going
        turn += 1
        if keyed.isEmpty():
            break
    rooted = nodes.select("no", "sig", "first").join(roots.select(F.col("a").alias("no"), F.col("b").alias("root")), "no", "left").withColumn("root", F.coalesce("root", "no"))
    rooted = scratch.table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.table(rooted.join(least, "root").select("sig", "component_id"), "named")
    scratch.drop(nodes, rooted, keyed, roots, *done)
    # What stays is small: the sets are no longer needed.
    out = scratch.table(docs.select(id_col, "sig").join(named, "sig").select(id_col, "component_id"), "components")
    scratch.drop(docs, named)
    return out
