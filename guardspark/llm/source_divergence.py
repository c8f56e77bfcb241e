"""How far the sources of a language differ in their words.

The counts of a language's kept terms give every source a smoothed
distribution; two sources are as far apart as the sum over terms of
``(p - q)² / (p + q)``, in whole billionths.  ``p`` depends on a term only
through its count, so a pair of sources needs no more than its joint histogram:
how many terms have ``a`` occurrences in the one and ``b`` in the other.  The
histogram is sparse:

* terms that both have are tallied from the terms' lists of (source, count), in
  blocks of bounded size, one row for each distinct (a, b) of a block;
* cells with a zero follow from each source's own histogram and the number of
  kept terms, by taking away what the cells above hold;
* the function is evaluated once a cell and multiplied by its count.

Terms are counted in the tasks that read the texts; a task hands on what it has
counted whenever it holds ``HELD`` different terms.  A term's list has one entry
for each source of the language; the result itself holds the square of that.

Defined results: null text, lang and source are empty; every row is a document,
ids are not read; a source without kept terms has the counts zero; with no kept
term at all every distance is 0; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardspark.llm.scratch import Scratch

#: Different terms that a task holds before it hands their counts on.
HELD = 400_000
#: Pairs of sources that a task forms at once.
PAIRS = 2_000_000
#: Texts, and terms' lists, that a task reads at once.
TEXTS, LISTS = 500, 5_000
UNIT = 1_000_000_000
#: Bytes of terms, A-Z lower-cased; all others part terms.
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "lang string, source string, term binary, n long, docs long"


def _count(batches):
    """Occurrences of each term and documents with it, by lang and source."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed():
        for (lang, source), (n, docs) in groups.items():
            own = pa.array(list(n), pa.binary())
            columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), own, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(LETTERS).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in groups.values()) > HELD:
            yield from handed()
    yield from handed()


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str, scratch: Scratch) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences and ``docs``."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return scratch.table(counted.withColumn("term", F.col("term").cast("string")), "counts", arrow_rows=TEXTS)


def _ragged_pairs(sizes: np.ndarray):
    """Chunks of index pairs (i < j) within consecutive runs of these sizes,
    about ``PAIRS`` pairs in each."""
    starts = np.cumsum(sizes) - sizes
    after = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum()) - 1  # partners to the right of each entry
    bounds, total = [0], np.cumsum(after)
    while bounds[-1] < len(after):
        seen = total[bounds[-1] - 1] if bounds[-1] else 0
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(total, seen + PAIRS, "right"))))
    for low, high in zip(bounds, bounds[1:]):
        own = after[low:high]
        first = np.repeat(np.arange(low, high), own)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own)


def _tally(batches):
    """Distinct (lang, one, other, a, b) of a block with their terms ``m``."""
    for batch in batches:
        lists = batch.column("held")
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        if not len(flat):
            continue
        langs, sources = batch.column("lang").dictionary_encode(), flat.field("source").dictionary_encode()
        rank = np.argsort(np.argsort(np.array(sources.dictionary.cast(pa.binary()).to_pylist(), dtype=object)))
        lang = np.repeat(langs.indices.to_numpy(), sizes)
        source, n = rank[sources.indices.to_numpy()], flat.field("n").to_numpy()
        own = np.lexsort((source, np.repeat(np.arange(len(sizes)), sizes)))
        entries, code = np.unique(np.stack([lang, source, n], 1)[own], axis=0, return_inverse=True)
        named, by_rank = langs.dictionary, sources.dictionary.take(pa.array(np.argsort(rank)))
        for one, other in _ragged_pairs(sizes):
            cells, m = np.unique(code.ravel()[one].astype(np.uint64) << np.uint64(32) | code.ravel()[other].astype(np.uint64), return_counts=True)
            a, b = entries[(cells >> np.uint64(32)).astype(np.int64)], entries[(cells & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            columns = [named.take(pa.array(a[:, 0])), by_rank.take(pa.array(a[:, 1])), by_rank.take(pa.array(b[:, 1])), pa.array(a[:, 2]), pa.array(b[:, 2]), pa.array(m)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "one", "other", "a", "b", "m"])


def _p(count: str, total: str, terms: str) -> str:
    """SQL for the share of a count in billionths; decimals beyond longs."""
    exact = f"(CAST({UNIT} AS DECIMAL(38,0)) * ({count} + 2)) div CAST({total} + 2 * {terms} AS DECIMAL(38,0))"
    return f"(1 + CASE WHEN {count} < 9000000000 THEN ({UNIT} * ({count} + 2)) div ({total} + 2 * {terms}) ELSE {exact} END)"


F_SQL = "((p - q) * (p - q)) div (p + q)"


def _ranked(df: DataFrame) -> DataFrame:
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return df.withColumn("rank", F.row_number().over(own))


def _zero_cells(joint: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """All cells: each joint cell takes its terms from the cells with a zero."""
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    spread = joint.select("lang", "one", "other", F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c")).select("lang", "one", "other", "c.*")
    own = held.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    left = own.withColumnsRenamed({"source": "one", "n": "a"}).join(pairs.select("lang", "one", "other"), ["lang", "one"])
    right = own.withColumnsRenamed({"source": "other", "n": "b"}).join(pairs.select("lang", "one", "other"), ["lang", "other"])
    left = left.select("lang", "one", "other", F.explode(F.array(cell(a, zero, m), cell(zero, zero, -m))).alias("c")).select("lang", "one", "other", "c.*")
    right = right.select("lang", "one", "other", F.explode(F.array(cell(zero, b, m), cell(zero, zero, -m))).alias("c")).select("lang", "one", "other", "c.*")
    base = pairs.select("lang", "one", "other", zero.alias("a"), zero.alias("b"), F.col("terms").alias("m"))
    cells = spread.unionByName(left).unionByName(right).unionByName(base)
    return cells.groupBy("lang", "one", "other", "a", "b").agg(F.sum("m").alias("m")).where("m <> 0")


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """For every source of a language its distance to each other one (part
    ``pair``, all ranks) and the terms that set it apart from the language
    (part ``term``, ranks to ``top``): ``lang``, ``source``, ``part``, ``item``,
    ``value``, ``rank``."""
    scratch = Scratch(df.sparkSession)
    counts = term_counts(df, text_col, lang_col, source_col, scratch)
    terms = scratch.table(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("held")).where(F.col("docs") >= min_docs), "terms")
    scratch.drop(counts)
    held = terms.select("lang", "term", "lang_n", F.explode("held").alias("h")).select("lang", "term", "lang_n", "h.*")

    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = df.select(filled(lang_col).alias("lang"), filled(source_col).alias("source")).distinct()
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = scratch.table(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"]), "groups")

    right = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
    pairs = groups.select("lang", F.col("source").alias("one"), "total", "terms").join(right, "lang").where("one < other")
    joint = terms.select("lang", F.array_sort("held").alias("held")).mapInArrow(_tally, "lang string, one string, other string, a long, b long, m long")
    joint = scratch.table(joint.groupBy("lang", "one", "other", "a", "b").agg(F.sum("m").alias("m")), "joint", arrow_rows=LISTS)
    cells = _zero_cells(joint, held, pairs).join(pairs, ["lang", "one", "other"])
    valued = cells.withColumns({"p": F.expr(_p("a", "total", "terms")), "q": F.expr(_p("b", "other_total", "terms"))})
    far = valued.groupBy("lang", "one", "other").agg(F.sum(F.expr(f"CAST({F_SQL} AS DECIMAL(38,0)) * m")).cast("long").alias("value"))
    far = scratch.table(pairs.select("lang", "one", "other").join(far, ["lang", "one", "other"], "left").fillna(0, ["value"]), "far")
    both = far.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "value").unionByName(far.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "value"))

    apart = held.join(groups, ["lang", "source"]).withColumns({"p": F.expr(_p("n", "total", "terms")), "q": F.expr(_p("lang_n", "lang_total", "terms"))})
    apart = apart.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(F_SQL).alias("value"))
    parts = _ranked(both).withColumn("part", F.lit("pair")).unionByName(_ranked(apart).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances of all sources and the terms that set each apart."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * v.v) AS p,
         1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.total + 2 * v.v) AS lang_p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - lang_p) * (p - lang_p)) // (p + lang_p) AS value
  FROM s WHERE n > 0 AND p > lang_p),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
