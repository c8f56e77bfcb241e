"""Source divergence against plain Python over all terms and pairs."""

import collections
import re

from pyspark.sql import functions as F

from guardspark.llm import source_divergence as s
from tests.llm.cases import awkward, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    occ, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [low(t) for t in TERM.findall(text or "")]
        for t in found:
            occ[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in docs.items() if k == lang and n >= 10]
        sources = sorted(g[1] for g in groups if g[0] == lang)

        def shares(counts):
            total = sum(counts) + 2 * len(kept)
            return [1 + 10**9 * (c + 2) // total for c in counts]

        counts = {x: [occ[lang, x, t] for t in kept] for x in sources}
        p = {x: shares(counts[x]) for x in sources}
        q = shares([sum(counts[x][i] for x in sources) for i in range(len(kept))])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for x in sources:
            pairs = [(y, sum(map(f, p[x], p[y]))) for y in sources if y != x]
            terms = [(t, f(a, b)) for t, a, b, c in zip(kept, p[x], q, counts[x]) if c and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, x, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def held(docs, **how):
    got = sorted(map(tuple, s.divergence(docs, **how).collect()))
    assert got == plain([(r.text, r.lang, r.source) for r in docs.collect()])
    return got


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert held(docs)
    odd = docs.withColumns({"lang": F.when(F.col("doc_id") % 3 > 0, "en"), "source": F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("ü"), (F.col("doc_id") % 3).cast("string")))})
    assert held(odd.unionByName(odd.limit(20)).withColumn("n", F.lit(1)))


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert not [r for r in held(docs) if r[4]]  # no term in ten documents: all distances are 0
    many = docs
    for _ in range(4):
        many = many.unionByName(many.withColumn("source", F.concat(F.coalesce("source", F.lit("")), F.lit("x"))))
    assert held(many)
    assert s.divergence(empty(spark)).count() == 0


def test_small_blocks(spark, sf, monkeypatch):
    """Blocks of few pairs give the same pairs as one block."""
    import numpy as np

    for most in (1, 3, 50):
        monkeypatch.setattr(s, "PAIRS", most)
        sizes = np.array([3, 1, 0, 5, 2])
        got = [(int(i), int(j)) for a, b in s._ragged_pairs(sizes) for i, j in zip(a, b)]
        starts = np.cumsum(sizes) - sizes
        assert got == [(o + i, o + j) for o, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n)]


def test_counts_beyond_longs(spark):
    df = spark.sql("SELECT 9000000001 AS n, 27000000000L AS total, 5L AS terms").selectExpr(f"{s._p('n', 'total', 'terms')} AS p", f"{s._p('7L', 'total', 'terms')} AS few")
    r = df.first()
    assert (r.p, r.few) == (1 + 10**9 * 9000000003 // 27000000010, 1 + 9 * 10**9 // 27000000010)
