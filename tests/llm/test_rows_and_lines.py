"""Line dedup, quality rules and Hilbert shards."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from guardspark.llm import hilbert_shards as h
from guardspark.llm import line_dedup, quality_rules
from tests.llm.cases import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain_lines(rows):
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                held[key(x)].add(i)
    gone = lambda i, x: i is not None and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward(spark).unionByName(awkward(spark).limit(1).withColumn("doc_id", F.lit(None).cast("long")))):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_shared_lines(docs).collect()]
        assert sorted(got, key=str) == sorted(plain_lines(rows), key=str)
    assert line_dedup.drop_shared_lines(empty(spark)).count() == 0


def plain_measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for p in range(len(w) - 2):
        if grams[tuple(w[p : p + 3])] > 1:
            hit |= {p, p + 1, p + 2}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_measures_and_policies(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward(spark), empty(spark)):
        judged = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
        assert len(judged) == docs.count()
        for r in judged:
            n, chars, symbols, dup, rep = plain_measures(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert (r.fail_bits & quality_rules.BASE != 0) == (n < 50 or 100 * rep > 50 * n)
            assert r.kept == (r.fail_bits == 0) and len(r.measures) == len(quality_rules.RULES)


def test_ablation(spark, sf):
    judged = quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.fail_bits for r in judged.collect()]
    for r in quality_rules.ablation(judged).collect():
        b = quality_rules.BIT[r.rule]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(x & b != 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        index = h.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = h.op4_hilbert_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "rows", None)
        slots[r.shard].append((r.slot, r.hilbert))
    sizes = [len(x) for x in slots.values()]
    assert set(slots) == set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in slots.values())
    walk = [y for k in sorted(slots) for _, y in sorted(slots[k])]
    assert walk == sorted(walk)


def test_few_and_awkward_rows(spark):
    rows = awkward(spark).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"), "lang")
    cells = [h.category_cell(F.col("lang")), h.size_cell(F.col("size"))]
    got = h.hilbert_shards(rows, cells, ["size", "doc_id"], shards=40).collect()
    assert len(got) == rows.count() and sorted(r.shard for r in got) == list(range(len(got))) and {r.slot for r in got} == {0}
    assert h.hilbert_shards(rows.limit(0), cells, ["size", "doc_id"]).count() == 0


def test_clashing_columns(spark):
    """Columns with the operator's own names neither crash nor get lost."""
    import corpus_pipeline
    from guardspark.llm.line_dedup import drop_shared_lines

    line = "one line that stands in many documents"
    rows = [(i, f"{line}\n{i}", "x", i, "y", "z") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, n_chars long, kept_text string, _lines string")
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert [out[i].text for i in range(4)] == ["0", "1", "2", f"{line}\n3"]
    assert {(r._id, r.kept_text, r._lines) for r in out.values()} == {("x", "y", "z")}
    assert {r._id for r in drop_shared_lines(df).collect()} == {"x"}


def test_written_shards_are_pruned(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    narrow = twice.select("doc_id", "lang", F.octet_length("text").alias("size"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    placed = h.hilbert_shards(narrow, [h.category_cell(F.col("lang")), h.range_cell(F.col("doc_id"), low, high)], ["size", "doc_id"], shards=16)
    ranges = h.write_shards(twice, placed, str(tmp_path / "out"), ["doc_id", "lang"]).collect()
    assert len(ranges) == 16 and sum(r.rows for r in ranges) == twice.count()
    whole = spark.read.parquet(str(tmp_path / "out/rows")).drop("_shard").select(twice.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, twice.collect()))
    got = h.read_between(spark, str(tmp_path / "out"), "doc_id", low, low + (high - low) // 10)
    want = twice.where(F.col("doc_id").between(low, low + (high - low) // 10))
    assert sorted(map(str, got.select(twice.columns).collect())) == sorted(map(str, want.collect()))
    # Fewer files than all, by range, in one dimension and in the other.
    count = lambda f: len(f.inputFiles())
    opened = got.select(F.input_file_name()).distinct().count()
    assert opened < count(whole) / 2
    lang = docs.first().lang
    assert sum(r.least_lang <= lang <= r.greatest_lang for r in ranges) < 16


def test_ablation_query_reads_the_ledger(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ledger = quality_rules.store(docs)
    assert "text" not in ledger.columns and {"fail_bits", "measures"} <= set(ledger.columns)
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality_rules.quality_ablation(spark, sf).collect():
        own, mask = quality_rules.BIT[r.rule], quality_rules.POLICIES[r.version]
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(x & own != 0 for x in bits), sum(x & mask == own for x in bits), sum(x & (mask - own) == 0 for x in bits))


OWN = "_at string, _part string, _row string, _n string, _before string, _all string, _rank string, _w string, _p string, _words string, _lines string, n_words string"


def test_inner_names_take_nothing_from_the_input(spark):
    """Shards and quality rules: columns called as their inner ones stay."""
    names = [c.split()[0] for c in OWN.split(", ")]
    rows = [(i, f"some text {i} " * (i % 7), *(f"{c}{i}" for c in names)) for i in range(90)] + [(None, None, *names)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {OWN}")
    placed = h.hilbert_shards(df, [h.size_cell(F.length("text")), h.category_cell(F.col("_at"))], ["doc_id"], shards=4)
    got = {r.doc_id: r for r in placed.collect()}
    assert len(got) == 91 and sorted(collections.Counter(r.shard for r in got.values()).values()) == [22, 23, 23, 23]
    assert all(r[c] == (f"{c}{i}" if i is not None else c) for i, r in got.items() for c in names)
    judged = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(df)).collect()}
    assert all(r[c] == (f"{c}{i}" if i is not None else c) for i, r in judged.items() for c in names[:-1])
    assert all(r.n_words == (3 * (i % 7) if i is not None else 0) for i, r in judged.items())
