"""Inverted lists against full scans, and vectors that can't be searched for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.operators import index as ix
from guardspark.operators import semantic
from guardspark.plans.queries import letter_vectors
from guardspark.plans.screen import screen

VECTORS = "index long, embedding array<float>"


def clustered(n=3000, width=24, clusters=20, seed=3, lengths=False):
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(clusters, width))
    v = center[rng.integers(clusters, size=n)] + 0.25 * rng.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[: n // 3] = v[0]  # a third of all vectors are one
    return (v * rng.uniform(0.2, 3, size=(n, 1)) if lengths else v).astype(np.float32)


def plain(q, c, threshold, k):
    out = set()
    for i, row in enumerate(q.astype(np.float64) @ c.astype(np.float64).T):
        near = [j for j in np.lexsort((-np.arange(len(c)), -np.round(row, 9))) if row[j] >= threshold][:k]
        out |= {(i, r + 1, int(j), round(float(row[j]), 6)) for r, j in enumerate(near)}
    return out


@pytest.mark.parametrize("lengths", [False, True])
def test_equal_to_a_full_scan(spark, tmp_path, monkeypatch, lengths):
    monkeypatch.setattr(ix, "CHUNK", 24 * 100)
    c = clustered(lengths=lengths)
    q = np.concatenate([c[::100], clustered(40, seed=8), np.zeros((1, 24), np.float32)])
    table = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS)
    built = ix.build_index(table(c), str(tmp_path / "index"), 30)
    assert sum(len(r.ids) for r in built.chunks.collect()) == len(c)
    queries = table(q).withColumnRenamed("index", "q")
    for found in (built, ix.read_index(spark, str(tmp_path / "index"))):
        for threshold, k in ((0.9, 3), (0.3, 5), (-2.0, 1)):
            if threshold < 0 and lengths:
                continue
            got = {(r.q, r.rank, r["index"], round(r.similarity, 6)) for r in found.search(queries, "q", threshold, k).collect()}
            assert got == plain(q, c, threshold, k)
    if not lengths:  # most pairs are skipped
        assert built.pairs_left(queries, "q", 0.9) < 0.45 * len(q) * len(c)  # a third of all vectors are one, which most queries of its list meet


def test_letters_skip_most_pairs(spark, sf, tmp_path):
    v = letter_vectors(spark.read.parquet(f"{sf}/documents.parquet"))
    built = ix.build_index(v.withColumnRenamed("doc_id", "index"), str(tmp_path / "i"), 64)
    n = v.count()
    assert built.pairs_left(v, "doc_id", 0.999) < 0.4 * n * n


def test_empty_and_broken_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], VECTORS)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0])], VECTORS)
    assert ix.build_index(empty, str(tmp_path / "a")).search(q.withColumnRenamed("index", "q"), "q", 0.5).count() == 0
    built = ix.build_index(q, str(tmp_path / "b"))
    assert [(r.q, r["index"]) for r in built.search(q.withColumnRenamed("index", "q"), "q", 0.5).collect()] == [(0, 0)]
    assert [(r.q, r["index"]) for r in semantic.top_matches(q.withColumnRenamed("index", "q"), q, "q", 0.5).collect()] == [(0, 0)]
    assert semantic.corpus_width(q) is None and semantic.corpus_width(empty) is None and semantic.corpus_width(q.limit(2)) == 2


def requests(spark):
    vectors = [[1.0, 0.0], None, [1.0], [float("nan"), 1.0], [None, 1.0], [0.0, 1.0]]
    rows = [(f"r{i}", "a text", v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "request_id string, prompt string, embedding array<float>").selectExpr("request_id", "CAST(NULL AS array<struct<role: string, content: string, name: string, tool_call_id: string>>) AS messages", "prompt", "'t' AS tenant_id", "CAST(NULL AS array<string>) AS scanners", "false AS output_only", "embedding")


CORPUS = "index int, text string, category string, severity string, source string, embedding array<float>"


def test_search_errors_block(spark, tmp_path):
    cfg = EngineConfig(semantic_enabled=True)
    good = spark.createDataFrame([(0, "known", "T-JB", "high", "s", [1.0, 0.0])], CORPUS)
    first = lambda corpus, index=None: {r.request_id: (r.verdict, r.rule) for r in screen(requests(spark), cfg, corpus, index=index).select("request_id", "verdict", F.get("semantic.findings", F.lit(0))["rule_id"].alias("rule")).collect()}
    want = {"r0": ("block", "SEM-001"), "r1": ("block", "SEM-EMB-001"), "r2": ("block", "SEM-CORP-001"), "r3": ("block", "SEM-EMB-001"), "r4": ("block", "SEM-EMB-001"), "r5": ("allow", None)}
    assert first(good) == want
    assert first(good, ix.build_index(good, str(tmp_path / "i"))) == want
    mixed = good.unionByName(spark.createDataFrame([(1, "short", None, None, None, [1.0])], CORPUS))
    for broken in (good.where("index < 0"), mixed, good.withColumn("embedding", F.expr("array(CAST('NaN' AS float), 0f)"))):
        got = first(broken)
        assert {got[r] for r in ("r0", "r2", "r5")} == {("block", "SEM-CORP-001")} and {got[r] for r in ("r1", "r3", "r4")} == {("block", "SEM-EMB-001")}


def test_many_blocks_are_dealt_out_and_travel_as_floats(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 40)
    rng = np.random.default_rng(9)
    q, c = ([(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(n)] for n in (11, 90))
    q, c = (spark.createDataFrame(x, VECTORS).repartition(7) for x in (q, c))
    want = sorted((r.q, r["index"]) for r in q.crossJoin(c.select(F.col("index").alias("c"), F.col("embedding").alias("e"))).where("aggregate(zip_with(embedding, e, (x, y) -> double(x) * double(y)), 0d, (a, x) -> a + x) >= 0.5").select(F.col("index").alias("q"), F.col("c").alias("index")).collect())
    for few in ("corpus", "queries"):
        got = semantic.top_matches(q.withColumnRenamed("index", "q"), c, "q", 0.5, 1000, few)
        assert sorted((r.q, r["index"]) for r in got.collect()) == want and len(want) > 50
    sizes = semantic._blocks(c, "index", 3).select(F.length("data").alias("bytes"), F.size("ids").alias("n")).collect()
    assert all(r.bytes == 4 * 4 * r.n for r in sizes)
