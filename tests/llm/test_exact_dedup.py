"""Exact dedup against grouping in plain Python."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from guardspark.llm import exact_dedup as x
from tests.llm.cases import awkward, empty


def plain(rows):
    """Per row: (id, keep id, size, digest); and how many rows of a group stay."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str), len(groups)


def held(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = x.exact_groups(docs, **how).collect()
    want, groups = plain(rows)
    if "digest" not in how:
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=str) == want
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nameless = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    spaced = docs.limit(5).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.regexp_replace("text", " ", " \t\r\n")})
    held(docs.unionByName(nameless).unionByName(spaced).unionByName(spaced))
    held(awkward(spark).unionByName(nameless).unionByName(nameless))
    assert x.exact_groups(empty(spark)).count() == 0


def test_colliding_digests(spark, sf):
    """With a digest that many texts share, whole texts decide."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(awkward(spark))
    held(docs, digest=lambda t: F.char_length(t) % 7)


def test_hot_digests(spark, monkeypatch):
    """A third of all rows under one text; few digests are hot."""
    monkeypatch.setattr(x, "HOT", 8)
    rows = spark.range(0, 3000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), (F.col("id") / 2).cast("long"))).alias("text"))
    held(rows, salts=3)
    held(rows, salts=3, digest=lambda t: F.substring(t, 1, 6))


def test_further_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"digest": F.lit("d"), "row": F.lit("r"), "_kept": F.lit("k"), "id": F.lit(1)})
    got = x.distinct_texts(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in x.exact_groups(docs).where("kept").collect())
