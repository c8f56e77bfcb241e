"""Exact dedup by skew-safe combining; DataFrame functions only.

Texts are equal when they are identical after each run of white space became
one space.  Three stages put equal texts together, and each of them groups by
the whole text beside its digest, so that a collision of digests never makes
two texts one:

1. locally: partial aggregation leaves one row for a text and task;
2. by salt: a hot digest's rows meet under as many keys as there are salts;
3. globally: what the salts of a hot digest left meets once more.

A digest is hot if over 1/1,024 of all rows have it, so there are fewer than
1,024 of them and their list can be broadcast.  Other digests have one salt and
are done after stage 2, so a text moves once, whatever the number of stages.
The rows then get their group by digest; digests of several texts (none is
known for SHA-256) get it by digest and text.

Defined results: a null text counts as empty, as does its digest; a null id
comes after all others, so it is kept only in a group without any id
(``keep_id`` is null then); of rows that repeat a group's smallest id one stays;
an empty table gives no rows; further columns are left out, whatever their
names, and come back by ``distinct_texts``.  The input is read twice and must
be the same at both reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.scratch import Scratch, free

#: More rows than this share of all make a digest hot.
HOT = 1024
#: Keys among which the local winners of a hot digest are dealt.
SALTS = 64


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _first() -> Column:
    """The least id and, of its rows, the first; ids before no id."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))


def winners(texts: DataFrame, hot: DataFrame, scratch: Scratch, salts: int = SALTS) -> DataFrame:
    """``digest``, ``keep``, ``n`` of every distinct text of ``texts`` (id,
    text, digest), by the three stages."""
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    marked = texts.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = marked.withColumn("salt", salt).groupBy("digest", "hot", "salt", "text").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    # Only hot texts are needed once more.
    salted = scratch.table(salted.select("digest", "hot", "keep", "n", F.when(F.col("hot"), F.col("text")).alias("text")), "salted")
    over = salted.where("hot").groupBy("digest", "text").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    out = scratch.table(salted.where("not hot").select("digest", "keep", "n").unionByName(over.select("digest", "keep", "n")), "winners")
    scratch.drop(salted)
    return out


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: its id, ``keep_id``, ``group_size``, ``kept``
    and ``digest``.  ``digest`` maps a text to any hash of it."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.table(_rows(df, id_col, text_col, digest).select("id", "digest").withColumn("row", F.monotonically_increasing_id()), "rows")
    heat = scratch.table(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), _first()["row"].alias("first")), "heat")
    hot = heat.where(F.col("rows") * HOT > rows.count()).select("digest")
    found = winners(_rows(df, id_col, text_col, digest), hot, scratch, salts)
    groups = found.groupBy("digest").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    groups = scratch.table(groups.join(heat.hint("merge"), "digest"), "groups")
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "digest"]
    one = groups.where("texts = 1")
    # Rows of a hot digest meet their group without a shuffle, the others by merge.
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    hot_rows = marked.where("hot").join(F.broadcast(one.join(F.broadcast(hot), "digest")), "digest")
    cold_rows = marked.where("hot is null").join(one.hint("merge"), "digest")
    out = hot_rows.select(columns).unionByName(cold_rows.select(columns))
    several = groups.where("texts > 1").select("digest")
    if several.limit(1).count():
        out = out.unionByName(_of_collisions(_rows(df, id_col, text_col, digest), several, scratch).select(columns))
    return out


def _of_collisions(texts: DataFrame, digests: DataFrame, scratch: Scratch) -> DataFrame:
    """Groups of texts that share their digest with another text."""
    rows = scratch.table(texts.join(digests.hint("merge"), "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "collided")
    groups = rows.groupBy("digest", "text").agg(_first().alias("least"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", "text", F.col("least.id").alias("keep_id"), "group_size", F.col("least.row").alias("first"))
    return rows.join(groups.hint("merge"), ["digest", "text"])


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.  Ids must be
    unique and not null."""
    own = free(df, "_kept")
    kept = exact_groups(df, id_col, text_col).where("kept").select(F.col(id_col).alias(own))
    return df.join(kept.hint("merge"), F.col(id_col) == F.col(own), "left_semi")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the document that stays in its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
