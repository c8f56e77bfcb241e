"""Line dedup: lines that many documents share leave all but the last of them.

Every document adds each distinct key of its lines once; a first aggregation
per (key, document) spreads a hot key over the cluster, a second one counts
documents.  Only 16-byte key hashes are shuffled.  The text itself moves once,
to meet the list of keys that its document loses, and the lines are put
together again by position with array functions.

Defined results: a null or empty text is one empty line; rows with a null id
stay as they are and count nowhere; rows that repeat an id count as one
document; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.scratch import Scratch, free

#: White space that the keys lose at both ends.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def drop_shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """Drop every line whose key has ``min_chars`` code points and stands in
    ``min_docs`` documents, except in the largest id that holds it.

    Adds the columns ``names``, which replace columns of the same names; all
    others stay.  One row per input row.
    """
    scratch = Scratch(df.sparkSession)
    own_id, own_lines, own_kept, own_lost = (free(df, c) for c in ("_id", "_lines", "_kept", "_lost"))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    long_keys = F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars)
    pairs = F.array_distinct(F.transform(long_keys, lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("second"), k).alias("b"))))
    held = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(pairs).alias("k")).select("_id", "k.a", "k.b")
    held = scratch.table(held.groupBy("a", "b", "_id").agg(F.lit(1).alias("one")).drop("one"), "held")
    shared = scratch.table(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("_id").alias("_last")).where(F.col("docs") >= min_docs).drop("docs"), "shared")
    lost = scratch.table(held.join(shared, ["a", "b"]).where(F.col("_id") != F.col("_last")).groupBy("_id").agg(F.collect_set("a").alias("_lost")), "lost")
    scratch.drop(held, shared)
    kept = F.filter(F.col(own_lines), lambda x: ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col(own_lost), F.xxhash64(line_key(x)))))
    # A merge join at every size: the list of lost keys grows with the input.
    lost = lost.select(F.col("_id").alias(own_id), F.col("_lost").alias(own_lost)).hint("merge")
    with_lines = df.join(lost, F.col(id_col) == F.col(own_id), "left").withColumn(own_lines, lines)
    kept = F.when(F.col(own_lost).isNull(), F.col(own_lines)).otherwise(kept)
    n_lines, n_dropped, text = names
    out = with_lines.withColumn(own_kept, kept)
    return out.withColumns({n_lines: F.size(own_lines).cast("long"), n_dropped: (F.size(own_lines) - F.size(own_kept)).cast("long"), text: F.array_join(own_kept, "\n")}).drop(own_lines, own_kept, own_lost, own_id)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
s AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (
  SELECT k.*, coalesce(k.doc_id <> s.last_doc, false) AS lost FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
