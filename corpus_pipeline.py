"""A training corpus in five stages over ``documents``.

Every stage reads what the one before it kept.  ``run`` writes each stage's
result as Parquet in the cluster's shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardspark.llm.bpe import encode_decode
from guardspark.llm.decontaminate import contamination
from guardspark.llm.line_dedup import drop_shared_lines
from guardspark.llm.near_text import near_texts
from guardspark.llm.scratch import Scratch, free
from guardspark.llm.weak_quality import judge


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without some ids.  By merge at every size: the ids grow with
    the input.  Rows without an id stay."""
    return docs.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    score, kept = free(docs, "quality_score"), free(docs, "kept")
    return judge(docs, names=(score, kept)).where(F.col(kept)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share go from all but the last of them."""
    text = free(docs, "kept_text")
    out = drop_shared_lines(docs, names=(free(docs, "n_lines"), free(docs, "n_dropped"), text)).drop("text").withColumnRenamed(text, "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays."""
    return _without(docs, near_texts(docs).where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, contamination(docs, items))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, with a digest of the text that they decode to."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can express neither the classifier nor tiling nor BPE; the test holds
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch, docs, before = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
