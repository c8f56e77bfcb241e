"""Labelled attack datasets, as files of JSON lines or CSV, to raw attacks.

A dataset keeps each of its splits in a folder of that name and has columns of
its own; a mapping names them.  Rows that do not fit are handed back beside the
others, with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of raw attacks, beside ``ord``, with their kinds.
KINDS = {"text": "string", "label": "int", "augmented": "boolean", "category": "string", "severity": "string"}
BROKEN = "_broken"


@dataclass(frozen=True)
class Dataset:
    """``columns`` maps raw attacks' columns to the dataset's, ``fixed`` gives
    those that it lacks; ``attacks`` are the values of the label's column that
    mark an attack."""

    name: str
    path: str
    fmt: str = "json"
    columns: dict[str, str] = field(default_factory=lambda: {"text": "text", "label": "label"})
    fixed: dict[str, str] = field(default_factory=dict)
    attacks: tuple[str, ...] = ("1", "true", "malicious")


def _value(d: Dataset, name: str) -> Column:
    if name not in d.columns:
        return F.lit(d.fixed.get(name)).cast(KINDS[name])
    raw = F.col(f"`{d.columns[name]}`")
    if name == "label":
        return F.lower(F.trim(raw)).isin(*d.attacks).cast("int")
    return F.coalesce(F.lower(F.trim(raw)).isin("true", "1", "yes"), F.lit(False)) if name == "augmented" else raw


def read_attacks(spark: SparkSession, d: Dataset, split: str = "train") -> tuple[DataFrame, DataFrame]:
    """Raw attacks (``ord``, ``text``, ``label``, ``augmented``, ``category``,
    ``severity``, ``source``) and the rejected rows (``source``, ``row``,
    ``reason``).  ``ord`` keeps the order of a split's rows within a file.  Every row is in one of both."""
    if d.fmt not in ("json", "csv"):
        raise ValueError(f"unknown format {d.fmt!r}")
    names, where = list(dict.fromkeys(d.columns.values())), f"{d.path}/{split}"
    options = {"header": True, "quote": '"', "escape": '"'} if d.fmt == "csv" else {}
    # Columns of CSV go by place: the files' own header tells their names.
    there = spark.read.options(**options).csv(where).columns if d.fmt == "csv" else names
    if missing := set(names) - set(there):
        raise ValueError(f"{d.name} has no columns {sorted(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*there, BROKEN])
    reader = spark.read.schema(schema).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    rows = reader.format(d.fmt).load(where).withColumn("ord", F.monotonically_increasing_id())
    text, label = F.col(f"`{d.columns['text']}`"), F.col(f"`{d.columns['label']}`") if "label" in d.columns else F.lit("1")
    reason = F.when(F.col(BROKEN).isNotNull(), "not readable").when(text.isNull(), "no text").when(label.isNull(), "no label")
    rows = rows.withColumn("_reason", reason)
    good = rows.where("_reason IS NULL").select("ord", *(_value(d, c).alias(c) for c in KINDS), F.lit(d.name).alias("source"))
    whole = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*(F.col(f"`{c}`") for c in names))))
    return good, rows.where("_reason IS NOT NULL").select(F.lit(d.name).alias("source"), whole.alias("row"), F.col("_reason").alias("reason"))
