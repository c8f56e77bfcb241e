"""Validation: every request is either clean or rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.functions.text import is_blank
from guardspark.schemas import ROLES, USE_CASES


def rejection(requests: DataFrame) -> Column:
    """The first reason to reject a request, or null."""
    m, t = F.col("messages"), F.coalesce("tenant_id", F.lit("default"))
    return (
        F.when(m.isNull() & (F.coalesce("prompt", F.lit("")) == ""), "no prompt or messages")
        .when(F.exists(m, lambda x: x["content"].isNull() | is_blank(x["content"])), "blank content")
        .when(F.exists(m, lambda x: ~F.coalesce(x["role"].isin(*ROLES), F.lit(False))), "unknown role")
        .when(~F.coalesce(F.col("use_case"), F.lit("chat")).isin(*USE_CASES), "unknown use case")
        .when(F.char_length(t) > 64, "tenant id too long")
        .when(is_blank(t), "blank tenant id")
    )


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests, with tenant ids trimmed and lower-cased and defaults
    filled in, and rejected ones with ``reason``."""
    judged = requests.withColumn("reason", rejection(requests))
    tenant = F.lower(F.regexp_replace(F.coalesce("tenant_id", F.lit("default")), r"(?U)^\s+|\s+$", ""))
    good = judged.where("reason IS NULL").drop("reason")
    good = good.withColumns({"tenant_id": tenant, "use_case": F.coalesce("use_case", F.lit("chat")), "output_only": F.coalesce("output_only", F.lit(False))})
    return good, judged.where("reason IS NOT NULL")
