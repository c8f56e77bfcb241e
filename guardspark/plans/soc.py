"""Rollups over audit rows for a security desk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hourly(audit: DataFrame) -> DataFrame:
    """Requests and blocked ones by hour and tenant."""
    return audit.groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("n_blocked"))


def rollup(audit: DataFrame) -> DataFrame:
    """By tenant and verdict, with subtotals."""
    return audit.rollup("tenant_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


def top_tenants(audit: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` tenants with most requests that were not allowed: a report."""
    bad = audit.groupBy("tenant_id").agg(F.count_if(F.col("verdict") != "allow").alias("n_flagged"), F.count(F.lit(1)).alias("n"))
    return bad.orderBy(F.desc("n_flagged"), "tenant_id").limit(k)


def categories(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("threat_categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


#: Distinct tenants are estimated within about 1.6 % (one standard error),
#: ranks of a quantile within 1 %.
HLL_BITS, KLL_K = 12, 400
#: Items that a heavy-hitter sketch follows.
TRACKED = 1_000


def sketched(audit: DataFrame, at: str = "timestamp", amount: str = "total_latency_ms") -> DataFrame:
    """One row an hour that later rollups merge instead of reading audit rows
    again: counts, and sketches of distinct tenants, of the quantiles of
    ``amount`` and of the tenants with most requests.  Its size depends on the
    hours, not on the rows."""
    return audit.groupBy(F.date_trunc("hour", at).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "block").alias("n_blocked"),
        F.hll_sketch_agg("tenant_id", HLL_BITS).alias("tenants"),
        F.kll_sketch_agg_double(F.col(amount).cast("double"), KLL_K).alias("amounts"),
        F.expr(f"approx_top_k_accumulate(tenant_id, {TRACKED})").alias("heavy"),
    )


def merged(rollups: DataFrame, width: Column | None = None, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 5) -> DataFrame:
    """Rollups of ``sketched``, any number of runs of it, by ``width`` (a
    column of ``hour``; the day, if none is given)."""
    by = F.date_trunc("day", "hour") if width is None else width
    out = rollups.groupBy(by.alias("period")).agg(F.sum("n").alias("n"), F.sum("n_blocked").alias("n_blocked"), F.hll_union_agg("tenants").alias("tenants"), F.kll_merge_agg_double("amounts").alias("amounts"), F.expr(f"approx_top_k_combine(heavy, {TRACKED})").alias("heavy"))
    at = F.array(*(F.lit(q) for q in quantiles))
    return out.select("period", "n", "n_blocked", F.hll_sketch_estimate("tenants").alias("n_tenants"), F.kll_sketch_get_quantile_double("amounts", at).alias("quantiles"), F.expr(f"approx_top_k_estimate(heavy, {k})").alias("top_tenants"))
