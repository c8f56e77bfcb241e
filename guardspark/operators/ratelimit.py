"""Sliding-window rate limits.

A decision depends on the decisions before it: only accepted requests fill the
window.  One key's requests are taken in order of time with a state of at most
``limit`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.operators.folds import fold_in_order


def key_of(tenant_header: Column) -> Column:
    return F.concat(F.lit("rl:"), F.coalesce(tenant_header, F.lit("default")))


def applies_to(path: Column) -> Column:
    return path.startswith("/v1/")


def decide(kept: list[float], ts: float, limit: int, window: int) -> tuple[bool, int, int]:
    """Whether a request at ``ts`` is allowed, how many more are, and after how
    many seconds to try again; ``kept`` holds the accepted times."""
    kept[:] = [t for t in kept if ts - t < window]
    if len(kept) < limit:
        kept.append(ts)
        return True, limit - len(kept), 0
    return False, 0, max(1, int(window - (ts - min(kept))) + 1)


def rate_limit(events: DataFrame, cfg: EngineConfig, key: str = "tenant_key", ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """``id_col``, ``key``, ``allowed``, ``remaining`` and ``retry_after`` for
    each event; ``ts_col`` holds seconds.  Events of one time are taken by id;
    null keys share a limit, a null time counts as 0."""
    limit, window = cfg.requests_per_minute, cfg.window_seconds
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_col)}
    rows = events.select(key, F.coalesce(F.col(ts_col).cast("double"), F.lit(0.0)).alias("ts"), id_col)
    step = lambda kept, row: (row[1], *decide(kept, row[0], limit, window))
    return fold_in_order(rows, key, ["ts", id_col], list, step, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, allowed boolean, remaining int, retry_after int").select(id_col, key, "allowed", "remaining", "retry_after")


def limit_requests(requests: DataFrame, cfg: EngineConfig, path_col: str = "path", tenant_col: str = "tenant_header", ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The limiter in front of an API: ``id_col``, ``status``, ``retry_after``,
    ``limit`` and ``remaining`` of every request.  Paths outside of the API
    pass without being counted and carry no limit."""
    counted = requests.withColumn("_key", key_of(F.col(tenant_col)))
    api = F.coalesce(applies_to(F.col(path_col)), F.lit(False))
    decided = rate_limit(counted.where(api), cfg, "_key", ts_col, id_col)
    limited = decided.select(id_col, F.when(F.col("allowed"), 200).otherwise(429).alias("status"), F.when(~F.col("allowed"), F.col("retry_after")).alias("retry_after"), F.lit(cfg.requests_per_minute).alias("limit"), "remaining")
    none = F.lit(None).cast("int")
    return limited.unionByName(counted.where(~api).select(id_col, F.lit(200).alias("status"), none.alias("retry_after"), none.alias("limit"), none.alias("remaining")))
