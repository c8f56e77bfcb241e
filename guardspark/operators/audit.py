"""Audit rows of evaluated requests and scanned outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import LAYERS, EngineConfig
from guardspark.functions.text import tokenize_metadata
from guardspark.operators.actions import response_confidence


def _rows(df: DataFrame, kind: str, metadata: Column, details: Column, cfg: EngineConfig, timestamp: Column, batch: str) -> DataFrame:
    # A row's own id: requests may share theirs or have none, and an output's audit is not its request's.
    own = F.concat_ws("|", F.lit(kind), F.lit(batch), F.monotonically_increasing_id().cast("string"), timestamp.cast("timestamp").cast("string"), F.coalesce(F.col("request_id").cast("string"), F.lit("")))
    out = df.select(
        F.sha2(own, 256).alias("event_id"),
        F.col("request_id").cast("string").alias("request_id"),
        "tenant_id",
        timestamp.cast("timestamp").alias("timestamp"),
        "verdict",
        F.size("findings").alias("findings_count"),
        response_confidence(F.lit("allow"), F.col("findings")).alias("confidence"),
        F.transform("findings", lambda f: f["category"]).alias("threat_categories"),
        details.alias("scanner_details"),
        (tokenize_metadata(metadata) if cfg.tokenize_pii else metadata).alias("metadata"),
    )
    out = out.withColumn("total_latency_ms", F.aggregate("scanner_details", F.lit(0.0), lambda a, d: a + F.coalesce(d["latency_ms"], F.lit(0.0))))
    return out.withColumn("event_date", F.to_date("timestamp"))


def _detail(df: DataFrame, layer: str, verdict: Column, findings: Column) -> Column:
    """One layer's entry.  Its time is what its own calls and searches took,
    null where its work is part of a plan; its error is what it failed with."""
    own = lambda name, kind: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return F.struct(F.lit(layer).alias("layer"), verdict.alias("verdict"), F.size(findings).alias("findings"), F.round(own(f"{layer}_ms", "double"), 2).alias("latency_ms"), own(f"{layer}_error", "string").alias("error"))


def audit_evaluations(screened: DataFrame, cfg: EngineConfig, timestamp: Column, batch: str = "") -> DataFrame:
    """One row per screened request; categories as often as they were found.
    ``event_id`` is made of batch, place and time: no two rows share one, and a
    batch that is planned again as before gives each row the one it had."""
    details = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), _detail(screened, n, F.col(n)["verdict"], F.col(n)["findings"])) for n in LAYERS if n in screened.columns)))
    return _rows(screened, "evaluation", F.coalesce("metadata", F.create_map().cast("map<string,string>")), details, cfg, timestamp, batch)


def audit_outputs(scanned: DataFrame, cfg: EngineConfig, timestamp: Column, batch: str = "") -> DataFrame:
    """One row per scanned output."""
    detail = F.array(_detail(scanned, "pattern", F.col("verdict"), F.col("findings")))
    return _rows(scanned, "output", F.create_map(F.lit("canary_leaked"), F.lit("false")), detail, cfg, timestamp, batch)
