"""Structured Streaming forms of the plans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from guardspark.config import EngineConfig
from guardspark.operators.audit import audit_evaluations
from guardspark.operators.index import VectorIndex
from guardspark.operators.judge import JudgeClient, SharedBreaker
from guardspark.operators.ratelimit import decide
from guardspark.operators.validate import validate
from guardspark.plans.screen import screen


def screen_stream(requests: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The structural and the pattern layer on a stream: stateless, so the
    batch plan as it is.  Rejected rows are left out; ``start_screening`` hands
    them on and runs the other layers too."""
    return screen(validate(requests)[0], cfg)


def start_screening(
    requests: DataFrame,
    cfg: EngineConfig,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    corpus: DataFrame | None = None,
    client: JudgeClient | None = None,
    rejected: Callable[[DataFrame, int], None] | None = None,
    breaker: SharedBreaker | None = None,
    index: VectorIndex | None = None,
) -> StreamingQuery:
    """Screen all that is there, micro-batch by micro-batch, through all layers
    that a batch goes through, and hand audit rows to ``sink`` (unless
    ``audit_enabled`` is off) and refused requests to ``rejected``.  The judge's
    ``breaker`` carries over from batch to batch."""
    breaker = breaker or SharedBreaker()

    def one(batch: DataFrame, batch_id: int) -> None:
        held: list[DataFrame] = []
        good, bad = validate(batch)
        if cfg.audit_enabled:
            screened = screen(good, cfg, corpus, client, held, index, breaker)
            sink(audit_evaluations(screened, cfg, F.current_timestamp(), f"{batch_id}"), batch_id)
            breaker.settle()
        if rejected is not None:
            rejected(bad, batch_id)
        for df in held:
            df.unpersist()

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Limiter(StatefulProcessor):
    """At most ``limit`` accepted times for each key.  A timer of event time
    drops them once the watermark is a window behind the last one."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "ts double")

    def handleInputRows(self, key, rows, timerValues):
        kept = [x[0] for x in self.kept.get()] if self.kept.exists() else []
        out = []
        for ts, event in sorted((float(t), e) for pdf in rows for t, e in zip(pdf["ts"], pdf["event_id"], strict=True)):
            out.append((event, key[0], *decide(kept, ts, self.limit, self.window)))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if kept:
            self.kept.put([(t,) for t in kept])
            self.handle.registerTimer(int((max(kept) + self.window) * 1000) + 1)
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=["event_id", "tenant_key", "allowed", "remaining", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, cfg: EngineConfig, late: int | None = None) -> DataFrame:
    """Rate limits on a stream of ``tenant_key``, ``ts`` (seconds, not null) and
    ``event_id``; rows of a micro-batch are taken in order of time.  Rows that
    come more than ``late`` seconds (a window, if none are given) behind the
    newest one get no decision: the engine drops and counts them.  Needs the
    RocksDB state store."""
    late = cfg.window_seconds if late is None else late
    timed = events.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", f"{late} seconds")
    return timed.groupBy("tenant_key").transformWithStateInPandas(_Limiter(cfg.requests_per_minute, cfg.window_seconds), "event_id long, tenant_key string, allowed boolean, remaining int, retry_after int", "append", "eventTime")


def tumbling(audit: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Verdicts by window and tenant, once no late row can change them."""
    w = audit.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "tenant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("n_blocked"))
    return w.select(F.col("window.start").alias("start"), "tenant_id", "n", "n_blocked")


def sliding_block_rate(audit: DataFrame, late: str = "10 minutes", width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    w = audit.withWatermark("timestamp", late).groupBy(F.window("timestamp", width, step)).agg(F.avg((F.col("verdict") == "block").cast("double")).alias("block_rate"))
    return w.select(F.col("window.start").alias("start"), "block_rate")


def sessions(audit: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Runs of a tenant's requests with gaps below ``gap``."""
    w = audit.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "tenant_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "tenant_id", "n")
