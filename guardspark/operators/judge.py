"""Judge layer: a model's opinion on the few requests that stay open.

The model is behind ``JudgeClient``; it is asked for gated rows only, in tasks.
Parsing of its replies and the circuit breaker are plain expressions and folds.
"""

from __future__ import annotations

import copy
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.operators.folds import fold_in_order
from guardspark.schemas import JUDGE_REPLY, finding, no_findings

FAILURES_TO_OPEN, OPEN_SECONDS = 3, 60


class Breaker:
    """Opens after ``failures`` failed calls in a row, is half open ``wait``
    seconds after the last of them; a success then closes it."""

    def __init__(self, failures: int = FAILURES_TO_OPEN, wait: float = OPEN_SECONDS):
        self.failures, self.wait, self.failed, self.open_at = failures, wait, 0, None

    def state(self, now: float) -> str:
        if self.open_at is None:
            return "closed"
        return "half_open" if now - self.open_at >= self.wait else "open"

    def record(self, now: float, ok: bool) -> None:
        """The outcome of a call that was let through."""
        self.failed = 0 if ok else self.failed + 1
        if ok:
            self.open_at = None
        elif self.failed >= self.failures:
            self.open_at = now


class JudgeClient(Protocol):
    """Answers a text with JSON: is_malicious, verdict, confidence, reasoning.
    May raise ``TimeoutError`` or any other exception."""

    def ask(self, text: str) -> str: ...


def gate(semantic: Column, hybrid: Column | None, cfg: EngineConfig) -> Column:
    """Whether the judge is asked: a composite in the middle, or an escalated
    semantic verdict."""
    open_ = F.coalesce(semantic["verdict"] == "escalate", F.lit(False))
    if hybrid is not None:
        open_ = open_ | F.coalesce(hybrid["composite"].between(cfg.judge_low, cfg.judge_high), F.lit(False))
    return open_


def extract_json(content: Column) -> Column:
    """The JSON object in a reply: all of it, a fenced block, or from the first
    brace to the last; null if none parses."""
    whole = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), c)
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole(content), whole(fenced), whole(braces))


def parse_reply(content: Column) -> Column:
    """is_malicious, verdict, confidence and reasoning of a reply, or null.
    Unknown verdicts allow; a malicious text is never just allowed."""
    found = extract_json(content)
    r = F.from_json(found, JUDGE_REPLY)
    bad = F.coalesce(r["is_malicious"], F.lit(False))
    verdict = F.lower(F.trim(r["verdict"]))
    known = F.when(verdict.isin("allow", "block", "sanitize", "escalate", "quarantine"), verdict).otherwise("allow")
    confidence = F.least(F.greatest(F.coalesce(r["confidence"], F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return F.when(found.isNotNull(), F.struct(bad.alias("is_malicious"), F.when(bad & (known == "allow"), "sanitize").otherwise(known).alias("verdict"), confidence.alias("confidence"), F.coalesce(r["reasoning"], F.lit("")).alias("reasoning")))


def judge_severity(verdict: Column) -> Column:
    return F.when(verdict == "block", "high").when(verdict == "sanitize", "medium").otherwise("low")


def holds_json(reply: str | None) -> bool:
    """Whether there is an object in a reply, for the breaker's count."""
    start, end = (reply or "").find("{"), (reply or "").rfind("}")
    try:
        return isinstance(json.loads(reply[start : end + 1]), dict) if 0 <= start < end else False
    except ValueError:
        return False


def judge_layer(content: Column, error: Column) -> Column:
    """The layer's struct from a reply or an error.  Failures allow: the
    verdict from before the judge stands; so does a row that an open breaker
    skipped, without a finding."""
    r = parse_reply(content)
    failed = lambda rule, said: F.struct(F.lit("allow").alias("verdict"), F.array(finding("judge", rule, "T-NG", "low", "allow", 0.0, said)).alias("findings"))
    found = F.when(r["is_malicious"], F.array(finding("judge", "JUDGE-001", "T-PI-D", judge_severity(r["verdict"]), r["verdict"], r["confidence"], r["reasoning"], None, "Judged malicious"))).otherwise(no_findings())
    skipped = F.struct(F.lit("allow").alias("verdict"), no_findings().alias("findings"))
    return F.when(error == "skipped", skipped).when(error == "timeout", failed("JUDGE-TIMEOUT", "The judge did not answer in time")).when(error.isNotNull(), failed("JUDGE-ERR", error)).when(r.isNull(), failed("JUDGE-PARSE", "The judge's answer is no JSON")).otherwise(F.struct(r["verdict"].alias("verdict"), found.alias("findings")))


class SharedBreaker:
    """The breaker of a stream, on the driver: what it learnt from one
    micro-batch holds in the next.  Tasks start from its state; ``settle``
    learns from the answers of a batch, of which only three numbers come back.
    ``clock`` tells the driver's time in seconds."""

    def __init__(self, failures: int = FAILURES_TO_OPEN, wait: float = OPEN_SECONDS, clock: Callable[[], float] = time.time):
        self.breaker, self.clock, self.answers = Breaker(failures, wait), clock, []

    def state(self) -> str:
        return self.breaker.state(self.clock())

    def settle(self) -> None:
        """Learn from the answers that the batch's plan has persisted."""
        for answers in self.answers:
            ok, at = F.col("ok"), F.col("at")
            last = answers.where(ok).agg(F.max("at")).first()[0]
            later = answers.where(~ok & ((at > last) if last is not None else F.lit(True)))
            failed, when = later.agg(F.count(F.lit(1)), F.max("at")).first()
            b = self.breaker
            if last is not None:
                b.record(last, True)
            b.failed += failed
            if failed and b.failed >= b.failures:
                b.open_at = when
        self.answers = []


def _called(client: JudgeClient, text: str, seconds: float) -> Callable[[], tuple[str | None, str | None]]:
    """Starts a call; the function waits for it until its time is over.  A
    thread whose call hangs is left behind and ends with its worker."""
    done: queue.Queue = queue.Queue(1)

    def work() -> None:
        try:
            done.put((client.ask(text), None))
        except TimeoutError:
            done.put((None, "timeout"))
        except Exception as e:  # a failed call never loses the row
            done.put((None, f"{type(e).__name__}: {e}"))

    until = time.monotonic() + seconds
    threading.Thread(target=work, daemon=True).start()

    def wait() -> tuple[str | None, str | None]:
        try:
            return done.get(timeout=max(0.0, until - time.monotonic()))
        except queue.Empty:
            return None, "timeout"

    return wait


ANSWERS = "content string, error string, ok boolean, at double, ms double"


def ask(gated: DataFrame, client: JudgeClient, cfg: EngineConfig, id_col: str = "request_id", text_col: str = "raw_text", shared: SharedBreaker | None = None) -> DataFrame:
    """``id_col``, ``content`` and ``error`` for every row, with ``ok``, the
    time ``at`` its call ended and the ``ms`` it took (null for rows that were
    not asked).  A task makes ``judge_calls`` calls at once, each of which is
    broken off after ``judge_timeout`` seconds.  A reply that does not parse
    counts as a failed call, as timeouts and errors do; after three in a row
    the task's circuit breaker, which starts as ``shared`` stands, opens: rows
    are not asked and get the error ``skipped``."""
    kind, limit = gated.schema[id_col].dataType.simpleString(), cfg.judge_chars
    start = shared.breaker if shared is not None else Breaker()
    wait, at_once = cfg.judge_timeout, cfg.judge_calls
    ahead = shared.clock() - time.time() if shared is not None else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker, now = copy.copy(start), lambda: time.time() + ahead

        def some(texts: list[str]) -> list[tuple]:
            if breaker.state(now()) == "open":
                return [(None, "skipped", None, None, None)] * len(texts)
            began = time.monotonic()
            out = []
            for call in [_called(client, t[:limit], wait) for t in texts]:
                said, error = call()
                ok, at = error is None and holds_json(said), now()
                breaker.record(at, ok)
                out.append((said, error, ok, at, 1000 * (time.monotonic() - began)))
            return out

        for b in batches:
            texts, i, rows = [t or "" for t in b.column(1).to_pylist()], 0, []
            while i < len(texts):
                n = 1 if breaker.state(now()) == "half_open" else at_once
                rows += some(texts[i : i + n])
                i += n
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "content", "error", "ok", "at", "ms"])

    return gated.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {ANSWERS}")


def ask_all(gated: DataFrame, client: JudgeClient, cfg: EngineConfig, shared: SharedBreaker, held: list[DataFrame], id_col: str, text_col: str = "raw_text") -> DataFrame:
    """``ask`` under a breaker that outlives the batch: while it is half open
    one row is asked first, by itself, and tells whether the others are.  The
    answers are persisted; ``held`` collects them."""
    probe = None
    if shared.state() == "half_open":
        first = gated.orderBy(id_col).limit(1).select(id_col, text_col)
        probe = first.sparkSession.createDataFrame(ask(first, client, cfg, id_col, text_col, shared).collect(), f"{id_col} {gated.schema[id_col].dataType.simpleString()}, {ANSWERS}")
        for r in probe.collect():
            shared.breaker.record(r.at, r.ok)
        gated = gated.join(probe.select(id_col), id_col, "left_anti")
    answers = ask(gated, client, cfg, id_col, text_col, shared).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(answers)
    shared.answers.append(answers)
    return answers if probe is None else answers.unionByName(probe)


def breaker_replay(outcomes: DataFrame, key: str, ts_col: str, ok_col: str, failures: int = FAILURES_TO_OPEN, wait: int = OPEN_SECONDS) -> DataFrame:
    """What the circuit breaker of each key does with calls in order of time:
    ``seq``, ``ts``, ``state`` before each call, and whether it is let through.
    Calls of one time are taken failures first; a null time counts as 0."""

    def step(held: list, row: tuple) -> tuple:
        seq = held[1]
        held[1] += 1
        state = held[0].state(row[0])
        if state != "open":
            held[0].record(row[0], row[1])
        return seq, row[0], state, state != "open"

    kind = outcomes.schema[key].dataType.simpleString()
    calls = outcomes.select(key, F.coalesce(F.col(ts_col).cast("double"), F.lit(0.0)).alias("ts"), F.coalesce(ok_col, F.lit(False)).alias("ok"))
    return fold_in_order(calls, key, ["ts", "ok"], lambda: [Breaker(failures, wait), 0], step, f"{key} {kind}, seq int, ts double, state string, allowed boolean")
