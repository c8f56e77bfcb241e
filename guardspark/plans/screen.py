"""The screening plans: requests in, verdicts and responses out.

One projection does the structural and the pattern layer, hybrid scoring and
arbitration; the semantic layer adds one search and one join, the judge one
pass over the few rows that stay open.  Each stage works on columns of the one
before, so the same functions serve batches and streams.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import LAYERS, EngineConfig
from guardspark.functions.rules import RULES, Rule
from guardspark.functions.text import action_text, raw_text, texts_to_scan
from guardspark.operators.actions import response, response_confidence
from guardspark.operators.hybrid import arbitrate, hybrid_finding, with_hybrid
from guardspark.operators.index import VectorIndex
from guardspark.operators.judge import JudgeClient, SharedBreaker, ask, ask_all, gate, judge_layer
from guardspark.operators.pattern import PII_RULES, layer_of, pattern, redact, rule_findings, with_layer
from guardspark.operators.semantic import closed_errors, corpus_width, not_started, row_key, semantic
from guardspark.operators.structural import structural
from guardspark.plans.registry import Registry, Scanner, scanned
from guardspark.schemas import no_findings, once


def _wanted(layer: str, cfg: EngineConfig) -> Column:
    """Whether a request runs a layer: by its own list, else by default."""
    own = F.array_contains("scanners", layer)
    return F.when(F.col("scanners").isNotNull(), F.coalesce(own, F.lit(False))).otherwise(layer in cfg.layers)


def _stopped(layers: list[str], cfg: EngineConfig) -> Column:
    """Whether a layer before has blocked, which ends a fail-closed run."""
    out = F.lit(False)
    for n in layers:
        out = out | F.coalesce(F.col(n)["verdict"] == "block", F.lit(False))
    return out & cfg.fail_closed


def _replaced(df: DataFrame, layer: str, scan: Scanner, wanted: Column, *more: Column) -> DataFrame:
    """A layer by a scanner of the user's: its struct, and its error."""
    df = df.withColumn("_on", wanted).withColumn("_text", F.when(F.col("_on"), F.coalesce("raw_text", F.lit(""))))
    df = df.withColumn("_own", scanned(F.col("_text"), layer, scan))
    df = df.withColumns({"_verdict": F.col("_own")["verdict"], "_found": F.col("_own")["findings"], f"{layer}_error": F.when(F.col("_on"), F.col("_own")["error"])})
    made = F.struct(F.col("_verdict").alias("verdict"), F.col("_found").alias("findings"), *more)
    return df.withColumn(layer, F.when(F.col("_on"), made)).drop("_on", "_text", "_own", "_verdict", "_found")


def screen(requests: DataFrame, cfg: EngineConfig, corpus: DataFrame | None = None, client: JudgeClient | None = None, held: list[DataFrame] | None = None, index: VectorIndex | None = None, breaker: SharedBreaker | None = None, registry: Registry | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Requests with ``verdict``, ``layer``, ``reason``, ``findings``,
    ``confidence``, ``layers_used`` and ``response``, and one struct for each
    layer, null where it did not run.  With a corpus requests need an
    ``embedding``; the layers before the search are then persisted (spilling to
    disk), so this form is for batches; ``held`` collects what is persisted, for
    the caller to let go.  A request that wants the semantic layer is blocked if
    there is no corpus, if the corpus is empty or broken, or if its text has no
    embedding, one of another width than the corpus, or one with a number that
    is missing or not finite.  ``index`` is searched instead of the corpus;
    ``breaker`` is the judge's circuit breaker where it outlives the batch.
    Scanners in ``registry`` take the place of the built-in layers they are
    registered for; any layer that fails at a row blocks it.
    Requests may share an id or have none."""
    held = held if held is not None else []
    df = requests.withColumns({"texts": texts_to_scan(F.col("messages"), F.col("prompt")), "raw_text": raw_text(F.col("messages"), F.col("prompt"))})
    own = registry.scanners if registry is not None else {}
    df = structural(df, cfg)
    if "structural" in own:
        df = _replaced(df, "structural", own["structural"], _wanted("structural", cfg), F.lit("").alias("sanitized"))
    df = df.withColumn("structural", once(F.when(_wanted("structural", cfg), F.col("structural"))))
    sanitized = F.coalesce(F.col("structural")["sanitized"], F.lit(""))
    df = df.withColumn("scan_texts", F.when(sanitized != "", F.array(sanitized)).otherwise(F.col("texts")))
    run_pattern = _wanted("pattern", cfg) & ~_stopped(["structural"], cfg)
    # Rows without a pattern layer have nothing to scan.
    df = df.withColumn("run_pattern", run_pattern).withColumn("scan_texts", F.when(F.col("run_pattern"), F.col("scan_texts")).otherwise(F.array().cast("array<string>")))
    if "pattern" in own:
        df = _replaced(df, "pattern", own["pattern"], F.col("run_pattern"))
    else:
        df = pattern(df, cfg, rules)
        kept = F.when(F.col("output_only"), F.filter(F.col("pattern")["findings"], lambda f: f["category"] == "T-EXF")).otherwise(F.col("pattern")["findings"])
        df = with_layer(df.withColumn("_kept", kept), "pattern", "_kept", "pattern_error").drop("_kept")
    df = df.withColumn("pattern", F.when(F.col("run_pattern"), F.col("pattern"))).drop("run_pattern")
    layers, hybrid_ = ["structural", "pattern"], F.lit(None).cast("struct<composite: double, verdict: string, pattern_contribution: double, semantic_contribution: double, pattern_max: double, semantic_max: double, reason: string>")
    if "semantic" in own:
        df = _replaced(df, "semantic", own["semantic"], _wanted("semantic", cfg) & ~_stopped(layers, cfg))
        layers.append("semantic")
    elif corpus is not None:
        # The search and the rows it joins both start here: the layers so far are computed once.
        df = df.withColumn("_row", row_key("request_id", "raw_text", "embedding")).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(df)
        width = corpus_width(corpus)
        df = df.withColumn("_judged", F.col("_row")).withColumn("ran_semantic", _wanted("semantic", cfg) & ~_stopped(layers, cfg))
        # A text that can't be searched for blocks, unless it is blocked or empty.
        wants = F.col("ran_semantic") & (F.col("raw_text") != "") & ~F.coalesce(F.col("pattern")["verdict"] == "block", F.lit(False))
        df = df.withColumn("_broken", F.when(wants, closed_errors(F.col("embedding"), width)))
        df = df.withColumn("run_semantic", F.col("ran_semantic") & F.col("embedding").isNotNull() & F.col("_broken").isNull() & ~F.coalesce(F.col("pattern")["verdict"] == "block", F.lit(False)))
        df = semantic(df, corpus, cfg, index=index)
        df = df.withColumn("semantic", F.when(F.col("ran_semantic"), F.coalesce("_broken", "semantic"))).drop("run_semantic", "ran_semantic", "_broken")
        layers.append("semantic")
        any_ = F.lit(0)
        for n in layers:
            any_ = any_ + F.coalesce(F.size(F.col(n)["findings"]), F.lit(0))
        scored = F.col("pattern").isNotNull() & F.col("semantic").isNotNull() & (any_ > 0) & ~_stopped(["semantic"], cfg)
        df = with_hybrid(df, scored, cfg)
        hybrid_ = F.col("hybrid")
    else:
        # Without a corpus the layer cannot start: requests that want it are blocked.
        wants = _wanted("semantic", cfg) & ~_stopped(layers, cfg) & ~F.coalesce(F.col("pattern")["verdict"] == "block", F.lit(False)) & (F.col("raw_text") != "")
        df = df.withColumn("semantic", F.when(wants, not_started()))
        layers.append("semantic")
    skipped = F.struct(F.lit("allow").alias("verdict"), no_findings().alias("findings"))
    if "judge" in own:
        df = _replaced(df, "judge", own["judge"], _wanted("judge", cfg) & ~_stopped(layers, cfg))
        layers.append("judge")
    elif client is not None and (corpus is None or "semantic" in own):
        df = df.withColumn("judge", F.when(_wanted("judge", cfg) & ~_stopped(layers, cfg), skipped))  # its gate needs the semantic layer
        layers.append("judge")
    elif client is not None:
        df = df.persist(StorageLevel.MEMORY_AND_DISK).withColumn("ask_judge", _wanted("judge", cfg) & ~_stopped(layers, cfg))
        held.append(df)
        asked = df.where(F.col("ask_judge") & gate(F.col("semantic"), None, cfg)).dropDuplicates(["_judged"])
        answers = ask(asked, client, cfg, "_judged") if breaker is None else ask_all(asked, client, cfg, breaker, held, "_judged")
        df = df.join(answers.select("_judged", "content", "error", F.col("ms").alias("judge_ms")), "_judged", "left")
        df = df.withColumn("judge", F.when(F.col("ask_judge"), F.when(F.col("content").isNotNull() | F.col("error").isNotNull(), judge_layer(F.col("content"), F.col("error"))).otherwise(skipped))).withColumn("judge_error", F.nullif("error", F.lit("skipped"))).drop("content", "error", "ask_judge")
        layers.append("judge")
    verdict, winner, reason = arbitrate({n: F.col(n) for n in layers}, hybrid_, cfg)
    found = F.concat(*(F.coalesce(F.col(n)["findings"], no_findings()) for n in layers))
    if corpus is not None and "semantic" not in own:
        found = F.concat(found, F.when(F.coalesce(hybrid_["composite"] > 0, F.lit(False)), F.array(hybrid_finding(hybrid_))).otherwise(no_findings()))
    df = df.withColumns({"verdict": once(verdict), "layer": once(winner), "reason": once(reason), "findings": once(found), "layers_used": F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), n) for n in LAYERS if n in layers)))})
    df = df.withColumn("confidence", response_confidence(F.lit("allow"), F.col("findings")))
    text = action_text(F.lit(""), F.col("prompt"), F.col("messages"))
    return df.withColumn("response", response(F.col("verdict"), F.col("findings"), F.col("tenant_id"), F.col("structural")["sanitized"], text)).drop("texts", "scan_texts", "_judged")


def scan_outputs(outputs: DataFrame, cfg: EngineConfig, text_col: str = "output") -> DataFrame:
    """Model outputs with ``findings``, ``verdict``, ``reason``, ``confidence``,
    ``redacted_output`` and ``canary_leaked``: personal data and secrets only,
    on the text as it is."""
    df = outputs.withColumn("findings", rule_findings(text_col, PII_RULES, limit=cfg.regex_timeout))
    df = df.withColumn("verdict", layer_of(F.col("findings"))["verdict"])
    df = df.withColumn("_clean", redact(F.when(F.col("verdict") == "sanitize", F.col(text_col))))
    reason = F.format_string("Strictest verdict: %s from pattern layer. All: [pattern=%s]", F.col("verdict"), F.col("verdict"))
    return df.withColumns({"confidence": response_confidence(F.col("verdict"), F.col("findings")), "reason": reason, "redacted_output": F.coalesce("_clean", text_col), "canary_leaked": F.lit(False)}).drop("_clean")
