"""Hybrid score and arbitration: many layers, one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import LAYERS, EngineConfig
from guardspark.schemas import PRIORITY, finding, lookup, priority


def max_confidence(layer: Column) -> Column:
    """Of a layer's findings; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(layer["findings"], lambda f: f["confidence"])), F.lit(0.0))


def composite(p: Column, s: Column, blocked: Column, cfg: EngineConfig) -> Column:
    """The pattern's confidence if it blocked, else the weighted sum of both,
    else whichever there is."""
    both = cfg.pattern_weight * p + cfg.semantic_weight * s
    return F.when(blocked, p).when((p > 0) & (s > 0), both).when(p > 0, p).when(s > 0, s).otherwise(F.lit(0.0))


def composite_verdict(c: Column, cfg: EngineConfig) -> Column:
    return F.when(c >= cfg.score_block, "block").when(c >= cfg.score_sanitize, "sanitize").when(c >= cfg.score_escalate, "escalate").otherwise("allow")


def composite_severity(c: Column) -> Column:
    return F.when(c >= 0.85, "critical").when(c >= 0.60, "high").when(c >= 0.30, "medium").otherwise("low")


def contributions(p: Column, s: Column, blocked: Column, cfg: EngineConfig) -> tuple[Column, Column]:
    """What each layer gives to the composite."""
    both = (p > 0) & (s > 0)
    return (
        F.when(blocked, p).when(both, cfg.pattern_weight * p).when(p > 0, p).otherwise(F.lit(0.0)),
        F.when(blocked, F.lit(0.0)).when(both, cfg.semantic_weight * s).when((p <= 0) & (s > 0), s).otherwise(F.lit(0.0)),
    )


def hybrid_reason(p: Column, s: Column, blocked: Column, c: Column, verdict: Column, cfg: EngineConfig) -> Column:
    from_p, from_s = contributions(p, s, blocked, cfg)
    of_p = F.when(p > 0, F.format_string(f"pattern=%.2f (w={cfg.pattern_weight:.1f} → %.3f)", p, from_p)).otherwise("pattern=0.00 (no findings)")
    of_s = F.when(s > 0, F.format_string(f"semantic=%.2f (w={cfg.semantic_weight:.1f} → %.3f)", s, from_s)).otherwise("semantic=0.00 (no matches)")
    parts = F.when(blocked, F.format_string("Pattern BLOCK (confidence=%.2f)", p)).otherwise(F.concat_ws(" | ", of_p, of_s))
    return F.concat_ws(" | ", parts, F.format_string("composite=%.3f→%s", c, verdict))


def with_hybrid(df: DataFrame, scored: Column, cfg: EngineConfig) -> DataFrame:
    """Adds ``hybrid`` - composite, verdict, both maxima and contributions,
    reason - where ``scored``.  Step by step in plain columns, so that no
    expression is written out more than once."""
    df = df.withColumns({"_on": scored, "_p": max_confidence(F.col("pattern")), "_s": max_confidence(F.col("semantic")), "_b": F.coalesce(F.col("pattern")["verdict"] == "block", F.lit(False))})
    p, s, blocked, c = F.col("_p"), F.col("_s"), F.col("_b"), F.col("_c")
    df = df.withColumn("_c", composite(p, s, blocked, cfg))
    df = df.withColumn("_v", composite_verdict(c, cfg))
    df = df.withColumn("_r", hybrid_reason(p, s, blocked, c, F.col("_v"), cfg))
    from_p, from_s = contributions(p, s, blocked, cfg)
    whole = F.struct(c.alias("composite"), F.col("_v").alias("verdict"), from_p.alias("pattern_contribution"), from_s.alias("semantic_contribution"), p.alias("pattern_max"), s.alias("semantic_max"), F.col("_r").alias("reason"))
    return df.withColumn("hybrid", F.when(F.col("_on"), whole)).drop("_on", "_p", "_s", "_b", "_c", "_v", "_r")


def hybrid_finding(h: Column) -> Column:
    return finding("semantic", "HYBRID-001", "T-NG", composite_severity(h["composite"]), h["verdict"], h["composite"], h["reason"], None, "Composite of pattern and semantic evidence")


def arbitrate(layers: dict[str, Column], hybrid_: Column, cfg: EngineConfig) -> tuple[Column, Column, Column]:
    """Final verdict, winning layer and reason.  ``layers`` are structs, null
    where a layer did not run.  The strictest verdict wins, the first layer of
    equals; the hybrid score replaces it only if it is stricter."""
    ran = {n: c.isNotNull() for n, c in layers.items()}
    score = {n: F.when(ran[n], priority(c["verdict"])).otherwise(-1) for n, c in layers.items()}
    top = F.greatest(*score.values()) if len(score) > 1 else next(iter(score.values()))
    winner = F.lit("none")
    for n in reversed([x for x in LAYERS if x in layers]):
        winner = F.when((score[n] == top) & (top >= 0), n).otherwise(winner)
    by_hybrid = hybrid_.isNotNull() & (priority(hybrid_["verdict"]) > top) & (top >= 0)
    verdict = F.when(by_hybrid, hybrid_["verdict"]).otherwise(lookup(top, {p: v for v, p in PRIORITY.items()}, "allow"))
    winner = F.when(by_hybrid, "hybrid").otherwise(winner)
    seen = F.array_join(F.array_compact(F.array(*(F.when(ran[n], F.concat(F.lit(f"{n}="), c["verdict"])) for n, c in layers.items()))), ", ")
    more = F.when(hybrid_.isNotNull(), F.format_string(" | Hybrid: composite=%.3f->%s", hybrid_["composite"], hybrid_["verdict"])).otherwise("")
    reason = F.concat(F.lit("Strictest verdict: "), verdict, F.lit(" from "), winner, F.lit(" layer. All: ["), seen, F.lit("]"), more)
    nothing = top < 0
    default = nothing_ran(cfg)
    return F.when(nothing, default[0]).otherwise(verdict), winner, F.when(nothing, default[1]).otherwise(reason)


# The reasons where no layer ran.
FAIL_CLOSED = "No scanners executed; fail-closed default"
FAIL_OPEN = "No scanners executed; fail-open default"


def nothing_ran(cfg: EngineConfig) -> tuple[str, str]:
    """Verdict and reason where no layer ran."""
    return ("block", FAIL_CLOSED) if cfg.fail_closed else ("allow", FAIL_OPEN)
