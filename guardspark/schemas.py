"""Schemas as DDL, and the order of verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "struct<role: string, content: string, name: string, tool_call_id: string>"
REQUESTS = f"request_id string, messages array<{MESSAGE}>, prompt string, tenant_id string, use_case string, scanners array<string>, output_only boolean, metadata map<string, string>"
OUTPUTS = "output string, tenant_id string, session_id string, system_prompt_hash string"
FINDING = "struct<layer: string, rule_id: string, category: string, severity: string, verdict: string, confidence: double, description: string, evidence: string, mitigation: string>"
FINDINGS = f"array<{FINDING}>"
CORPUS = "index int, text string, category string, severity string, source string, embedding array<float>"
AUDIT = "event_id string, request_id string, tenant_id string, timestamp timestamp, verdict string, findings_count int, confidence double, threat_categories array<string>, scanner_details array<struct<layer: string, verdict: string, findings: int, latency_ms: double, error: string>>, metadata map<string, string>, total_latency_ms double, event_date date"
JUDGE_REPLY = "struct<is_malicious: boolean, verdict: string, confidence: double, reasoning: string>"

ROLES = ("system", "user", "assistant", "tool")
USE_CASES = ("chat", "agent", "rag", "tool", "completion")
#: Strictest wins.
PRIORITY = {"block": 6, "sanitize": 5, "escalate": 4, "quarantine": 3, "rate_limit": 2, "allow": 0}
SEVERITY_VERDICT = {"critical": "block", "high": "block", "medium": "sanitize", "low": "sanitize", "info": "allow"}


def lookup(c: Column, table: dict, default) -> Column:
    """A value of a small table, as a chain of cases."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def priority(verdict: Column) -> Column:
    return lookup(verdict, PRIORITY, 0)


def strictest(verdicts: Column) -> Column:
    """The strictest of an array of verdicts; allow if there is none."""
    top = F.coalesce(F.array_max(F.transform(verdicts, priority)), F.lit(0))
    return lookup(top, {p: v for v, p in PRIORITY.items()}, "allow")


def finding(layer, rule_id, category, severity, verdict, confidence, description, evidence=None, mitigation=None) -> Column:
    """A finding; plain values become literals."""
    values = {"layer": layer, "rule_id": rule_id, "category": category, "severity": severity, "verdict": verdict, "confidence": confidence, "description": description, "evidence": evidence, "mitigation": mitigation}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("double" if k == "confidence" else "string").alias(k) for k, v in values.items()))


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def once(c: Column) -> Column:
    """A column that is worked out where it stands: the optimizer does not copy
    what is not deterministic into filters and later columns, of which each
    would otherwise repeat all of a layer."""
    return F.when(F.rand() >= 0, c)
