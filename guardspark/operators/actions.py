"""Actions: from a verdict to a response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.operators.pattern import redact
from guardspark.schemas import lookup

STATUS = {"allow": 200, "block": 403, "sanitize": 200, "escalate": 202, "quarantine": 202, "rate_limit": 429}
ERROR = {"block": "request_blocked", "rate_limit": "rate_limited"}
MESSAGE = {
    "block": "Not let through",
    "escalate": "Handed to a person to decide",
    "quarantine": "Held back until someone has looked at it; its tenant is marked",
    "rate_limit": "Too many requests that look suspicious",
}
RETRY_AFTER = 60


def status(verdict: Column) -> Column:
    return lookup(verdict, STATUS, 200)


def response_confidence(verdict: Column, findings: Column) -> Column:
    """The highest confidence; without findings 1 for a block, else 0."""
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f["confidence"])), F.when(verdict == "block", 1.0).otherwise(0.0))


def sanitized_content(structural_text: Column, text: Column) -> Column:
    """The structural layer's text where it left any (unredacted), else the
    text with its personal data redacted."""
    left = F.when(structural_text != "", structural_text)
    return F.coalesce(left, redact(F.when(left.isNull(), text)))


def response(verdict: Column, findings: Column, tenant: Column, structural_text: Column, text: Column, webhook_sent: Column | None = None) -> Column:
    """status, error, message, confidence, sanitized_content, headers."""
    none = F.lit(None).cast("string")
    headers = F.map_concat(
        F.create_map(F.lit("X-Verdict"), verdict),
        F.when(verdict == "quarantine", F.create_map(F.lit("X-Tenant-Flagged"), tenant)).when(verdict == "rate_limit", F.create_map(F.lit("Retry-After"), F.lit(str(RETRY_AFTER)))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return F.struct(
        status(verdict).alias("status"),
        lookup(verdict, ERROR, None).cast("string").alias("error"),
        lookup(verdict, MESSAGE, None).cast("string").alias("message"),
        response_confidence(verdict, findings).alias("confidence"),
        F.when(verdict == "sanitize", sanitized_content(structural_text, F.when(verdict == "sanitize", text))).otherwise(none).alias("sanitized_content"),
        F.when(verdict == "rate_limit", F.lit(RETRY_AFTER)).alias("retry_after"),
        F.when(verdict == "escalate", webhook_sent if webhook_sent is not None else F.lit(False)).alias("webhook_sent"),
        headers.alias("headers"),
    )
