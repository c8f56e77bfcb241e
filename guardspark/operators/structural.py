"""Structural layer: size, invisible characters, encodings, role injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.functions.gates import gated
from guardspark.functions.normalize import inflated_ratios, nfkd
from guardspark.functions.text import FLAGS, strip_zero_width
from guardspark.schemas import FINDINGS, finding, strictest

# Patterns and words of the checks.
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
#: In front of it: one range that holds all of base64, at which most places
#: fail, and the beginning of a run, where every match begins.
BASE64_AHEAD = r"(?=[+-z]{40})(?<![A-Za-z0-9+/])"
HEX = r"(?:\\x[0-9a-fA-F]{2}){4,}"
ROT13 = r"\b(?:vang|cynvagrkg|chfurf|frrzn|qrpelcgvat|npphss|pbzcyrgr|pbafvqre)\b"
RUN = r"(.)\1{20,}"
ROLE = r"\b(?:system|assistant|user|tool)\s*:\s*(?:ignore|forget|override|disregard)"
PAYLOAD_WORDS = ("ignore", "system", "instruction", "prompt", "override")


def _payload(run: Column) -> Column:
    """The text in a base64 run, lower-cased; null where padding is wrong."""
    data = F.regexp_replace(run, "=+$", "")
    d, p = F.char_length(data), F.char_length(run) - F.char_length(data)
    sound = (d % 4 == 0) | ((d % 4 == 2) & (p == 2)) | ((d % 4 == 3) & (p >= 1))
    text = F.make_valid_utf8(F.when(sound, F.try_to_binary(data, F.lit("base64"))).cast("string"))
    return F.lower(F.regexp_replace(text, "�", ""))


def _base64_findings(t: Column) -> Column:
    runs = F.slice(F.regexp_extract_all(t, F.lit(f"{BASE64_AHEAD}({BASE64})"), 1), 1, 3)
    bad = F.filter(F.transform(runs, _payload), lambda x: F.coalesce(F.array_contains(F.array(*(F.contains(x, F.lit(w)) for w in PAYLOAD_WORDS)), True), F.lit(False)))
    words = lambda x: F.array_join(F.filter(F.array(*map(F.lit, PAYLOAD_WORDS)), lambda w: F.contains(x, w)), ", ")
    return F.transform(bad, lambda x: finding("structural", "STRUCT-005", "T-ENC", "high", "block", 0.85, "Base64-encoded injection payload", F.concat(F.lit("Decoded contains: "), words(x)), "Block encoded injection payloads"))


def text_findings(raw: Column, plain: Column, clean: Column, ratio: Column, cfg: EngineConfig) -> Column:
    """Findings of one text: ``raw`` as sent, ``plain`` decomposed, ``clean``
    also without invisible characters."""
    size, hidden = F.char_length(raw), F.char_length(plain) - F.char_length(clean)
    n_hex, rot = F.regexp_count(clean, F.lit(HEX)), F.regexp_extract_all(clean, F.lit(FLAGS + gated(f"({ROT13})")), 1)
    n_runs, n_roles = F.regexp_count(clean, F.lit(f"(?d){RUN}")), F.regexp_count(clean, F.lit(FLAGS + gated(ROLE)))
    make = lambda *a: finding("structural", *a)
    first = F.array(
        F.when(size > cfg.max_input_length, make("STRUCT-002", "T-DOS", "high", "block", 0.95, F.format_string("Input length %d exceeds maximum %d", size, F.lit(cfg.max_input_length)), None, "Shorten the input")),
        F.when(ratio > cfg.max_decompression_ratio, make("STRUCT-003", "T-DOS", "critical", "block", 0.99, F.format_string("Decompression ratio %.1f", ratio), None, "Reject compressed payloads")),
        F.when(hidden > 0, make("STRUCT-004", "T-ENC", "medium", "sanitize", 0.90, F.format_string("%d invisible characters", hidden), None, "Invisible characters were removed")),
    )
    last = F.array(
        F.when(n_hex > 0, make("STRUCT-006", "T-ENC", "medium", "sanitize", 0.75, F.format_string("Hex-encoded strings: %d", n_hex), None, "Decode and scan again")),
        F.when(F.size(rot) > 0, make("STRUCT-007", "T-ENC", "medium", "sanitize", 0.70, F.concat(F.lit("ROT13 words: "), F.array_join(rot, ", ")), None, "Decode and scan again")),
        F.when(n_runs > 0, make("STRUCT-008", "T-DOS", "low", "sanitize", 0.60, F.format_string("Repeated characters: %d runs", n_runs), None, "Collapse the runs")),
        F.when(n_roles > 0, make("STRUCT-009", "T-PI-D", "medium", "block", 0.70, "Role marker with an override verb", None, "Reject forged roles")),
    )
    return F.concat(F.array_compact(first), _base64_findings(clean), F.array_compact(last)).cast(FINDINGS)


def structural(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """From ``texts`` to ``structural``: verdict, findings, sanitized text."""
    df = df.withColumns({"_plain": nfkd(F.col("texts")), "_ratio": inflated_ratios(F.col("texts"))})
    df = df.withColumn("_clean", F.transform("_plain", strip_zero_width))
    each = F.transform(F.arrays_zip("texts", "_plain", "_clean", "_ratio"), lambda x: text_findings(x["texts"], x["_plain"], x["_clean"], x["_ratio"], cfg))
    empty = F.array(finding("structural", "STRUCT-001", "T-NG", "high", "block", 1.0, "Empty request", None, "Send a prompt or messages"))
    df = df.withColumn("_found", F.when(F.size("texts") == 0, empty).otherwise(F.flatten(each)))
    # Plain columns first: a struct of references is free to be taken apart again.
    df = df.withColumns({"_verdict": strictest(F.transform("_found", lambda f: f["verdict"])), "_text": F.array_join("_clean", "\n")})
    layer = F.struct(F.col("_verdict").alias("verdict"), F.col("_found").alias("findings"), F.col("_text").alias("sanitized"))
    return df.withColumn("structural", layer).drop("_plain", "_ratio", "_clean", "_found", "_verdict", "_text")
