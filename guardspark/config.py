"""Settings of the engine, passed to the expression builders."""

from __future__ import annotations

from dataclasses import dataclass

LAYERS = ("structural", "pattern", "semantic", "judge")


@dataclass(frozen=True)
class EngineConfig:
    max_input_length: int = 32_000  # code points of a text
    regex_timeout: float = 0.05  # seconds of one rule over one text
    max_decompression_ratio: float = 10.0
    semantic_enabled: bool = False
    judge_enabled: bool = False
    similarity_threshold: float = 0.75
    similarity_floor: float = 0.60  # matches from here on are escalated
    top_k: int = 3
    fail_closed: bool = True
    score_block: float = 0.85
    score_sanitize: float = 0.60
    score_escalate: float = 0.30
    pattern_weight: float = 0.6
    semantic_weight: float = 0.4
    judge_low: float = 0.30
    judge_high: float = 0.70
    judge_chars: int = 2000
    judge_timeout: float = 5.0  # seconds of a call
    judge_calls: int = 1  # calls that a task makes at once
    audit_enabled: bool = True
    retention_days: int = 30
    tokenize_pii: bool = True
    requests_per_minute: int = 60
    window_seconds: int = 60
    rules_mode: str = "compat"  # "fixed": patterns are decomposed as the texts are

    def __post_init__(self):
        if abs(self.pattern_weight + self.semantic_weight - 1) > 0.01:
            raise ValueError("the weights must sum to 1")
        if self.rules_mode not in ("compat", "fixed"):
            raise ValueError(f"unknown rules_mode {self.rules_mode!r}")
        if self.judge_calls < 1 or self.judge_timeout <= 0 or self.regex_timeout <= 0:
            raise ValueError("calls and time limits must be positive")
        if self.requests_per_minute < 1 or self.window_seconds < 1:
            raise ValueError("limits must be positive")

    @property
    def layers(self) -> list[str]:
        """Layers that run unless a request names its own."""
        return ["structural", "pattern"] + ["semantic"] * self.semantic_enabled + ["judge"] * self.judge_enabled
