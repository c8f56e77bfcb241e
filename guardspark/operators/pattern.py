"""Pattern layer: the rule base over each text, in one Arrow pass.

An automaton tells which rules a text can match (``functions/required.py``);
only these are searched, each for ``regex_timeout`` seconds at most, so that a
text made to be slow costs a rule's limit and is found by its own finding.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from guardspark.config import EngineConfig
from guardspark.functions.required import candidates
from guardspark.functions.rules import RULES, Rule, language, mitigation
from guardspark.schemas import FINDINGS, SEVERITY_VERDICT, once, strictest

PII_RULES = tuple(r for r in RULES if r.category == "T-EXF")
#: Characters of evidence on both sides of a match.
AROUND = 20
LIMIT = EngineConfig.regex_timeout


def rules_table(spark: SparkSession) -> DataFrame:
    """The rule base as a dimension."""
    rows = [(i, *r, SEVERITY_VERDICT[r.severity], language(r.rule_id), mitigation(r)) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "ordinal int, rule_id string, category string, severity string, confidence double, description string, pattern string, verdict string, language string, mitigation string")


@lru_cache(8)
def _compiled(patterns: tuple[str, ...]) -> list[regex.Pattern]:
    return [regex.compile(p, regex.IGNORECASE) for p in patterns]


def _patterns(rules: Iterable[Rule], mode: str) -> tuple[str, ...]:
    return tuple(unicodedata.normalize("NFKD", r.pattern) if mode == "fixed" else r.pattern for r in rules)


def within(limit: float, call: Callable):
    """``call(timeout=limit)``.  One that waited for the processor instead of
    running is tried anew; ``TimeoutError`` for one that ran too long."""
    for again in (True, True, True, False):
        began = time.thread_time()
        try:
            return call(timeout=limit)
        except TimeoutError:
            if not again or time.thread_time() - began > limit / 2:
                raise


def search(patterns: tuple[str, ...], text: str, limit: float) -> list[tuple[int, str | None, bool]]:
    """(rule, evidence, whether it ran too long) of one text, in rule order."""
    out = []
    for i in candidates(patterns)(text):
        try:
            if m := within(limit, lambda timeout: _compiled(patterns)[i].search(text, timeout=timeout)):
                out.append((i, text[max(0, m.start() - AROUND) : m.end() + AROUND], False))
        except TimeoutError:
            out.append((i, None, True))
    return out


_FOUND = pa.list_(pa.struct([("rule", pa.int32()), ("evidence", pa.string()), ("late", pa.bool_())]))
_SEARCHED = "struct<found: array<struct<rule: int, evidence: string, late: boolean>>, ms: double, error: string>"


def _searcher(patterns: tuple[str, ...], limit: float):
    @F.arrow_udf(_SEARCHED)
    def found(texts: pa.Array) -> pa.Array:
        out, took, errors = [], [], []
        for row in texts.to_pylist():
            began, said = time.perf_counter(), None
            try:
                hits = None if row is None else [{"rule": i, "evidence": e, "late": x} for t in row if t for i, e, x in search(patterns, t, limit)]
            except Exception as e:  # the row's own: it never ends the job
                hits, said = [], f"Scanner pattern failed: {e!r}"
            out.append(hits)
            took.append(1000 * (time.perf_counter() - began))
            errors.append(said)
        return pa.StructArray.from_arrays([pa.array(out, _FOUND), pa.array(took), pa.array(errors, pa.string())], names=["found", "ms", "error"])

    return found.asNondeterministic()  # a search can time out here and not there


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _finding(r: Rule) -> str:
    values = {"layer": "pattern", "rule_id": r.rule_id, "category": r.category, "severity": r.severity, "verdict": SEVERITY_VERDICT[r.severity]}
    fields = [f"'{k}', '{v}'" for k, v in values.items()]
    seen = _literal(f"[REDACTED:{r.rule_id}]") if r.category == "T-EXF" else "CAST(NULL AS STRING)"
    return f"named_struct({', '.join(fields)}, 'confidence', {r.confidence}D, 'description', {_literal(r.description)}, 'evidence', {seen}, 'mitigation', {_literal(mitigation(r))})"


def timed_out(rule_id: Column) -> Column:
    """What a search that ran too long leaves: it blocks."""
    values = [F.lit("pattern"), F.concat(rule_id, F.lit("-TIMEOUT")), F.lit("T-NG"), F.lit("medium"), F.lit("block"), F.lit(0.5), F.concat(F.lit("Search for "), rule_id, F.lit(" gave up: the text may be made to be slow")), F.lit(None).cast("string"), F.lit("Simplify the rule or shorten its gaps")]
    return F.struct(*(v.alias(n) for v, n in zip(values, ("layer", "rule_id", "category", "severity", "verdict", "confidence", "description", "evidence", "mitigation"), strict=True)))


def searched(texts: Column, rules: Iterable[Rule] = RULES, mode: str = "compat", limit: float = LIMIT) -> Column:
    """The search over an array of texts: rules ``found``, and the ``ms`` it took."""
    return _searcher(_patterns(rules, mode), limit)(texts)


def whole_findings(found: Column, rules: Iterable[Rule] = RULES) -> Column:
    """Findings from what a search found."""
    table = F.expr(f"array({', '.join(map(_finding, rules))})")

    def whole(f: Column) -> Column:
        r = F.element_at(table, f["rule"] + 1)
        return F.when(f["late"], timed_out(r["rule_id"])).otherwise(r.withField("evidence", F.coalesce(r["evidence"], f["evidence"])))

    return F.transform(found, whole).cast(FINDINGS)


def text_findings(texts: Column, rules: Iterable[Rule] = RULES, mode: str = "compat", limit: float = LIMIT) -> Column:
    """Findings of an array of texts: text by text, in rule order; null for null."""
    rules = tuple(rules)
    return whole_findings(searched(texts, rules, mode, limit)["found"], rules)


def rule_findings(text: str, rules: Iterable[Rule] = RULES, mode: str = "compat", limit: float = LIMIT) -> Column:
    """Findings of a text column; none for null."""
    return text_findings(F.array(F.col(text)), rules, mode, limit)


def with_layer(df: DataFrame, name: str, findings: str, error: str | None = None) -> DataFrame:
    """A layer's struct from its findings; a row with an ``error`` is blocked.
    The verdict is a plain column first: a struct of references is free to be
    taken apart again."""
    verdict = strictest(F.transform(findings, lambda f: f["verdict"]))
    df = df.withColumn("_verdict", verdict if error is None else F.when(F.col(error).isNotNull(), "block").otherwise(verdict))
    return df.withColumn(name, F.struct(F.col("_verdict").alias("verdict"), F.col(findings).alias("findings"))).drop("_verdict")


def layer_of(findings: Column) -> Column:
    return F.struct(strictest(F.transform(findings, lambda f: f["verdict"])).alias("verdict"), findings.alias("findings"))


def pattern(df: DataFrame, cfg: EngineConfig, rules: Iterable[Rule] = RULES) -> DataFrame:
    """From ``scan_texts`` to ``pattern``, verdict and findings, with
    ``pattern_ms``, the time that its search took, and ``pattern_error``: a
    search that fails blocks its row, without a finding."""
    rules = tuple(rules)
    df = df.withColumn("_search", searched(F.col("scan_texts"), rules, cfg.rules_mode, cfg.regex_timeout))
    df = df.withColumns({"_found": once(whole_findings(F.col("_search")["found"], rules)), "pattern_ms": F.col("_search")["ms"], "pattern_error": F.col("_search")["error"]})
    return with_layer(df, "pattern", "_found", "pattern_error").drop("_found", "_search")


def redacted(text: str, limit: float = LIMIT) -> str:
    """Every match of the PII rules, one rule after the other.  What can't be
    searched within the limit goes as a whole."""
    patterns = _patterns(PII_RULES, "compat")
    for i in candidates(patterns)(text):
        mark = f"[REDACTED:{PII_RULES[i].rule_id}"
        try:
            text = within(limit, lambda timeout: _compiled(patterns)[i].sub(mark + "]", text, timeout=timeout))
        except TimeoutError:
            return mark + "-TIMEOUT]"
    return text


@F.arrow_udf(StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redacted(t) for t in texts.to_pylist()], pa.string())


def redact(text: Column) -> Column:
    """``redacted`` as a column."""
    return _redacted.asNondeterministic()(text)
