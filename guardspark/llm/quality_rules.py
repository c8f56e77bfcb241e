"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure sets one bit and its
measurement is kept beside it.  A policy is a version and a mask over those
bits, so a policy can change, or a rule be left out, without the texts being
read again.  ``store`` writes the ledger without the texts; policies and
ablations read that table.  Everything is a column expression.

Defined results: a null text has no words; repeated rows are judged alike;
columns named as a measure, ``fail_bits``, ``measures`` or ``kept`` are
replaced, all others stay, whatever their names; ids are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.scratch import Scratch, free

#: White space between words, as a class of a Java pattern.
WS = r"[\x20\x09-\x0D]"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_letters", "n_upper", "n_dup_lines", "n_text_lines", "n_repeat_words")


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules read, ``MEASURES``; they replace columns
    of these names."""
    words, lines, windows, places = (free(df, f"_{x}") for x in ("words", "lines", "windows", "places"))
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(words, F.filter(F.split(t, WS + "+", -1), lambda x: x != ""))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # One hash for each window of three words, sorted beside its position, so that equal windows are neighbours.
    hashes = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    df = df.withColumn(windows, F.when(F.col("n_words") >= 4, F.sort_array(hashes)))
    at = lambda i: F.get(windows, i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
    df = df.withColumn(places, F.sort_array(F.transform(twice, lambda i: F.get(windows, i)["p"])))
    # A window adds the words that the window before it did not reach.
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumns({
        "word_chars": (F.char_length(t) - F.regexp_count(t, F.lit(WS))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_letters": (F.char_length(t) - F.regexp_count(t, F.lit(r"[^\p{L}]"))).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_text_lines": F.size(lines).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop(words, lines, windows, places)


@dataclass(frozen=True)
class Rule:
    """fails: a boolean column over the measures; measure: what the ledger keeps."""

    name: str
    fails: Callable[[], Column]
    measure: Callable[[], Column]


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


#: A rule's place is its bit; new rules go to the end.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50, lambda: F.col("n_words").cast("double")),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), lambda: _share("n_repeat_words", "n_words")),
    Rule("symbols", lambda: F.col("n_symbols") * 4 > F.col("n_words"), lambda: _share("n_symbols", "n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_text_lines"), lambda: _share("n_dup_lines", "n_text_lines")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words"), lambda: _share("word_chars", "n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words"), lambda: _share("word_chars", "n_words")),
    Rule("few_letters", lambda: 100 * F.col("n_letters") < 50 * F.col("word_chars"), lambda: _share("n_letters", "word_chars")),
    Rule("shouting", lambda: 100 * F.col("n_upper") > 60 * F.col("n_letters"), lambda: _share("n_upper", "n_letters")),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
#: Versions of the policy: the rules that count.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "2024-1": sum(BIT.values()),
}
BASE = POLICIES["base"]


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures, ``fail_bits`` and ``measures`` (one double per rule)."""
    bits = F.lit(0)
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(BIT[r.name])).otherwise(F.lit(0)))
    return with_measures(df, text_col).withColumns({"fail_bits": bits, "measures": F.array(*(r.measure() for r in RULES))})


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The ledger of ``df`` without the texts, written to a scratch table."""
    return Scratch(df.sparkSession).table(ledger(df, text_col).drop(text_col), "ledger")


def apply_policy(judged: DataFrame, version: str = "2024-1") -> DataFrame:
    """Add ``kept``: no bit of the policy's mask is set."""
    return judged.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(judged: DataFrame, version: str = "2024-1") -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept
    if it were left out.  The ledger is first counted by distinct bits, of
    which there are at most 2 ** rules, whatever the number of documents."""
    mask = POLICIES[version]
    seen = judged.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(r.name, BIT[r.name]) for r in RULES if BIT[r.name] & mask]
    per = seen.select("n", "bits", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules))).alias("r")).select("n", "bits", "r.*")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.lit(mask) - F.col("bit"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return per.groupBy("rule").agg(total(hit).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_failed_alone"), total(rest == 0).alias("n_kept_without"))


OP7_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its base measures, failure bits, what each rule
    measured and the verdict, from the stored ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_policy(store(docs)).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0)
    return judged.select("doc_id", *OP7_COLUMNS, "base_failed", "kept", "fail_bits", *(F.col("measures")[i].alias(f"m_{r.name}") for i, r in enumerate(RULES)))


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from one stored ledger."""
    judged = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return reduce(DataFrame.unionByName, [ablation(judged, v).withColumn("version", F.lit(v)) for v in POLICIES])


LEDGER_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM w WHERE len(w) >= 3),
d AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (
  SELECT doc_id, sum(least(3, p - coalesce(prev, p - 3))) AS n FROM (
    SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM d) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_text_lines, length(regexp_replace(t, '[^\pL]', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN n_symbols * 4 > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_text_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_letters < 50 * word_chars THEN 64 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 60 * n_letters THEN 128 ELSE 0 END) AS fail_bits FROM m)
"""
OP7_SQL = LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::INTEGER AS fail_bits,
       n_words::DOUBLE AS m_few_words, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS m_repeated_words,
       coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS m_symbols, coalesce(n_dup_lines::DOUBLE / nullif(n_text_lines, 0), 0) AS m_repeated_lines,
       coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS m_short_words, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS m_long_words,
       coalesce(n_letters::DOUBLE / nullif(word_chars, 0), 0) AS m_few_letters, coalesce(n_upper::DOUBLE / nullif(n_letters, 0), 0) AS m_shouting
FROM b
"""
ABLATION_SQL = LEDGER_SQL + """
SELECT version, rule, sum((fail_bits & bit <> 0)::INT)::BIGINT AS n_failed, sum((fail_bits & mask = bit)::INT)::BIGINT AS n_failed_alone,
       sum((fail_bits & (mask - bit) = 0)::INT)::BIGINT AS n_kept_without
FROM b, (VALUES ('base', 3), ('2024-1', 255)) AS v(version, mask),
     (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8),
             ('short_words', 16), ('long_words', 32), ('few_letters', 64), ('shouting', 128)) AS r(rule, bit)
WHERE mask & bit <> 0 GROUP BY version, rule
"""
