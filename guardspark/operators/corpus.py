"""Attack corpus: from raw labelled attacks to the reference table.

Every "first one wins" is a window over an explicit order, never the order in
which rows happen to arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words in a raw category, first that is contained wins, and
# severities by raw value.
CATEGORY_WORDS = {
    "direct_injection": "T-PI-D",
    "indirect_injection": "T-PI-I",
    "jailbreak": "T-JB",
    "role_play": "T-JB",
    "roleplay": "T-JB",
    "extraction": "T-EXT",
    "data_exfiltration": "T-EXF",
    "tool_injection": "T-TOOL",
    "mcp_poisoning": "T-TOOL",
    "memory_poisoning": "T-MEM",
    "encoding_evasion": "T-ENC",
    "dos": "T-DOS",
    "goal_hijack": "T-AGT",
    "cascading": "T-CASC",
}
SEVERITY_VALUES = {"critical": ("critical", "4"), "high": ("high", "3"), "medium": ("medium", "2")}


def clean_attacks(raw: DataFrame) -> DataFrame:
    """Attacks that are labelled so, not augmented, and not too short."""
    return raw.where((F.col("label") == 1) & ~F.coalesce("augmented", F.lit(False)) & (F.char_length(F.trim("text")) >= 10))


def first_seen(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy("_key").orderBy(order)
    return df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")


def cap_per_category(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """At most ``n`` rows of each raw category: the feature of this step."""
    w = Window.partitionBy("category").orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def map_category(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda rest, kv: F.when(low.contains(kv[0]), kv[1]).otherwise(rest), reversed(CATEGORY_WORDS.items()), F.lit("T-PI-D"))


def map_severity(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return reduce(lambda rest, kv: F.when(low.isin(*kv[1]), kv[0]).otherwise(rest), reversed(SEVERITY_VALUES.items()), F.lit("low"))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """All sources, the first before the second, each in its own order."""
    out = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    return joined.withColumn("ord", F.struct("_src", "ord")).drop("_src")


def build_corpus(frontier: DataFrame, *sources: DataFrame, max_rows: int = 2000) -> DataFrame:
    """``index``, ``text`` (200 characters), ``category``, ``severity`` and
    ``source``: each source filtered, made distinct and capped, then merged,
    made distinct again without case, and sampled by hash down to ``max_rows``
    (frontier rows always stay)."""
    cap = max(50, max_rows // 10)
    cleaned = [cap_per_category(first_seen(clean_attacks(s), F.col("text")), cap) for s in sources]
    merged = merge_sources(frontier.withColumn("source", F.lit("frontier")), *cleaned)
    merged = first_seen(merged, F.lower(F.trim("text")))
    keep = merged.withColumn("_pick", F.when(F.col("source") == "frontier", F.lit(-1)).otherwise(F.pmod(F.xxhash64("text"), F.lit(1 << 40)))).orderBy("_pick", "ord").limit(max_rows)
    numbered = keep.withColumn("index", F.row_number().over(Window.orderBy("ord")) - 1)  # max_rows rows
    return numbered.select("index", F.substring("text", 1, 200).alias("text"), map_category(F.col("category")).alias("category"), map_severity(F.col("severity")).alias("severity"), "source")
