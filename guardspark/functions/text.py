"""Text preparation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that take no room.  The look ahead is one range,
# which most characters fail at once.
ZERO_WIDTH = r"(?=[^\x00-\xAC])[\xAD\u034F\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]+"
#: Flags of every pattern: no case, Unicode classes, only \n ends a line.
FLAGS = "(?iUd)"


def contents(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["content"])


def texts_to_scan(messages: Column, prompt: Column) -> Column:
    """Contents of the messages if there are any, else the prompt; none for an
    empty conversation without a prompt."""
    return F.when(F.size(messages) > 0, contents(messages)).when(F.coalesce(prompt, F.lit("")) != "", F.array(prompt)).otherwise(F.array().cast("array<string>"))


def raw_text(messages: Column, prompt: Column) -> Column:
    """What the semantic layer and the judge read."""
    return F.when(F.size(messages) > 0, F.array_join(contents(messages), " ")).otherwise(F.coalesce(prompt, F.lit("")))


def action_text(output: Column, prompt: Column, messages: Column) -> Column:
    """What an action redacts: here a prompt comes before messages."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(output), some(prompt), F.array_join(contents(messages), " "), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*$")


def strip_zero_width(c: Column) -> Column:
    """Without characters that take no room; texts in ASCII have none."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.regexp_replace(c, ZERO_WIDTH, ""))


def pii_token(value: Column) -> Column:
    """A stable stand-in for a value."""
    return F.concat(F.lit("TOK:"), F.substring(F.sha2(value, 256), 1, 16))


def tokenize_metadata(metadata: Column, longer_than: int = 10) -> Column:
    return F.transform_values(metadata, lambda k, v: F.when(F.char_length(v) > longer_than, pii_token(v)).otherwise(v))
