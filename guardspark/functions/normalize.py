"""The two text functions that Spark lacks, as Arrow-batched UDFs.

Both are fed nulls for rows that need no work, so ASCII texts never reach
Python as strings.  They are marked as not deterministic, which keeps the
optimizer from moving them into the arguments of later functions in Python:
such a mixture can't be planned.
"""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [None if t is None else unicodedata.normalize("NFKD", t) for t in a])


def nfkd(texts: Column) -> Column:
    """Compatibility decomposition of an array of texts."""
    foreign = F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]"))
    return F.coalesce(_nfkd.asNondeterministic()(F.when(foreign, texts)), texts)


#: What a stream may grow to is not more than this many times its length.
MOST_RATIO = 1000
STEP = 1 << 20


def _ratio(text: str | None) -> float | None:
    """How much longer a whole zlib stream is once inflated; null for anything
    else.  Inflated in steps, of which only the length is kept, and not beyond
    ``MOST_RATIO``, where a bomb counts as that long."""
    if not text:
        return None
    data = text.encode()
    stream, rest, size = zlib.decompressobj(), data, 0
    try:
        while not stream.eof:
            part = stream.decompress(rest, STEP)
            size, rest = size + len(part), stream.unconsumed_tail
            if size >= MOST_RATIO * len(data):
                return float(MOST_RATIO)
            if not part and not rest:
                return None  # it broke off
    except zlib.error:
        return None
    return size / len(data)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inflated(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [_ratio(t) for t in a])


def inflated_ratios(texts: Column) -> Column:
    """How much longer each text is once inflated; null where it is no zlib
    stream.  Only texts with a stream's first byte are looked at."""
    stream = F.exists(texts, lambda t: t.rlike(r"^x[\x01\x5E\x9C\xDA]") | t.rlike(r"^[\x08\x18\x28\x38\x48\x58\x68\x78]"))
    return F.coalesce(_inflated.asNondeterministic()(F.when(stream, texts)), F.transform(texts, lambda t: F.lit(None).cast("double")))
