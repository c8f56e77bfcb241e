"""From texts to vectors, by any model that a user brings along.

The model is behind ``Embedder``.  Tasks hand it texts in batches, pool the
vectors of the tokens and bring them to length one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts in a batch, tokens of a text.
BATCH, MAX_TOKENS = 32, 256


class Embedder(Protocol):
    """Vectors of tokens (texts, tokens, dimensions) and a mask (texts, tokens)
    that is 1 at the tokens that count; a text has ``max_tokens`` at most."""

    def vectors(self, texts: list[str], max_tokens: int) -> tuple[np.ndarray, np.ndarray]: ...


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of each text's vectors where the mask is 1, of length one."""
    mask = mask[:, :, None].astype(np.float64)
    mean = (vectors * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "raw_text", batch: int = BATCH, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``df`` with ``embedding``.  Null and empty texts get none, nor do texts
    at which the model fails: a failed batch is tried again text by text, so
    that one text never costs another its vector."""

    def some(texts: list[str]) -> list:
        try:
            return list(pooled(*embedder.vectors(texts, max_tokens)))
        except Exception:
            return [None] if len(texts) == 1 else [v for t in texts for v in some([t])]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = [None] * len(part)
            full = [i for i, t in enumerate(part) if t]
            for k in range(0, len(full), batch):
                at = full[k : k + batch]
                for i, v in zip(at, some([part.iloc[i] for i in at]), strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(text_col))
