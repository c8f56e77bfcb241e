"""Layers that a user brings along, run closed: a scanner that fails blocks.

A scanner is a function from a text to findings (dictionaries with any of the
fields of a finding).  It runs in tasks, row by row within Arrow batches; what
it raises becomes the row's ``error`` and the verdict ``block``, and never ends
the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.config import LAYERS, EngineConfig
from guardspark.operators.hybrid import arbitrate, nothing_ran
from guardspark.schemas import FINDING, PRIORITY

Scanner = Callable[[str], list[dict]]
LAYER = f"struct<verdict: string, findings: array<{FINDING}>, error: string>"
FIELDS = [f.split(":")[0].strip() for f in FINDING.removeprefix("struct<").removesuffix(">").split(",")]


def closed(name: str, scan: Scanner) -> Callable[[str | None], tuple]:
    """``scan`` with a result for every text: verdict, findings and error."""

    def run(text: str | None) -> tuple:
        try:
            found = [{f: None for f in FIELDS} | {"layer": name} | f for f in scan(text or "")]
            verdict = max((f["verdict"] or "allow" for f in found), key=PRIORITY.__getitem__, default="allow")
            return verdict, found, None
        except Exception as e:
            return "block", [], f"Scanner {name} failed: {e!r}"

    return run


def scanned(text: Column, name: str, scan: Scanner) -> Column:
    """A layer's struct of a text."""
    one = closed(name, scan)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["verdict", "findings", "error"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, LAYER).asNondeterministic()(text)  # each text is scanned once


class Registry:
    """Scanners by layer, run in the order of the layers."""

    def __init__(self) -> None:
        self.scanners: dict[str, Scanner] = {}

    def register(self, layer: str, scan: Scanner) -> None:
        """A layer has one scanner: a second one takes the place of the first."""
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        self.scanners[layer] = scan

    def unregister(self, layer: str) -> None:
        self.scanners.pop(layer, None)

    def run(self, requests: DataFrame, cfg: EngineConfig, text_col: str = "raw_text") -> DataFrame:
        """Requests with a struct for each registered layer (null where it did
        not run), ``verdict``, ``layer`` and ``reason``.  A request's own list
        of scanners goes before the defaults; a fail-closed run ends at the
        first layer that blocks."""
        df, stopped = requests, F.lit(False)
        names = [n for n in LAYERS if n in self.scanners]
        for n in names:
            wanted = F.when(F.col("scanners").isNotNull(), F.coalesce(F.array_contains("scanners", n), F.lit(False))).otherwise(n in cfg.layers)
            # Rows that do not run a layer are not sent to it.
            df = df.withColumn("_on", wanted & ~stopped)
            df = df.withColumn("_text", F.when(F.col("_on"), F.coalesce(F.col(text_col), F.lit(""))))
            df = df.withColumn(n, scanned(F.col("_text"), n, self.scanners[n])).withColumn(n, F.when(F.col("_on"), F.col(n))).drop("_on", "_text")
            stopped = stopped | (F.coalesce(F.col(n)["verdict"] == "block", F.lit(False)) & cfg.fail_closed)
        none = F.lit(None).cast("struct<composite: double, verdict: string>")
        if not names:
            verdict, reason = nothing_ran(cfg)
            return df.withColumns({"verdict": F.lit(verdict), "layer": F.lit("none"), "reason": F.lit(reason)})
        verdict, layer, reason = arbitrate({n: F.col(n) for n in names}, none, cfg)
        return df.withColumns({"verdict": verdict, "layer": layer, "reason": reason})
