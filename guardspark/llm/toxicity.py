"""Toxicity: a counterfactual-regularised linear classifier.

Features are the hashed distinct words of a text.  Labelled texts that name a
group are given a twin in which every identity term is replaced by another;
training adds a penalty on the difference between the two scores, so that the
mention of a group by itself moves no score.  Weights are fitted on a bounded
sample of labelled documents and sent to the scoring tasks, which read every
text once.

Training reads only labels whose document falls outside the held-out quarter
(crc32 of the id as text, modulo 4, equal to 2).  Defined results: null and
empty texts get the score of the bias alone; documents with a null id count as
not held out; repeated rows get equal scores; without labels of both kinds every
score is alike, 0.5 at most; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.linear import Sparse, fit, sigmoid

DIM = 1 << 18
#: Labelled documents that training takes at most (in expectation: those with
#: the lowest id hashes, so that the same ones are taken at every run).
SAMPLE = 20_000
L2 = 1e-6
PULL = 4.0
THRESHOLD = 0.3
REMEMBERED = 500_000

#: Identity terms by kind; a swap stays within the kind.
IDENTITY = {
    "gender": "women men woman man girls boys girl boy female male transgender nonbinary".split(),
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual".split(),
    "religion": "muslim christian jewish hindu buddhist sikh atheist catholic protestant".split(),
    "religions": "muslims christians jews hindus buddhists sikhs atheists catholics protestants".split(),
    "origin": "african american asian european latino mexican chinese indian arab german french spanish russian".split(),
    "status": "immigrants refugees foreigners migrants citizens".split(),
    "colour": "black white brown".split(),
    "health": "disabled blind deaf autistic".split(),
}
SWAP = {w: ws[(i + 1) % len(ws)] for ws in IDENTITY.values() for i, w in enumerate(ws)}


def core(word: str) -> str:
    """A word in lower case without punctuation at its ends."""
    return word.lower().strip("\"'`.,;:!?()[]{}<>«»“”‘’…-–—*_#&%$|/\\")


def place(word: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word.encode()) & (DIM - 1)


class _Cores(dict):
    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = core(word)
        return out


def words_of(text: str | None, cores: _Cores) -> set[str]:
    out = set(map(cores.__getitem__, set((text or "").split())))
    out.discard("")
    return out


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts and of their twins."""
    cores = _Cores()
    pack = lambda ws: np.unique(np.fromiter(map(place, ws), np.uint32, len(ws))).tobytes()
    for b in batches:
        own, twin = [], []
        for t in b.column("text"):
            ws = words_of(t.as_py(), cores)
            own.append(pack(ws))
            twin.append(pack({SWAP.get(w, w) for w in ws}) if ws & SWAP.keys() else None)
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(own, pa.binary()), pa.array(twin, pa.binary())], names=["label", "own", "twin"])


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, sample: int = SAMPLE, pull: float = PULL) -> tuple[np.ndarray, float]:
    """Weights and bias from ``doc_id``, ``text`` and ``label`` (0 or 1)."""
    # At most ``sample`` documents, those of least hash; of repeated ids one text and the higher label.
    share = min(1.0, 1.2 * sample / max(labelled.count(), 1))
    hashed = labelled.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).where(F.col("h") < F.lit(int(share * (1 << 30)) + 1))
    few = hashed.groupBy("h", "doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("h", "doc_id").limit(sample)
    rows = few.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_sampler, "label int, own binary, twin binary").toArrow()
    y = np.array(rows.column("label").to_pylist(), np.float64)
    if len(set(y)) < 2:
        return np.zeros(DIM), 0.0 if y.any() else -4.0
    own = [np.frombuffer(x, np.uint32) for x in rows.column("own").to_pylist()]
    twins = [(i, np.frombuffer(x, np.uint32)) for i, x in enumerate(rows.column("twin").to_pylist()) if x is not None]
    x = Sparse(own, None, DIM)
    # A feature counts by how unlike the two classes have it; rare ones count little.
    in_1, in_0 = x.back(y), x.back(1 - y)
    ratio = np.log((in_1 + 1) / (y.sum() + 2)) - np.log((in_0 + 1) / ((1 - y).sum() + 2))
    apart = np.abs(in_1 / (y.sum() + 1) - in_0 / ((1 - y).sum() + 1))
    scale = np.sqrt(3 * apart) * np.clip(np.abs(ratio) - 1, 0, 3) * (in_1 + in_0 >= 5)
    twin = (np.array([i for i, _ in twins], np.int64), Sparse([p for _, p in twins], None, DIM)) if twins else None
    if twins:  # a twin's terms may be new: they take part as the terms they replace
        scale = np.maximum(scale, (twin[1].back(np.ones(len(twins))) > 0) * 0.5)
    return fit(x, y, L2, twin=twin, pull=pull, scale=scale)


class _Weights(dict):
    """Weight of each raw word's core."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        c = core(word)
        self[word] = out = place(c) if c else -1
        return out


def score_texts(df: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, one row per input row."""
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # DIM numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        places = _Weights(w)
        for b in batches:
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column(1)):
                at = np.array(list(set(map(places.__getitem__, set((t.as_py() or "").split())))), np.int64)
                z[i] = bias + float(np.sort(w[at[at >= 0]]).sum(dtype=np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(z))], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    labels = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))  # of contradicting labels the higher one
    weights, bias = train(docs.join(labels, "doc_id"))
    out = score_texts(docs, weights, bias)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
