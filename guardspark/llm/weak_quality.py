"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or nothing on each document; they fall
into three defects, and the labellers of a defect overlap.  There are at most
3 ** 9 patterns of votes, so the corpus is counted by pattern, and
expectation-maximisation on these counts estimates for each defect how often
its labellers vote what on defective and on sound documents.  A document's soft
label is the posterior that it is free of every defect.  A hashed linear
scorer, fitted on a bounded sample of documents with their soft labels, then
judges every text by itself.

Texts are read once: each document's votes and features, a few hundred bytes,
go to a scratch table, from which patterns are counted, the sample is drawn
and documents are scored.

No hand label is read.  Defined results: null texts and texts without words
get score 0 and are rejected; repeated rows are judged alike; further columns
stay; an empty table trains nothing and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.llm.linear import Sparse, fit, sigmoid
from guardspark.llm.scratch import free, lean, Scratch

DIM = 1 << 14
#: Distinct texts that training takes at most: those with the lowest hashes.
SAMPLE = 20_000
L2 = 1e-5
KEEP = 0.5
REMEMBERED = 500_000
SYMBOLS = frozenset("#*$%&|<>")


def _shape(word: str) -> str:
    """Letters, capitals and digits as a, A and 0, runs as one; other
    characters as they are."""
    if word.isalpha() and word.islower():
        return "a"
    out = []
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:12])


#: Columns of the word table.
SYMBOL, DECORATED, SHOUTED, EXCLAIMED, LETTERS, CAPITALS, LENGTH, SHAPE = range(8)


class _Words(dict):
    """The row of each word in a table of what is known of it."""

    def __init__(self):
        super().__init__()
        self.table, self.hashes = np.zeros((1024, 8), np.int32), np.zeros(1024, np.int64)

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) == len(self.table):
            self.table, self.hashes = np.concatenate([self.table, self.table]), np.concatenate([self.hashes, self.hashes])
        place = xxhash.xxh32_intdigest(("shape " + _shape(word)).encode()) & (DIM - 1)
        symbols = 0 if word.isalpha() else sum(c in SYMBOLS for c in word)
        letters = len(word) if word.isalpha() else sum(map(str.isalpha, word))
        capitals = 0 if word.islower() else sum(map(str.isupper, word))
        self[word] = i = len(self)
        self.table[i] = (symbols, symbols > 0, len(word) > 1 and word.upper() == word != word.lower(), word.count("!"), letters, capitals, len(word), place)
        self.hashes[i] = xxhash.xxh64_intdigest(word.encode()) >> 1
        return i


@dataclass
class Measures:
    """What the labellers and the scorer read of a text; shares of its words
    unless said otherwise."""

    n: int  # words
    symbols: float  # per word
    decorated: float  # with a symbol
    shouted: float  # in capitals
    exclaimed: float  # exclamation marks per word
    letters: float  # of all characters
    capitals: float  # of all letters
    repeated: float  # windows of three words that occur again
    echoed: float  # equal to the word before
    distinct: float
    dup_lines: float  # of all lines
    shapes: np.ndarray
    counts: np.ndarray


def measure(text: str | None, words: _Words, with_shapes: bool = True) -> Measures:
    text = text or ""
    if len(words) > REMEMBERED:
        words.clear()
    found = text.split()
    n = len(found)
    rows = np.fromiter(map(words.__getitem__, found), np.int64, n)
    a = words.table[rows]
    h = words.hashes[rows]
    repeated = echoed = 0.0
    if n > 3:
        m = np.int64(0x5851F42D4C957F2D)
        with np.errstate(over="ignore"):
            tri = np.sort((h[:-2] * m + h[1:-1]) * m + h[2:])
        same = tri[1:] == tri[:-1]
        repeated = float((np.r_[same, False] | np.r_[False, same]).mean())
        echoed = float((h[1:] == h[:-1]).mean())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    shapes = counts = np.zeros(0, np.int64)
    if with_shapes:
        shapes, counts = np.unique(a[:, SHAPE], return_counts=True)
    total = a.sum(axis=0, dtype=np.float64)
    per = lambda c: float(total[c]) / max(n, 1)
    return Measures(n, per(SYMBOL), per(DECORATED), per(SHOUTED), per(EXCLAIMED), float(total[LETTERS] / max(total[LENGTH], 1)), float(total[CAPITALS] / max(total[LETTERS], 1)), repeated, echoed, len(set(found)) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), shapes, counts)


def _vote(bad: bool, good: bool) -> int:
    return 2 if bad else 1 if good else 0


#: Defects, each with the labellers that overlap on it.  A labeller votes 2
#: (bad), 1 (good) or 0 (nothing).
DEFECTS = {
    "symbols": {
        "symbols": lambda m: _vote(m.symbols > 0.25, m.symbols < 0.05),
        "decorated": lambda m: _vote(m.decorated > 0.2, m.decorated < 0.05),
        "few letters": lambda m: _vote(m.letters < 0.72, m.letters > 0.85),
    },
    "repetition": {
        "repeated": lambda m: _vote(m.repeated > 0.5 and m.n >= 50, m.repeated < 0.2),
        "little variety": lambda m: _vote(m.distinct < 0.3 and m.n >= 50, m.distinct > 0.5),
        "echoes": lambda m: _vote(m.n >= 50 and (m.echoed > 0.2 or m.dup_lines > 0.6), m.echoed < 0.02),
    },
    "shouting": {
        "shouted": lambda m: _vote(m.shouted > 0.5 and m.n >= 10, m.shouted < 0.1),
        "exclaimed": lambda m: _vote(m.exclaimed > 0.5, m.exclaimed < 0.1),
        "capitals": lambda m: _vote(m.capitals > 0.6 and m.n >= 10, m.capitals < 0.2),
    },
}
LABELLERS = {name: vote for group in DEFECTS.values() for name, vote in group.items()}
N = len(LABELLERS)
#: A labeller votes bad on so many sound documents at most, and on so many
#: defective ones at least: it is better than chance.
FALSE, TRUE = 0.05, 0.5


def pattern(m: Measures) -> int:
    """All votes as digits to the base of three."""
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(m)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return np.stack([(patterns // 3 ** (N - 1 - i)) % 3 for i in range(N)], axis=1)


def _two_classes(votes: np.ndarray, counts: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """P(sound) of each pattern of one defect's labellers, and P(vote | class)
    as (labeller, class, vote) with class 1 sound."""
    has = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    # Start from the balance of votes; a bad one outweighs a good one.
    sound = sigmoid((votes == 1).sum(1) + 1.0 - 2.0 * (votes == 2).sum(1))
    for _ in range(steps):
        table = np.stack([np.einsum("p,plv->lv", counts * w, has) + 0.1 for w in (1 - sound, sound)], axis=1)
        table /= table.sum(axis=2, keepdims=True)
        for c, low, high in ((0, TRUE, 1.0), (1, 0.0, FALSE)):
            bad = np.clip(table[:, c, 2], low, min(high, 1 - 1e-6))
            table[:, c, :2] *= ((1 - bad) / np.maximum(1 - table[:, c, 2], 1e-12))[:, None]
            table[:, c, 2] = bad
        share = np.array([(counts * (1 - sound)).sum(), (counts * sound).sum()]) + 1
        log = np.einsum("plv,lcv->pc", has, np.log(np.maximum(table, 1e-12))) + np.log(share / share.sum())
        sound = sigmoid(log[:, 1] - log[:, 0])
    return sound, table


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 50) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """P(good) of each pattern - free of every defect - and for each labeller
    the shares of defective and of sound documents on which it is not wrong."""
    votes, counts = votes_of(patterns), counts.astype(float)
    good, accuracies, at = np.ones(len(patterns)), {}, 0
    for group in DEFECTS.values():
        sound, table = _two_classes(votes[:, at : at + len(group)], counts, steps)
        good *= sound
        accuracies |= {name: (1 - float(table[i, 0, 1]), 1 - float(table[i, 1, 2])) for i, name in enumerate(group)}
        at += len(group)
    return good, accuracies


def features(m: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: the shapes of the words by their share, and steps of
    the measures; one place can hold several of them."""
    import xxhash

    steps = [f"{name} {min(10, int(value * 10))}" for name, value in (("repeated", m.repeated), ("distinct", m.distinct), ("echoed", m.echoed), ("letters", m.letters), ("capitals", m.capitals), ("decorated", m.decorated))]
    more = np.array([xxhash.xxh32_intdigest(s.encode()) & (DIM - 1) for s in steps], np.int64)
    return np.concatenate([m.shapes, more]), np.concatenate([np.sqrt(m.counts / max(m.n, 1)), np.full(len(more), 0.5)])


def _measure_all(texts: Iterator) -> Iterator:
    """Pattern, places and values of each text; no places without words."""
    import pandas as pd

    words = _Words()
    for part in texts:
        rows = []
        for t in part:
            m = measure(t, words)
            places, values = features(m) if m.n else (np.zeros(0), np.zeros(0))
            rows.append((pattern(m), places.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["pattern", "places", "values"])


_measure_all.__annotations__ = {}


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    accuracies: dict[str, tuple[float, float]]  # of bad and of good documents that get no wrong vote


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (its columns ``keep``, or all) with what the labellers and the
    scorer read of each text, written to a scratch table; and the name of the
    column that holds it."""
    name = free(docs, "measured")
    udf = F.pandas_udf(lean(_measure_all), "pattern int, places binary, values binary", F.PandasUDFType.SCALAR_ITER)
    read = docs.withColumns({name: udf(text_col), f"{name}_hash": F.pmod(F.xxhash64(text_col), F.lit(1 << 30))})
    columns = docs.columns if keep is None else keep
    whole = F.struct(f"{name}.*", F.col(f"{name}_hash").alias("hash")).alias(name)
    return Scratch(docs.sparkSession).table(read.select(*columns, whole), "measured"), name


def train(read: DataFrame, name: str, sample: int = SAMPLE) -> Model:
    """Labellers' accuracies by EM over all documents of a table that
    ``measured`` made, and the scorer."""
    rows = read.select(f"{name}.*")
    counted = rows.groupBy("pattern").count().toPandas()  # 3 ** 9 rows at most
    if not len(counted):
        return Model(np.zeros(DIM), 0.0, {})
    good, accuracies = expectation_maximisation(counted["pattern"].to_numpy(), counted["count"].to_numpy())
    soft = dict(zip(counted["pattern"], good, strict=True))
    # At most ``sample`` texts, those of least hash; a text counts once however often it stands.
    share = min(1.0, 1.2 * sample / counted["count"].sum())
    few = rows.where((F.octet_length("places") > 0) & (F.col("hash") < F.lit(int(share * (1 << 30)))))
    few = few.groupBy("hash").agg(F.min(F.struct("pattern", "places", "values")).alias("m")).orderBy("hash").limit(sample).select("m.*").toArrow()
    y = np.array([soft.get(p, 0.5) for p in few.column("pattern").to_pylist()])
    x = Sparse([np.frombuffer(p, np.int32) for p in few.column("places").to_pylist()], [np.frombuffer(v, np.float32) for v in few.column("values").to_pylist()], DIM)
    weights, bias = fit(x, y, L2) if x.n else (np.zeros(DIM), 0.0)
    return Model(weights, bias, accuracies)


def score(read: DataFrame, name: str, model: Model) -> Column:
    """The score of each row (0 to 1, higher: better) of a table that
    ``measured`` made."""
    sent = read.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # DIM numbers

    def run(places, values):
        import pandas as pd

        w, bias = sent.value
        return pd.Series([float(sigmoid(bias + float(w[np.frombuffer(p, np.int32)] @ np.frombuffer(v, np.float32)))) if p else 0.0 for p, v in zip(places, values, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(F.col(f"{name}.places"), F.col(f"{name}.values"))


def judge(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP, names: tuple[str, str] = ("quality_score", "kept"), columns: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``columns``, or all) with score and verdict, which replace
    columns of the same ``names``."""
    read, name = measured(docs, text_col, columns)
    model = train(read, name, sample)
    return read.withColumn(names[0], score(read, name, model)).withColumn(names[1], F.col(names[0]) >= keep).drop(name)


def op5_weak_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, columns=["doc_id"]).select("doc_id", "quality_score", "kept")
