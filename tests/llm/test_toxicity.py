import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from guardspark.llm import toxicity as x
from tests.llm.cases import awkward, empty


def labelled(spark, n=600):
    """Toxic texts carry an insult; most of them also name one group, which
    neutral texts seldom do."""
    rng, rows = random.Random(3), []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{rng.randint(0, 400)}" for _ in range(30)]
        if toxic:
            words[rng.randint(0, 29)] = rng.choice(["idiot!", "Moron", "scum,"])
        if rng.random() < (0.8 if toxic else 0.05):
            words[rng.randint(0, 29)] = "muslims"
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_a_neutral_mention_moves_the_score_less(spark):
    rows = labelled(spark)
    plain, fair = x.train(rows, pull=0.0), x.train(rows, pull=50.0)
    gap = lambda m: abs(m[0][x.place("muslims")] - m[0][x.place(x.SWAP["muslims"])])
    assert gap(fair) < 0.5 * gap(plain)
    assert fair[0][x.place("idiot")] > 1


def test_held_out_accuracy(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in x.op10_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out}
    right = sum(got[i].predicted == y for i, y in truth.items())
    assert right >= 0.9 * len(truth)
    assert np.mean([got[i].score for i, y in truth.items() if y]) > 0.4 > np.mean([got[i].score for i, y in truth.items() if not y]) + 0.2


def test_awkward_rows(spark):
    model = x.train(labelled(spark))
    rows = x.score_texts(awkward(spark), *model).collect()
    by = {r.doc_id: r.score for r in rows}
    assert len(rows) == awkward(spark).count() and by[0] == by[1] == by[2]
    assert x.score_texts(empty(spark), *model).count() == 0
    none = labelled(spark).limit(0)
    assert x.train(none)[1] < 0 and (x.train(labelled(spark).where("label = 0"))[0] == 0).all()


def plain_features(text):
    cores = {w.lower().strip("\"'`.,;:!?()[]{}<>«»“”‘’…-–—*_#&%$|/\\") for w in (text or "").split()} - {""}
    place = lambda ws: {xxhash.xxh32_intdigest(w.encode()) % x.DIM for w in ws}
    return place(cores), place({x.SWAP.get(w, w) for w in cores}) if cores & set(x.SWAP) else None


def plain_training(rows, pull, steps=300):
    """The counterfactual-regularised classifier by loops over its definition."""
    own, twins = zip(*(plain_features(t) for t, _ in rows))
    ys, n = [y for _, y in rows], len(rows)
    ones, used = sum(ys), set().union(*own, *(t for t in twins if t))
    scale = {}
    for f in used:
        a, b = sum(y for o, y in zip(own, ys) if f in o), sum(1 - y for o, y in zip(own, ys) if f in o)
        ratio = math.log((a + 1) / (ones + 2)) - math.log((b + 1) / (n - ones + 2))
        apart = abs(a / (ones + 1) - b / (n - ones + 1))
        scale[f] = math.sqrt(3 * apart) * min(3, max(0, abs(ratio) - 1)) * (a + b >= 5)
    for f in set().union(*(t for t in twins if t)):
        scale[f] = max(scale[f], 0.5)
    w, b = dict.fromkeys(used, 0.0), 0.0
    m, v, mb, vb = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0), 0.0, 0.0
    p_of = lambda fs: 1 / (1 + math.exp(-(b + sum(w[f] * scale[f] for f in fs))))
    for t in range(1, steps + 1):
        g, gb = collections.defaultdict(float), 0.0
        for o, twin, y in zip(own, twins, ys):
            p = p_of(o)
            d = (p - y) / n
            if twin is not None:
                q = p_of(twin)
                gap = 2 * pull * (p - q) / n
                d += gap * p * (1 - p)
                gb -= gap * q * (1 - q)
                for f in twin:
                    g[f] -= gap * q * (1 - q) * scale[f]
            gb += d
            for f in o:
                g[f] += d * scale[f]
        step = 0.2 / math.sqrt(t) if t > 100 else 0.02
        for f in used:
            d = g[f] + x.L2 * w[f]
            m[f], v[f] = 0.9 * m[f] + 0.1 * d, 0.999 * v[f] + 0.001 * d * d
            w[f] -= step * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        b -= step * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return {f: w[f] * scale[f] for f in used}, b


@pytest.mark.parametrize("pull", [0.0, 4.0])
def test_training_and_scores_against_plain_loops(spark, pull):
    rows = labelled(spark, 160)
    pairs = [(r.text, r.label) for r in rows.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").collect()]
    want, bias = plain_training(pairs, pull)
    weights, got_bias = x.train(rows, pull=pull)
    assert got_bias == pytest.approx(bias, abs=1e-4)
    assert set(np.flatnonzero(weights)) <= set(want) and all(weights[f] == pytest.approx(v, abs=1e-3) for f, v in want.items())
    scored = {r.doc_id: r.score for r in x.score_texts(rows, weights, got_bias).collect()}
    for r in rows.collect():
        z = bias + sum(want[f] for f in plain_features(r.text)[0])
        assert scored[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_contradicting_labels_and_repeated_ids(spark, tmp_path):
    """Of labels of one document the higher one counts, whatever their order;
    held-out rows teach nothing."""
    base = labelled(spark, 300)
    kept = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]

    def scores(name, labels):
        base.select("doc_id", "text").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        return {r.doc_id: round(r.score, 6) for r in x.op10_toxicity(spark, str(tmp_path / name)).collect()}

    plain = [(r.doc_id, 1, r.label) for r in base.collect()]
    extra = [(i, 0, 0) for i in kept[:40]] + [(None, 0, 1), (kept[0], 0, None)] + [(i, 0, 1 - y) for i, _, y in plain if i not in kept]
    assert scores("a", plain) == scores("b", extra + plain)
