import numpy as np
from pyspark.sql import functions as F

from guardspark.llm import weak_quality as q
from tests.llm.cases import awkward, empty


def test_em_finds_the_careless_labeller():
    rng = np.random.default_rng(0)
    n = 6000
    bad = rng.random(n) < 0.2
    votes = np.ones((n, q.N), np.int64)
    for i, (hit, false) in enumerate(((0.95, 0.001), (0.9, 0.002), (0.6, 0.04))):
        votes[:, i] = np.where(rng.random(n) < np.where(bad, hit, false), 2, 1)
    code = votes @ (3 ** np.arange(q.N - 1, -1, -1))
    patterns, at, counts = np.unique(code, return_inverse=True, return_counts=True)
    good, accuracy = q.expectation_maximisation(patterns, counts)
    assert ((good[at] < 0.5) == bad).mean() > 0.97
    names = list(q.DEFECTS["symbols"])
    assert accuracy[names[0]][0] > accuracy[names[2]][0] + 0.2
    assert (good[at][votes.max(axis=1) == 1] > 0.9).all()


def test_against_hand_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in q.op5_weak_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([got[i] for i, y in truth.items() if y]) > 0.99
    assert np.mean([not got[i] for i, y in truth.items() if not y]) > 0.9


def test_awkward_rows(spark):
    rows = q.judge(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    assert {r.doc_id for r in rows if r.doc_id in (0, 1, 2) and not r.kept and r.quality_score == 0} == {0, 1, 2}
    assert q.judge(empty(spark)).count() == 0


def plain_em(votes, counts, steps):
    """P(sound) of each pattern of one defect, by plain loops."""
    rows, labellers = len(votes), len(votes[0])
    sound = [1 / (1 + np.exp(-(sum(v == 1 for v in row) + 1.0 - 2.0 * sum(v == 2 for v in row)))) for row in votes]
    for _ in range(steps):
        chance = {}
        for i in range(labellers):
            for c, (low, high) in enumerate(((q.TRUE, 1.0), (0.0, q.FALSE))):
                seen = [0.1, 0.1, 0.1]
                for p in range(rows):
                    seen[votes[p][i]] += counts[p] * (sound[p] if c else 1 - sound[p])
                share = [x / sum(seen) for x in seen]
                bad = min(max(share[2], low), min(high, 1 - 1e-6))
                others = max(1 - share[2], 1e-12)
                chance[i, c] = [share[0] * (1 - bad) / others, share[1] * (1 - bad) / others, bad]
        prior = [1 + sum(n * (1 - s) for n, s in zip(counts, sound)), 1 + sum(n * s for n, s in zip(counts, sound))]
        for p in range(rows):
            odds = np.log(prior[1]) - np.log(prior[0])
            for i in range(labellers):
                odds += np.log(max(chance[i, 1][votes[p][i]], 1e-12)) - np.log(max(chance[i, 0][votes[p][i]], 1e-12))
            sound[p] = 1 / (1 + np.exp(-odds))
    return sound


def test_em_against_plain_loops():
    rng = np.random.default_rng(3)
    patterns = rng.choice(3**q.N, 60, replace=False)
    counts = rng.integers(1, 500, 60)
    good, _ = q.expectation_maximisation(patterns, counts, steps=8)
    votes, want, at = q.votes_of(patterns).tolist(), np.ones(60), 0
    for group in q.DEFECTS.values():
        want *= plain_em([v[at : at + len(group)] for v in votes], counts.tolist(), 8)
        at += len(group)
    assert np.allclose(good, want, atol=1e-9)


def test_votes_sample_and_scores_by_hand(spark, sf):
    """Patterns counted, sample drawn and scores made without Spark."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("mine").alias("measured"))
    words = q._Words()
    by_hand = {r.doc_id: q.measure(r.text, words) for r in docs.collect()}
    read, name = q.measured(docs)
    assert name != "measured" and {r.measured for r in read.collect()} == {"mine"}
    assert {r.doc_id: r.pattern for r in read.select("doc_id", f"{name}.pattern").collect()} == {i: q.pattern(m) for i, m in by_hand.items()}
    model = q.train(read, name)
    for r in read.select("doc_id", q.score(read, name, model).alias("score")).collect():
        places, values = q.features(by_hand[r.doc_id])
        want = 1 / (1 + np.exp(-(model.bias + sum(model.weights[p] * v for p, v in zip(places, values))))) if by_hand[r.doc_id].n else 0.0
        assert abs(r.score - want) < 1e-5
    assert {"measured", "quality_score", "kept"} <= set(q.judge(docs).columns)
