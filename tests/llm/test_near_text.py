import random

import corpus_pipeline
from guardspark.llm import near_text
from tests.llm.cases import awkward, empty


def plain_sets(docs):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(docs):
    """Smallest id of each component of pairs with Jaccard 0.8 or more."""
    sets = plain_sets(docs)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in ids}


def varied(n=40, words=200):
    """Texts, each with copies of which some words differ."""
    rng, out = random.Random(1), []
    for k in range(n):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        out.append(" ".join(w))
        for changes in (1, 2, 4, 9):
            v = list(w)
            for at in rng.sample(range(words), changes):
                v[at] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(v))
    return list(enumerate(out))


def test_the_stage_finds_near_copies(spark, sf):
    docs = varied()
    want = brute(docs)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
    assert got == {i for i, c in want.items() if c == i}
    assert 40 <= len(got) < 100


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in near_text.near_texts(docs).collect()}
    assert got == want and any(c != i for i, c in got.items())


def test_long_runs_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_text, "RUN", 2)
    rng = random.Random(2)
    w = [f"w{k}" for k in range(150)]
    docs = []
    for i in range(30):  # a chain: each text drifts away from the first
        w[rng.randrange(150)] = f"y{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_text.near_texts(df).collect()} == brute(docs)


def test_golay_keys_alone_find_close_copies(spark, sf, monkeypatch):
    """Long texts of which a word or two differ are linked by their SimHashes,
    before any minima are compared; what is less similar is left to these."""
    docs = varied(8, 1500)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    whole = {r.doc_id: r.component_id for r in near_text.near_texts(df).collect()}
    assert whole == brute(docs)
    asked, candidates = [], near_text._candidates
    monkeypatch.setattr(near_text, "_candidates", lambda rows, s: asked.append(candidates(rows, s).count()) or candidates(rows, s).limit(0))
    some = {r.doc_id: r.component_id for r in near_text.near_texts(df).collect()}
    linked = [i for i, c in some.items() if c != i]
    assert len(linked) >= 12 and all(whole[i] == whole[some[i]] for i in linked)
    # Pairs linked so are not compared again: all pairs of the groups are 80.
    assert asked[0] < 60


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = near_text.near_texts(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.component_id for r in rows} == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert near_text.near_texts(empty(spark)).count() == 0
