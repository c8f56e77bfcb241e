import random

import numpy as np

from guardspark.llm import decontaminate as d
from tests.llm.cases import awkward, empty


def plain_tile(item, text, least):
    """Greedy string tiling by looking at every pair of places."""
    ui, ut, tiles = set(), {k for k, x in enumerate(text) if not x}, []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and i + k not in ui and t + k not in ut:
                    k += 1
                if k > best:
                    best, found = k, [(i, t)]
                elif k == best and k >= least:
                    found.append((i, t))
        if best < least:
            return tiles
        for i, t in found:
            if not (ui & set(range(i, i + best)) or ut & set(range(t, t + best))):
                ui |= set(range(i, i + best))
                ut |= set(range(t, t + best))
                tiles.append((i, t, best))


def test_tiles_against_plain_tiling():
    rng = random.Random(5)
    for _ in range(200):
        item = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 25))], np.int64)
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 40))], np.int64)
        assert sorted(d.tile(item, text, 3)) == sorted(plain_tile(list(item), list(text), 3))


def plain(docs, items, coverage=d.COVERAGE):
    out = set()
    for i, t in docs:
        w = d.words_of(t)
        for k, x in items:
            v = d.words_of(x)
            if len(v):
                n = min(d.SEED_WORDS, len(v))
                if set(d.windows(w, n)) & set(d.windows(v, n)):
                    if sum(y[2] for y in plain_tile(list(v), list(w), n)) / len(v) >= coverage:
                        out.add((i, k))
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.contamination(docs, items).collect()}
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 20_000]
    assert got and {x for x in got if x[0] in dict(short)} == plain(short, [(r.item_id, r.text) for r in items.collect()])


def test_reordered_and_partial(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(0, " ".join(words)), (1, None), (2, " , "), (3, "just three words")], "item_id long, text string")
    texts = [
        "before " + " ".join(words[20:] + words[:20]) + " after",  # reordered
        "x " + " ".join(words[:20]) + " y",  # half of it
        " ".join(reversed(words)),
        "W0, " + " ".join(words[1:]).upper(),
        "there are just three words here",
    ]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(0, texts[0], "a")], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in d.contamination(docs, items).collect())
    assert got == [(0, 0, 1.0), (0, 0, 1.0), (3, 0, 1.0), (4, 3, 1.0)]


def test_items_that_share_an_id_or_have_none(spark):
    texts = ["one two three four five six", "red green blue pink grey brown", "mon tue wed thu fri sat"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in d.contamination(docs, items).orderBy("doc_id").collect()]
    assert got == [(0, 1), (1, 1), (2, None)]


def test_awkward_rows(spark):
    items = spark.createDataFrame([(0, "this line stands in several documents and is long enough")], "item_id long, text string")
    got = sorted(r.doc_id for r in d.contamination(awkward(spark), items).collect())
    assert got == [7, 7, 7, 8, 9, 11]
    assert d.contamination(empty(spark), items).count() == 0
    assert d.contamination(awkward(spark), items.limit(0)).count() == 0
