import numpy as np
import pytest

from guardspark.llm import simhash
from tests.llm.cases import awkward, empty


def brute(docs, words=3, bits=3):
    fp = {i: simhash.fingerprint(t, words) for i, t in docs}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array([fp[i] for i in ids])
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count((arr ^ arr[k]).view(np.uint64)) <= bits):
            a, b = sorted((find(i), find(ids[j])))
            root[b] = a
    return {i: (fp[i], find(i)) for i in ids}


def test_fingerprint_by_definition():
    import xxhash

    text = "The CAT sat\ton the mat\nThe cat sat"
    tokens = "the cat sat on the mat the cat sat".split()
    h = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + 3]).encode(), 42) for i in range(7)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 7)
    assert simhash.fingerprint(text) % 2**64 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") % 2**64 == xxhash.xxh64_intdigest(b"a b", 42)


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(7)
    for f in rng.integers(-(2**63), 2**63 - 1, 300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        pair = np.array([int(f) % 2**64, int(f) % 2**64 ^ flips], np.uint64).view(np.int64)
        at, keys = simhash.fuzzy_keys(pair)
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_long_runs_link_as_short_ones():
    rng = np.random.default_rng(3)
    fp = np.unique(np.bitwise_or.reduce(1 << rng.integers(0, 12, (400, 2)), axis=1)).astype(np.int64)
    a, b = simhash._links(np.zeros(len(fp), np.int64), fp, 3)
    assert len(fp) > simhash.RUN and len(a) == len(fp) - 1  # one component, spanned once


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert got == want
    assert any(c != i for i, (_, c) in got.items())


def test_awkward_rows(spark):
    docs = awkward(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.fp, r.component_id) for r in rows} == want
    assert simhash.near_copies(empty(spark)).count() == 0


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_copies(empty(spark), bits=4)


def test_three_kinds_of_keys_find_two_bits():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 40, np.int64)
    for f in fp:
        pairs = [(i, j) for i in range(64) for j in range(i, 64)]
        others = np.array([f ^ np.int64(np.uint64((1 << i) | (1 << j)).view(np.int64)) for i, j in pairs], np.int64)
        own = set(simhash.fuzzy_keys(np.array([f]), 2)[1].tolist())
        at, keys = simhash.fuzzy_keys(others, 2)
        assert set(at[np.isin(keys, list(own))].tolist()) == set(range(len(others)))
        assert len(own) <= 18
