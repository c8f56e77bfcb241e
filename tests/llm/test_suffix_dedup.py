import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from guardspark.llm import suffix_dedup as d
from tests.llm.cases import awkward, empty


def plain(texts, length):
    """Removed runs of each text by a table of all windows."""
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), edges[::2].tolist(), edges[1::2].tolist()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=20).map(lambda b: bytes(x % 3 for x in b)), max_size=20).map(sorted), min_size=1, max_size=6))
def test_merge_gives_the_sorted_order(runs):
    coded = [d.decode_run(*d.front_code(r)) for r in runs]
    at, got = [0] * len(runs), []
    for k, shared in d.merge_runs(coded):
        s = runs[k][at[k]]
        at[k] += 1
        assert shared == (d.shared_prefix(got[-1], s) if got else 0)
        got.append(s)
    assert got == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(("dense", "step", "part"), [(d.DENSE, d.STEP, d.PART), (3, 5, 10), (1, 24, 40)])
def test_small_alphabet_against_brute_force(spark, monkeypatch, dense, step, part):
    monkeypatch.setattr(d, "DENSE", dense)
    monkeypatch.setattr(d, "STEP", step)
    monkeypatch.setattr(d, "PART", part)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            b = rng.choice(base)
            i, j = sorted((rng.randint(0, 60), rng.randint(0, 60)))
            parts.append(rng.choice([b[i:j], b[i:j], "".join(rng.choice("abxyz") for _ in range(rng.randint(1, 15))), rng.choice(["ab", "a", "abc"]) * rng.randint(1, 20), "é漢"]))
        texts.append("".join(parts))
    want = plain([t.encode() for t in texts], 24)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.starts, r.ends) for r in d.remove_repeats(docs, length=24, gram=6).collect()}
    assert sum(len(w[1]) for w in want) > 40
    assert [got[i] for i in range(len(texts))] == want


def test_a_passage_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(d, "DENSE", 8)
    monkeypatch.setattr(d, "STEP", 6)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghijkl") for _ in range(46))
    own = lambda k: "".join(rng.choice("mnopqrst") for _ in range(k))
    # 46, and with neighbours in common 48 or more, of 48 bytes.
    texts = [own(30) + rng.choice(["", "u", "vw"]) + passage + rng.choice(["", "x", "yz"]) + own(30) for _ in range(90)]
    want = plain([t.encode() for t in texts], 48)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.starts, r.ends) for r in d.remove_repeats(docs, length=48, gram=8).collect()}
    assert 0 < sum(bool(w[1]) for w in want) < len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_whole_table_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(d, "PIECE", 5_000)
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, plain(list(docs.values()), 400), strict=True))
    got = d.op1_suffix_dedup(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) > 0
    for r in got:
        kept, starts, _ = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(docs[r.doc_id]), len(docs[r.doc_id]) - len(kept), len(starts), hashlib.sha256(kept).hexdigest())


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = docs.collect()
    want = plain([(r.text or "").encode() for r in rows], 30)
    got = sorted((r.doc_id, bytes(r.kept), r.starts, r.ends) for r in d.remove_repeats(docs, length=30, gram=8).collect())
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    assert d.remove_repeats(empty(spark)).count() == 0


def test_rows_without_an_id_are_judged_by_their_own_text(spark):
    a, b = "a" * 7 + "".join(chr(97 + i * i % 26) + str(i) for i in range(200)), "".join(chr(97 + i * 7 % 26) + str(3 * i) for i in range(220))
    df = spark.createDataFrame([(None, a), (None, b), (None, "x" + a)], "doc_id long, text string")
    got = {r.n_bytes: r.n_bytes - len(r.kept) for r in d.remove_repeats(df).collect()}
    assert got == {len(a): len(a), len(b): 0, len(a) + 1: len(a)}
