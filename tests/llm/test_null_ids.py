"""Rows without an id go through every operator that reads ids."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from guardspark.llm import bpe, exact_dedup, simhash, toxicity, weak_quality
from guardspark.llm import token_files as t
from guardspark.llm.scratch import Scratch
from tests.llm.cases import nameless


def both(got, want):
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, want))


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rows = Tokenizer.from_file(path), nameless(spark)
    files = t.write_tokens(rows, Scratch(spark), path)
    got = t.read_tokens(files).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    both([(r.doc_id, crc(r.ids)) for r in got], [(r.doc_id, crc([*tok.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in rows.collect()])
    spans = sorted((r.start, len(r.ids)) for r in got)
    assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, rows = Tokenizer.from_file(path), nameless(spark)
    got = bpe.encode_decode(rows.withColumn("ids", F.lit("x")), path).collect()
    both([(r.doc_id, r.ids, r.decoded) for r in got], [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in rows.collect()])


def test_quality_and_toxicity(spark):
    rows = nameless(spark)
    judged = weak_quality.judge(rows).collect()
    both([(r.doc_id, r.text) for r in judged], [(r.doc_id, r.text) for r in rows.collect()])
    scores = toxicity.score_texts(rows, np.zeros(toxicity.DIM), -1.0).collect()
    both([r.doc_id for r in scores], [r.doc_id for r in rows.collect()])


def test_exact_dedup(spark):
    got = exact_dedup.exact_groups(nameless(spark)).where("doc_id IS NULL").collect()
    assert collections.Counter((r.keep_id, r.group_size, r.kept) for r in got) == {(None, 2, True): 1, (None, 2, False): 1, (0, 4, False): 2, (None, 1, True): 1}


def test_fingerprints_and_components(spark):
    """An id that is missing counts after all others in a component."""
    rows = nameless(spark)
    least = collections.defaultdict(list)
    for r in rows.collect():
        least[simhash.fingerprint(r.text)].append(r.doc_id)
    got = simhash.near_copies(rows).collect()
    both([(r.doc_id, r.fp) for r in got], [(r.doc_id, simhash.fingerprint(r.text)) for r in rows.collect()])
    for r in got:
        alike = [i for f, ids in least.items() if bin((f ^ r.fp) % 2**64).count("1") <= 3 for i in ids if i is not None]
        assert (r.component_id is None and not alike) or r.component_id <= min(alike, default=r.component_id)
