import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from guardspark.llm import bpe
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\r\n", "'s", "'", "don't", "!?", "<|endoftext|>", "é", " ", "　", "\x1c", "12", "漢", "🙂", "́", " ", "\x85", "Ⅷ", "²"]) | st.characters(exclude_categories=["Cs"]), max_size=14).map("".join))
def test_units_give_the_library_ids(text):
    import re

    units = bpe.units_of(text, re.compile(r"(<\|endoftext\|>)"))
    assert "".join(units) == text
    assert [i for u in units for i in TOK.encode(u, add_special_tokens=False).ids] == TOK.encode(text, add_special_tokens=False).ids


def test_pieces_decode():
    table = bpe.pieces(open(PATH, encoding="utf-8").read())
    ids = TOK.encode("naïve 漢字 <|endoftext|> 🙂", add_special_tokens=False).ids
    assert b"".join(table[i] for i in ids).decode() == TOK.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(("chunk", "bucket"), [(bpe.CHUNK, bpe.BUCKET), (30_000, bpe.BUCKET), (100_000, 10_000)])
def test_whole_table(spark, sf, chunk, bucket, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "BUCKET", bucket)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op3_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = TOK.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(TOK.decode(ids, skip_special_tokens=False)))


def test_awkward_rows(spark):
    rows = awkward(spark)
    got = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.encode_decode(rows, PATH).collect())
    assert got == sorted((r.doc_id, TOK.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in rows.collect())
    assert bpe.encode_decode(empty(spark), PATH).count() == 0
