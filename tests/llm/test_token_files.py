import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from guardspark.llm import token_files as t
from guardspark.llm.scratch import Scratch
from tests.llm.cases import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kind", ["one", "equal", "random", "skewed", "repeating", "wide"])
def test_segments_round_trip(kind, monkeypatch):
    monkeypatch.setattr(t, "LANES", 6)
    rng = np.random.default_rng(2)
    ids = {
        "one": np.array([7]),
        "equal": np.full(9_000, 49_407),
        "random": rng.integers(0, 300, 20_011),
        "skewed": np.minimum(rng.geometric(0.02, 17_000), 5_000),
        "repeating": np.tile(rng.integers(0, 50_000, 700), 40),
        "wide": rng.permutation(49_408),
    }[kind]
    lengths = np.array([1, len(ids) - 1]) if len(ids) > 1 else np.array([1])
    data = t.encode_segment(ids.astype("<u4"), lengths)
    back, lens = t.decode_segment(data)
    assert (back == ids).all() and (lens == lengths).all()
    if kind == "repeating":
        assert len(data) < 2 * len(ids)


def test_damage_is_found():
    data = bytearray(t.encode_segment(np.arange(3000, dtype="<u4") % 90, np.array([3000])))
    data[-20] ^= 4
    with pytest.raises(ValueError):
        t.decode_segment(bytes(data))
    with pytest.raises(ValueError):
        t.decode_segment(b"nothing")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "'s", "DON'T", "!?", "<|endoftext|>", "É", " ", "\x1c", "12", "漢", "🙂", "́", "Σ", "İ", "ß"]) | st.characters(exclude_categories=["Cs"]), max_size=12).map("".join))
def test_word_memory_gives_the_library_ids(text):
    (got,) = t.Encoder(open(PATH, encoding="utf-8").read(), 1).batch([text])
    assert np.frombuffer(got, "<u4").tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 1]


def want(rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in t.op2_token_files(spark, sf).collect())
    assert got == want([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    rows = awkward(spark)
    files = t.write_tokens(rows, Scratch(spark), PATH)
    got = sorted((r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in t.read_tokens(files).collect())
    assert got == want([(r.doc_id, r.text) for r in rows.collect()])
    assert t.read_tokens(t.write_tokens(empty(spark), Scratch(spark), PATH)).count() == 0


def test_frequent_pieces_are_coded_in_one_step_and_asked_for_once():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("bcdgklmnprst"), 9)) for _ in range(200)]
    texts = [" ".join(w.title() + "," if k % 3 else w for k, w in zip(rng.integers(0, 9, 400), rng.choice(words, 400), strict=True)) for _ in range(40)]
    encoder = t.Encoder(open(PATH, encoding="utf-8").read(), 1)
    ids = encoder.batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [[*TOK.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert len(encoder.known) <= len(words) + 2  # not once more for each way of writing a word
    numbers, (first, flat) = encoder.numbers(texts), encoder.spelling()
    data = t.encode_pieces(np.concatenate(numbers), first, flat, np.array([len(x) // 4 for x in ids]))
    back, lengths = t.decode_segment(data)
    assert back.tobytes() == b"".join(ids) and lengths.sum() == len(back)
    assert int.from_bytes(data[20:24], "little") < 0.5 * len(back)  # symbols, each one step of the coder


def test_a_worker_keeps_the_pieces_that_come_again(monkeypatch):
    encoder = t.Encoder(open(PATH, encoding="utf-8").read(), 1)
    one, two = encoder.batch(["one two one two", "it's 12 é! <|endoftext|> \x1c漢 Σας"])
    encoder.keep(np.array([encoder.known["two"], encoder.known["one"]]))
    assert len(encoder.known) == 2
    assert encoder.batch(["one two one two", "it's 12 é! <|endoftext|> \x1c漢 Σας"]) == [one, two]
    monkeypatch.setattr(t, "REMEMBERED", 1)
    encoder.keep(np.arange(2))
    assert not encoder.known and encoder.batch(["one two one two"]) == [one]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'stmdrevl 0.Éß×ÿ\n<|>")), max_size=40), max_size=4))
def test_plain_text_is_split_as_by_the_pattern(texts):
    p, n, ends, buf = t.split_plain(texts)
    got = [bytes(buf[i : i + k]).decode("latin-1") for i, k in zip(p.tolist(), n.tolist(), strict=True)]
    want = [t.PIECES.findall(x.lower()) for x in texts]
    assert got == [w for x in want for w in x]
    assert ends.tolist() == np.cumsum([len(x) for x in want], dtype=int).tolist()


@pytest.mark.parametrize("together", [1 << 21, 700, 1])
def test_pieces_of_every_length_keep_their_ids(together, monkeypatch):
    monkeypatch.setattr(t, "TOGETHER", together)
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(rng.choice(list("ab"), k)) for k in rng.integers(1, 40, 60)) for _ in range(30)]
    encoder = t.Encoder(open(PATH, encoding="utf-8").read(), 1)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(texts)] == [[*TOK.encode(x, add_special_tokens=False).ids, 1] for x in texts]
