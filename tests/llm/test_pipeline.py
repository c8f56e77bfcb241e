import collections
import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from guardspark.llm import decontaminate, weak_quality
from tests.llm.cases import awkward
from tests.llm.test_decontaminate import plain_tile
from tests.llm.test_near_text import brute

BLANK = " \t\n\x0b\x0c\r"


def dedup_lines(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    held = collections.defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    return {i: "\n".join(x for x in t.split("\n") if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != i)) for i, t in docs.items()}


def test_whole_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in weak_quality.judge(docs).where("kept").collect()}
    kept = dedup_lines(kept)
    first = brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if first[i] == i}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        w = decontaminate.words_of(text)
        seeds = set(decontaminate.windows(w, 5))
        return any(seeds & set(decontaminate.windows(v, 5)) and sum(t[2] for t in plain_tile(list(v), list(w), 5)) >= 0.6 * len(v) for v in items)

    kept = {i: t for i, t in kept.items() if not leaks(t)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == kept.keys() and 50 < len(got) < docs.count()
    for i, t in kept.items():
        assert got[i].ids == tok.encode(t, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns_and_take_awkward_rows(spark, sf):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
