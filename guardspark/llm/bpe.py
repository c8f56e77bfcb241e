"""Byte-level BPE with a table of distinct words.

Texts are split once into units: a word with the one space before it, or a run
of white space.  No piece of the tokenizer's own splitting crosses a unit, so a
unit's ids are the same wherever it stands.  Each task codes its documents as
places in a list of its distinct units and sends the list out by hash bucket;
in a bucket every distinct unit is encoded once, whatever the number of tasks
that hold it; the ids come back and are put in their positions.  What is
shuffled are distinct units of a task and coded documents, both compressed,
never occurrences of words.  The texts are read twice, for the lists and for
the documents; a checksum of the lists makes sure that both reads agree, so an
input that is not the same at every read must be written to a table first.
Their bytes are summed before, which sets the number of buckets.
Decoding looks up each id in the table of pieces,
unit by unit, and joins them in order.

Defined results: a null text has no ids and decodes to an empty text; texts
keep every byte; repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.llm.scratch import lean, lean_group, shuffle_width

#: White space of the tokenizer's patterns, as a class.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Characters of text that a task codes with one list of units.
CHUNK = 8_000_000
#: Bytes of text for each hash bucket, so that buckets grow in number with the
#: input and not in size.
BUCKET = 32_000_000
#: Between units in a list; it is no byte of UTF-8.
END = b"\xff"


@lru_cache(1)  # a worker parses a tokenizer once
def load(source: str):
    """A tokenizer from its JSON, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(source)
    t.no_truncation()
    t.no_padding()
    return t


def special_tokens(source: str) -> list[str]:
    """Tokens that are cut out of a text before it is split."""
    added = json.loads(source)["added_tokens"]
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that change their surroundings are not supported")
    return [t["content"] for t in added]


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level pieces:
    printable Latin-1 stands for itself, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def pieces(source: str) -> list[bytes]:
    """The bytes of each id."""
    model, of = json.loads(source), byte_of_char()
    names = dict(model["model"]["vocab"]) | {t["content"]: t["id"] for t in model["added_tokens"]}
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(of[c] for c in name)
    return out


def units_of(text: str, specials: re.Pattern | None) -> list[str]:
    """The units of a text; special tokens stand alone."""
    if specials is None or not specials.search(text):
        return UNITS.findall(text)
    out = []
    for part in specials.split(text):
        out += [part] if specials.fullmatch(part) else UNITS.findall(part)
    return out


def _pack(a: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else a.tobytes())


def _unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


CODED = "chunk string, bucket int, docs array<{id}>, counts array<int>, data binary, lens binary, check long"
NAMES = ["chunk", "bucket", "docs", "counts", "data", "lens", "check"]


class _Places(dict):
    """A number for each unit, in the order of their first use."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def _coder(id_type: pa.DataType, buckets: int, specials: list[str], lists: bool):
    """Chunks of documents: their lists of distinct units by bucket, or the
    documents as places in those lists (bucket -1).  Both passes see the same
    rows in the same order; ``check`` tells if they did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        part, n_chunks = TaskContext.get().partitionId(), 0
        new_place = set if lists else _Places
        docs, counts, codes, size, place = [], [], [], 0, new_place()

        def flush() -> pa.RecordBatch:
            names = sorted(place)
            units = [u.encode() for u in names]
            bucket = np.fromiter(map(zlib.crc32, units), np.int64, len(units)) % buckets
            order = np.argsort(bucket, kind="stable")
            check = zlib.crc32(b"".join(units))
            if lists:
                used, first = np.unique(bucket[order], return_index=True)
                data = [_pack(END.join([units[i] for i in order[a:b].tolist()])) for a, b in zip(first, [*first[1:], len(order)][: len(first)], strict=True)]
                own, n_units = None, None
            else:
                new = np.empty(len(units), np.uint32)
                new[np.fromiter(map(place.__getitem__, names), np.int64, len(names))[order]] = np.arange(len(units), dtype=np.uint32)
                coded = new[np.concatenate(codes)] if codes else new
                # Bytes of one rank stand together: the higher ones are nearly all alike.
                used, data, own, n_units = [-1], [_pack(coded.view(np.uint8).reshape(-1, 4).T.copy())], docs, counts
            n = len(data)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{n_chunks}"] * n),
                    pa.array(used, pa.int32()),
                    pa.array([own] * n, pa.list_(id_type)),
                    pa.array([n_units] * n, pa.list_(pa.int32())),
                    pa.array(data, pa.binary()),
                    pa.nulls(n, pa.binary()),
                    pa.array([check] * n, pa.int64()),
                ],
                names=NAMES,
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                units = units_of(text, cut)
                if lists:
                    place.update(units)
                else:
                    codes.append(np.fromiter(map(place.__getitem__, units), np.uint32, len(units)))
                    counts.append(len(units))
                docs.append(i)
                size += len(text)
                if size >= CHUNK:
                    yield flush()
                    n_chunks += 1
                    docs, counts, codes, size, place = [], [], [], 0, new_place()
        if docs:
            yield flush()

    return run


def _encoder(source):
    """All lists of a bucket: each distinct unit is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        tok = load(source.value)
        code = "H" if tok.get_vocab_size() <= 1 << 16 else "I"
        lists = [_unpack(x.as_py()).split(END) for x in table.column("data")]
        distinct = list(set().union(*lists))
        ids, lens = {}, {}
        for k in range(0, len(distinct), 2048):
            part = distinct[k : k + 2048]
            for u, e in zip(part, tok.encode_batch_fast([u.decode() for u in part], add_special_tokens=False), strict=True):
                x = e.ids
                ids[u], lens[u] = array(code, x).tobytes(), len(x)
        back = [_pack(b"".join([ids[u] for u in units])) for units in lists]
        sizes = [_pack(np.array([lens[u] for u in units], np.uint32)) for units in lists]
        new = {"data": pa.array(back, pa.binary()), "lens": pa.array(sizes, pa.binary())}
        return pa.table([new.get(c, table.column(c)) for c in NAMES], names=NAMES)

    return run


def _assembler(id_type: pa.DataType, id_col: str, source):
    """A chunk's documents from the ids of its units."""

    def run(table: pa.Table) -> pa.Table:
        piece = pieces(source.value)
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        doc, lists = rows[0], rows[1:]
        if doc["bucket"] >= 0 or any(r["check"] != doc["check"] for r in lists):
            raise ValueError("the input's rows or their order changed between two reads; write it to a table first")
        flat = np.frombuffer(b"".join(_unpack(r["data"]) for r in lists), np.uint16 if len(piece) <= 1 << 16 else np.uint32).astype(np.int32)
        lens = np.frombuffer(b"".join(_unpack(r["lens"]) for r in lists), np.uint32).astype(np.int64)
        ends = np.cumsum(lens)
        starts = ends - lens
        by_id = [piece[i] for i in flat.tolist()]
        decoded = [b"".join(by_id[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        codes = np.frombuffer(_unpack(doc["data"]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
        n = lens[codes]
        to = np.cumsum(n)
        ids = flat[np.arange(to[-1] if len(to) else 0) - np.repeat(to - n - starts[codes], n)]
        edge = np.concatenate([[0], np.cumsum(doc["counts"])]).astype(np.int64)
        offsets = np.concatenate([[0], to])[edge]
        texts = [b"".join([decoded[c] for c in codes[a:b].tolist()]).decode(errors="replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table([pa.array(doc["docs"], id_type), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return run


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` for every row, as the
    byte-level tokenizer at ``path`` encodes and decodes it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spark = df.sparkSession
    source = spark.sparkContext.broadcast(text)  # the tokenizer's own file
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, kind = to_arrow_type(df.schema[id_col].dataType), df.schema[id_col].dataType.simpleString()
    schema = CODED.format(id=kind)
    texts, specials = df.select(id_col, text_col), special_tokens(text)
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(shuffle_width(spark), size // BUCKET + 1)
    lists = texts.mapInArrow(lean(_coder(id_type, buckets, specials, True)), schema).groupBy("bucket").applyInArrow(lean_group(_encoder(source)), schema)
    chunks = texts.mapInArrow(lean(_coder(id_type, buckets, specials, False)), schema).unionByName(lists)
    return chunks.groupBy("chunk").applyInArrow(lean_group(_assembler(id_type, id_col, source)), f"{id_col} {kind}, ids array<int>, decoded string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
