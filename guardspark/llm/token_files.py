"""Token-id files, coded by an adaptive context-mixing range coder.

Ids of consecutive documents form a segment.  Its symbols are ids and units: a
unit is a piece of text that is frequent in the segment, with all its ids.
Three orders predict the next symbol: the last one seen after the same two
symbols, the last seen after the same one, and the segment's frequencies.
Confidence counters give each order's chance to be right; a logistic mixture,
gated by the confidence of order 2, turns them into the probability of the
order-2 prediction, what is left goes to the order-1 prediction and to the
frequencies, and one range-coder step codes the symbol.  Counters and weights
are learned on the way.  All arithmetic is on integers, so every machine
decodes alike.

The symbols are cut into up to ``LANES`` blocks that are coded in step, as lanes
of arrays, which is what makes an adaptive coder feasible in numpy.  Lanes share
predictions, counters and weights, so all learn from each.  What the mixture
gives depends on few numbers (two confidences, whether both orders agree, the
order of magnitude of a frequency), so it is kept as a table of all of them,
made anew from counters and weights after every ``LEARN`` symbols.

A segment's bytes: ``GSTK``, version, block size, numbers of documents, ids,
symbols and blocks, CRC-32 of the frames (little-endian, 32 bits each), five
zstd frames (ids of the symbols, how many ids each has, how often it occurs,
document lengths, CRC-32 of each ``CHECKED`` symbols) with their sizes, the
directory (for each block the number of its bytes and their CRC-32) and the
blocks.

Defined results: null and empty texts give the end id alone; documents are
written in ascending id, null ids first; repeated rows are written again;
further columns are dropped; an empty table gives no segment.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardspark.llm.bpe import load, special_tokens
from guardspark.llm.scratch import Scratch, lean, shuffle_width

LANES = 4096
#: Symbols in a block at least, and ids in a segment about.
LEAST_BLOCK, SEGMENT = 1024, 512 * 16_384
#: Occurrences that make a piece a unit, and units of a segment at most.
LEAST_UNIT, UNITS = 4, 60_000
#: Bits of the frequencies, of the mixture and of the order-2 table.
T0, SEL, ORDER2 = 19, 12, 18
#: Symbols after which counters, weights and the mixture follow.
LEARN = 32_768
#: Symbols under one checksum.
CHECKED = 1 << 16
END_ID = 1
REMEMBERED = 400_000
#: Characters of plain texts that are split at once, besides a longer text.
TOGETHER = 1 << 21
MAGIC = b"GSTK"


def _logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: 4096 values of the logistic function at -2047..2048 in steps of
    1/256; stretch: its inverse."""
    x = np.arange(-2048, 2048)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x / 256.0))), 1, 4095).astype(np.int64)
    stretch = np.searchsorted(squash, np.arange(4096)).astype(np.int64) - 2048
    return squash, np.clip(stretch, -2047, 2047)


SQUASH, STRETCH = _logistic_tables()
#: A context of the mixture: magnitude of the frequency and confidence of the
#: order-2 prediction, confidence of the order-1 prediction, agreement.
_C = np.arange(1 << 13)
MAGNITUDE, Q2, Q1, AGREE = _C >> 9, _C >> 5 & 15, _C >> 1 & 15, (_C & 1).astype(bool)
CHANCE = STRETCH[np.clip((3 << (np.arange(16) + 2)) >> (T0 - 12), 1, 4095)][MAGNITUDE]
#: Change of a confidence, missed (first 16) or hit.
CHANGE = np.concatenate([-(np.arange(16) - (np.arange(16) >> 1)), np.arange(16) < 15]).astype(np.int64)
NOTHING = -256


class _Model:
    """The state that all lanes share, and the last symbols of each.  A
    prediction, its magnitude and its confidence share a number: symbol * 256 +
    magnitude * 16 + confidence, ``NOTHING`` for none."""

    def __init__(self, lanes: int, counts: np.ndarray):
        a = len(counts)
        if a > 1 << (T0 - 1):
            raise ValueError(f"a segment of {a} different symbols is not supported")
        self.f = 1 + counts.astype(np.int64) * ((1 << T0) - a) // max(int(counts.sum(dtype=np.int64)), 1)
        self.f[np.argmax(self.f)] += (1 << T0) - self.f.sum()
        self.start = np.cumsum(self.f) - self.f
        magnitude = np.clip(np.searchsorted(1 << np.arange(T0 + 1), self.f, "right") - 4, 0, 15)
        self.fresh = (np.arange(a) << 8) + (magnitude << 4) + 1
        self.t1, self.t2 = np.full(a, NOTHING), np.full(1 << ORDER2, NOTHING)
        self.s1, self.k2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.n1, self.n2 = np.full(16, 32), np.full(16, 32)
        self.h1 = self.h2 = (np.arange(16) * 3000 + 8000) * 32 >> 16
        self.w = [np.full(16, x) for x in (40_000, 20_000, 10_000)]
        self.log, self.logged = np.zeros(LEARN + lanes, np.int64), 0
        self.mix()

    def mix(self) -> None:
        """Shares of the three outcomes (order 2, order 1, frequencies), of
        4096, in every context."""
        a1, a2 = (self.h1 << 16) // (self.n1 + 1), (self.h2 << 16) // (self.n2 + 1)
        has1, has2 = Q1 > 0, Q2 > 0
        x1 = STRETCH[a1 >> 4][Q1] * has1
        self.x = STRETCH[a2 >> 4][Q2], np.where(AGREE, x1, -x1), CHANCE
        dot = sum(w[Q2] * x for w, x in zip(self.w, self.x, strict=True)) >> 16
        self.mixed = SQUASH[np.clip(dot + 2048, 0, 4095)]
        o2 = np.where(has2, np.minimum(self.mixed, 3900), 1)
        o1 = np.clip((4096 - o2) * a1[Q1] >> 16, 1, 4032 - o2) * (has1 & ~(AGREE & has2))
        cut = np.stack([np.zeros_like(o2), o2, o2 + o1, np.full_like(o2, 4096)], axis=1)
        self.low = cut.ravel()  # at context * 4 + outcome
        self.share = np.diff(cut, axis=1, append=4097).ravel()

    def learn(self) -> None:
        """Counters and weights follow the outcomes since the last call."""
        seen = np.bincount(self.log[: self.logged], minlength=4 << 13).reshape(-1, 4)
        self.logged = 0
        n, hit2 = seen.sum(axis=1), seen[:, 0]
        hit1 = seen[:, 1] + hit2 * (AGREE & (Q1 > 0))
        by = lambda q, x: np.bincount(q, x, 16).astype(np.int64)  # noqa: E731  sums far below 2 ** 53 are exact
        self.n1, self.h1, self.n2, self.h2 = self.n1 + by(Q1, n), self.h1 + by(Q1, hit1), self.n2 + by(Q2, n), self.h2 + by(Q2, hit2)
        for many, hits in ((self.n1, self.h1), (self.n2, self.h2)):
            old = many > 1 << 17
            many[old] >>= 1
            hits[old] >>= 1
        error = ((hit2 << 12) - n * self.mixed) * (Q2 > 0)
        times = by(Q2, n)
        for w, x in zip(self.w, self.x, strict=True):
            w += (by(Q2, error * x) // np.maximum(times, 1)) * 14 * np.minimum(times, 256) >> 16
        self.mix()

    def predict(self, n: int) -> None:
        """Predictions and contexts of the first ``n`` lanes."""
        if self.logged >= LEARN:
            self.learn()
        self.i1 = self.s1[:n]
        self.k1 = self.i1 * 0x9E3779B1
        self.i2 = ((self.k1 + self.k2[:n]) >> 13) & ((1 << ORDER2) - 1)
        self.v1, self.v2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.p1, self.p2 = self.v1 >> 8, self.v2 >> 8
        self.q1, self.q2 = self.v1 & 15, self.v2 & 15
        c = (self.v2 & 255) << 4
        c |= self.q1
        c <<= 1
        c |= self.p1 == self.p2
        c <<= 2
        self.c4 = c

    def interval(self, outcome: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of symbols, of 1 << (T0 + SEL)."""
        j = self.c4 + outcome
        self.log[self.logged : self.logged + len(j)] = j
        self.logged += len(j)
        share, other = self.share.take(j), outcome == 2
        start = self.start.take(s)
        start *= other
        start *= share
        start += self.low.take(j) << T0
        share *= np.where(other, self.f.take(s), 1 << T0)
        return start, share

    def update(self, s: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """The symbols that came.  Of lanes with one context the last counts."""
        fresh = self.fresh.take(s)
        for t, i, v, q, hit in ((self.t1, self.i1, self.v1, self.q1, hit1), (self.t2, self.i2, self.v2, self.q2, hit2)):
            q += hit * 16
            v += CHANGE.take(q)
            t[i] = np.where(q < 2, fresh, v)
        n = len(s)
        self.k2[:n] = (self.k1 >> 3) * 5
        self.s1[:n] = s


LOW_HALF, BITS = np.uint64((1 << 32) - 1), np.uint64(32)


def _narrow(low: np.ndarray, rng: np.ndarray, r: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Take an interval.  Lanes whose range became small, and the 32 bits that
    each of them puts out: its range is cut where these bits would change."""
    low += start.view(np.uint64) * r
    np.multiply(r, width.view(np.uint64), out=rng)
    go = np.flatnonzero(rng <= LOW_HALF)
    lo = low.take(go)
    rest = lo & LOW_HALF
    rng[go] = np.minimum(rng.take(go), LOW_HALF - rest + np.uint64(1)) << BITS
    low[go] = rest << BITS
    return go, lo >> BITS


def _shape(n_symbols: int) -> tuple[int, int]:
    """Block size and number of blocks."""
    block = max(-(-n_symbols // LANES), LEAST_BLOCK)
    return block, -(-n_symbols // block)


def _encode_lanes(symbols: np.ndarray, counts: np.ndarray, block: int, lanes: int) -> list[bytes]:
    tail = len(symbols) - (lanes - 1) * block
    grid = np.zeros(lanes * block, np.int32)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    m = _Model(lanes, counts)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    row = block + 2
    out, at = np.zeros(lanes * row, np.uint32), np.arange(lanes) * row
    for t in range(block):
        n = lanes if t < tail else lanes - 1
        if not n:
            break
        m.predict(n)
        s = grid[t, :n].astype(np.int64)
        hit1, hit2 = s == m.p1, s == m.p2
        outcome = np.where(hit2, 0, np.where(hit1, 1, 2))
        go, word = _narrow(low[:n], rng[:n], rng[:n] >> np.uint64(T0 + SEL), *m.interval(outcome, s))
        i = at.take(go)
        out[i] = word
        at[go] = i + 1
        m.update(s, hit1, hit2)
    for _ in range(2):
        out[at] = low >> BITS
        low <<= BITS
        at += 1
    return [out[i * row : end].tobytes() for i, end in enumerate(at.tolist())]


def _decode_lanes(blocks: list[bytes], n_symbols: int, counts: np.ndarray, block: int) -> np.ndarray:
    lanes = len(blocks)
    tail = n_symbols - (lanes - 1) * block
    words = np.frombuffer(b"".join(blocks), "<u4")
    sizes = np.array([len(b) // 4 for b in blocks])
    at = np.cumsum(sizes) - sizes
    m = _Model(lanes, counts)
    of_slot = np.repeat(np.arange(len(m.f), dtype=np.int32), m.f)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = words.take(at).astype(np.uint64) << BITS | words.take(at + 1)
    at += 2
    grid = np.zeros((block, lanes), np.int32)
    for t in range(block):
        n = lanes if t < tail else lanes - 1
        if not n:
            break
        m.predict(n)
        r = rng[:n] >> np.uint64(T0 + SEL)
        value = ((code[:n] - low[:n]) // r).view(np.int64)
        share = value >> T0
        outcome = (share >= m.low.take(m.c4 + 1)).astype(np.int64)
        outcome += share >= m.low.take(m.c4 + 2)
        j = m.c4 + outcome
        value -= m.low.take(j) << T0
        value //= m.share.take(j)
        s = of_slot.take(value).astype(np.int64)
        s = np.where(outcome == 2, s, np.where(outcome == 0, m.p2, m.p1))
        go, _ = _narrow(low[:n], rng[:n], r, *m.interval(outcome, s))
        i = at.take(go)
        code[go] = code.take(go) << BITS | words.take(i)
        at[go] = i + 1
        grid[t, :n] = s
        m.update(s, s == m.p1, s == m.p2)
    return grid.T.ravel()[:n_symbols]


def _frame(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(a.astype("<u4").tobytes())


def _spelled(numbers: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The items ``flat[first[i] : first[i] + size[i]]`` of all numbers i."""
    out = []
    for k in range(0, len(numbers), 1 << 19):
        some = numbers[k : k + (1 << 19)]
        n = size.take(some)
        ends = np.cumsum(n)
        place = np.repeat(first.take(some) - ends + n, n)
        place += np.arange(len(place))
        out.append(flat.take(place))
    return np.concatenate(out) if out else flat[:0]


def encode_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """Ids of documents, one after the other, and their lengths, as bytes."""
    alphabet, numbers = np.unique(ids, return_inverse=True)
    return encode_pieces(numbers, np.arange(len(alphabet) + 1), alphabet, lengths)


def encode_pieces(numbers: np.ndarray, first: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> bytes:
    """The same of documents whose ids come in pieces: piece i has the ids
    ``flat[first[i] : first[i + 1]]``."""
    size, first = np.diff(first), first[:-1]
    counts = np.bincount(numbers, minlength=len(size))
    unit = (counts >= LEAST_UNIT) & (size > 1)
    if unit.sum() > UNITS:
        best = np.flatnonzero(unit)
        best = best[np.argsort(-counts[best] * (size[best] - 1), kind="stable")[:UNITS]]
        unit = np.zeros(len(size), bool)
        unit[best] = True
    units, alone = np.flatnonzero(unit), np.flatnonzero((counts > 0) & ~unit)
    alphabet, places = np.unique(_spelled(alone, first, size, flat), return_inverse=True)
    # Pieces as symbols: a unit is one, the others have one for each id.
    n = np.where(unit, 1, size)
    of = np.concatenate([places, len(alphabet) + np.arange(len(units))]).astype(np.int32)
    at = np.zeros(len(size), np.int64)
    at[alone], at[units] = np.cumsum(n[alone]) - n[alone], len(places) + np.arange(len(units))
    symbols = _spelled(numbers, at, n, of)
    often = np.bincount(symbols, minlength=len(alphabet) + len(units))
    block, n_blocks = _shape(len(symbols))
    blocks = _encode_lanes(symbols, often, block, n_blocks) if n_blocks else []
    spelling = np.concatenate([alphabet, _spelled(units, first, size, flat)])
    sizes = np.concatenate([np.ones(len(alphabet), np.int64), size[units]])
    checks = [zlib.crc32(symbols[i : i + CHECKED]) for i in range(0, len(symbols), CHECKED)]
    frames = [_frame(x) for x in (spelling, sizes, often, lengths, np.array(checks, np.int64))]
    head = MAGIC + struct.pack("<7I", 3, block, len(lengths), int(sizes @ often), len(symbols), n_blocks, zlib.crc32(b"".join(frames))) + struct.pack("<5I", *map(len, frames))
    return b"".join([head, *frames, np.array([list(map(len, blocks)), list(map(zlib.crc32, blocks))], "<u4").tobytes(), *blocks])


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``encode_segment`` was given; raises if a block is damaged."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    version, block, n_docs, n_ids, n_symbols, n_blocks, check, *sizes = struct.unpack_from("<12I", data, 4)
    if version != 3:
        raise ValueError(f"token segments of version {version} are unknown")
    at, frames = 52, []
    if zlib.crc32(data[at : at + sum(sizes)]) != check:
        raise ValueError("the head of a token segment is damaged")
    for size in sizes:
        frames.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), "<u4"))
        at += size
    spelling, size, often, lengths, checks = frames
    lens, coded = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(2, -1)
    at += 8 * n_blocks
    edges = at + np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    blocks = [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for i, b in enumerate(blocks):
        if zlib.crc32(b) != coded[i]:
            raise ValueError(f"block {i} is damaged")
    symbols = _decode_lanes(blocks, n_symbols, often, block) if blocks else np.zeros(0, np.int32)
    for i, check in enumerate(checks.tolist()):
        if zlib.crc32(symbols[i * CHECKED : (i + 1) * CHECKED]) != check:
            raise ValueError(f"symbols from {i * CHECKED} on are not those that were written")
    size = size.astype(np.int64)
    ids = _spelled(symbols, np.cumsum(size) - size, size, spelling)
    if not len(ids) == n_ids == lengths.sum(dtype=np.int64):
        raise ValueError(f"{len(ids)} ids came back of {n_ids}")
    return ids, lengths


#: What the tokenizer does before its merges, where ``PIECES`` can do it.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
STEPS = ["NFC", {"Regex": "\\s+"}, "Lowercase"]
#: Lower-cased text of ASCII and of Latin-1 letters, of which NFC changes nothing.
PLAIN = re.compile("[\t-\r -~\xc0-\xff]*")
PIECES = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\t-\r a-z0-9\xdf-\xf6\xf8-\xff]+")
ENDING = "</w>"


#: By Latin-1 byte: lower case, and whether it is white space (0), a letter (1),
#: a digit (2) or else (3).
LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower().encode("latin-1", "ignore")) == 1 else i for i in range(256)], np.uint8)
KIND = np.array([0 if i in b"\t\n\v\f\r " else 1 if re.match("[a-z\xdf-\xf6\xf8-\xff]", chr(x)) else 2 if 48 <= i < 58 else 3 for i, x in enumerate(LOWER.tolist())], np.uint8)
#: The first bytes of eight, by their number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def split_plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``PIECES`` finds in lower-cased plain texts: places and lengths of
    the pieces, their number up to each text's end, and the bytes."""
    coded = [t.encode("latin-1") for t in texts]
    buf = LOWER.take(np.frombuffer(b"\n".join([*coded, b" " * 17]), np.uint8))
    kind = KIND.take(buf)
    change = np.diff(kind, prepend=np.uint8(0)) != 0
    change |= kind == 2
    # A run of other characters that is one ' or begins with it, before s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((buf == 39) & change)
    x, y = buf.take(quote + 1), buf.take(quote + 2)
    two = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    three = (((x == 114) | (x == 118)) & (y == 101)) | ((x == 108) & (y == 108))
    change[quote[two | three] + 1] = False
    after = np.concatenate([quote[two] + 2, quote[three] + 3])
    change[after[kind[after] == 1]] = True
    edges = np.flatnonzero(change)
    piece = kind.take(edges) > 0
    p, n = edges[piece], np.diff(edges, append=len(buf))[piece]
    return p, n, np.searchsorted(p, np.cumsum([len(c) + 1 for c in coded], dtype=np.int64)), buf


class _Slots:
    """Numbers of pieces of up to 16 bytes, by these bytes, in a table with one
    place for each value of a hash; the first piece keeps the place."""

    BITS = 20

    def __init__(self):
        self.keys = np.zeros((1 << self.BITS, 2), np.uint64)
        self.number = np.full(1 << self.BITS, -1, np.int32)

    def find(self, p: np.ndarray, n: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, places, and numbers (-1 where the place has another piece)."""
        eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
        keys = np.stack([eight[p] & FIRST.take(np.minimum(n, 8)), eight[np.minimum(p + 8, len(eight) - 1)] & FIRST.take(np.clip(n - 8, 0, 8))], axis=1)
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at = (h >> np.uint64(64 - self.BITS)).view(np.int64)
        there = self.keys.take(at, axis=0)
        same = (there[:, 0] == keys[:, 0]) & (there[:, 1] == keys[:, 1]) & (n <= 16)
        return keys, at, np.where(same, self.number.take(at), -1)

    def put(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray, number: np.ndarray) -> None:
        free = np.flatnonzero((self.number.take(at) < 0) & (n <= 16))
        at, first = np.unique(at[free], return_index=True)
        self.keys[at], self.number[at] = keys[free[first]], number[free[first]]


class _Numbers(dict):
    """A number for each piece, in the order of their first use."""

    def __missing__(self, piece: str | int) -> int:
        self[piece] = n = len(self)
        return n


def _of_pieces(model: dict) -> str | None:
    """The tokenizer for text that is split already, one space between pieces;
    none if ``PIECES`` does not split as the tokenizer does."""
    steps = [x.get("pattern", x["type"]) for x in (model.get("normalizer") or {}).get("normalizers", [])]
    pre = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != STEPS or [x["type"] for x in pre] != ["Split", "ByteLevel"] or pre[0]["pattern"] != {"Regex": SPLIT} or not pre[0]["invert"] or pre[1]["use_regex"] or model["model"].get("end_of_word_suffix") != ENDING:
        return None
    return json.dumps(model | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, pre[1]]}, "added_tokens": []})


@lru_cache(1)  # a worker parses a tokenizer once
def _parsed(source: str):
    """The tokenizer for text that is split already, and of each id whether it
    ends a piece: each piece ends with one such and has no other."""
    from tokenizers import Tokenizer

    inner, names = _of_pieces(json.loads(source)), load(source).get_vocab()
    last = np.zeros(max(names.values()) + 1, bool)
    last[[i for t, i in names.items() if t.endswith(ENDING)]] = True
    return Tokenizer.from_str(inner) if inner else None, last


class Encoder:
    """A tokenizer that drops white space, piece by piece with a bounded
    memory: text is split as the tokenizer splits it before its merges, or
    where that is not plain at white space, and every distinct piece is encoded
    by the tokenizer once.  ``flat`` and ``first`` spell the pieces."""

    #: Characters that Python splits at and the tokenizer does not.
    odd = re.compile("[\x1c-\x1f]")

    def __init__(self, source: str, end: int):
        self.tok, self.end = load(source), end
        self.cut = re.compile("|".join(map(re.escape, special_tokens(source))) or "(?!)")
        self.inner, self.last = _parsed(source)
        self.keep(None)

    def keep(self, some: np.ndarray | None) -> None:
        """Forget all pieces but these numbers, which become 0, 1, ..."""
        if some is None or len(some) > REMEMBERED:
            self.known, self.flat, self.first = _Numbers(), array("I"), array("q", [0])
            self.slots = _Slots()
            return
        keys = list(self.known)
        first, flat = self.spelling()
        sizes = np.diff(first)
        self.slots = _Slots()
        self.known = _Numbers(zip(map(keys.__getitem__, some.tolist()), range(len(some)), strict=True))
        self.flat = array("I", _spelled(some, first[:-1], sizes, flat).tobytes())
        self.first = array("q", np.concatenate([[0], np.cumsum(sizes[some])]).tobytes())

    def _split(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that the tokenizer splits no further, and how many
        each has.  They go to it many at once."""
        joined = self.inner.encode_batch_fast([" ".join(pieces[i : i + 64]) for i in range(0, len(pieces), 64)], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in joined]
        ends = [np.flatnonzero(self.last.take(x)) for x in ids]
        if any(len(x) != min(64, len(pieces) - 64 * i) or x[-1] != len(y) - 1 for i, (x, y) in enumerate(zip(ends, ids, strict=True))):
            raise ValueError("the tokenizer ends pieces in another way than this encoder")
        return np.concatenate(ids), np.concatenate([np.diff(x, prepend=-1) for x in ends])

    def _learn(self, new: list, plain: bool) -> None:
        """Spell pieces: strings, or ids that stand for themselves."""
        if not new:
            return
        if plain:
            ids, sizes = self._split(new)
        else:
            words = [w for w in new if isinstance(w, str)]
            coded = iter(self.tok.encode_batch_fast(words, add_special_tokens=False))
            spelled = [next(coded).ids if isinstance(w, str) else [w] for w in new]
            ids, sizes = np.array([i for x in spelled for i in x], np.uint32), np.array([len(x) for x in spelled], np.int64)
        self.first.frombytes((np.cumsum(sizes) + self.first[-1]).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The pieces of each text and the end id, by number."""
        out: list = [None] * len(texts)
        plain, rest = [], []
        for i, t in enumerate(texts):
            if self.odd.search(t) or self.cut.search(t):
                rest.append((i, self.tok.encode(t, add_special_tokens=False).ids))
            elif self.inner and PLAIN.fullmatch(t):
                plain.append(i)
            else:
                rest.append((i, t.split()))
        try:
            if self.end not in self.known:
                self.known.update({self.end: len(self.known)})
                self._learn([self.end], False)
            end = self.known[self.end]
            after = np.cumsum([len(texts[i]) for i in plain]) // TOGETHER
            for some in np.split(np.array(plain, np.int64), np.flatnonzero(np.diff(after)) + 1) if plain else ():
                flat, ends = self._plain([texts[i] for i in some])
                flat = np.insert(flat, ends, end)
                for i, x in zip(some, np.split(flat, ends[:-1] + np.arange(1, len(ends))), strict=True):
                    out[i] = x
            at = len(self.known)
            for i, p in rest:
                out[i] = np.fromiter(map(self.known.__getitem__, [*p, self.end]), np.int32, len(p) + 1)
            self._learn(self._since(at), False)
        except BaseException:
            self.keep(None)  # the worker's next task may not meet pieces without ids
            raise
        return out

    def _since(self, at: int) -> list:
        """The pieces from number ``at`` on."""
        return list(islice(reversed(self.known), len(self.known) - at))[::-1]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and how many there are up to each text's end."""
        p, n, ends, buf = split_plain(texts)
        keys, places, number = self.slots.find(p, n, buf)
        todo = np.flatnonzero(number < 0)
        text, at = buf.tobytes().decode("latin-1"), len(self.known)
        first = p[todo]
        number[todo] = np.fromiter((self.known[text[a:b]] for a, b in zip(first.tolist(), (first + n[todo]).tolist(), strict=True)), np.int32, len(todo))
        self._learn(self._since(at), True)
        self.slots.put(keys[todo], places[todo], n[todo], number[todo])
        return number, ends

    def spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """``first`` and ``flat`` as they are now."""
        return np.array(self.first, np.int64), np.array(self.flat, np.uint32)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as 32-bit numbers."""
        numbers = self.numbers(texts)
        first, flat = self.spelling()
        return [_spelled(x, first[:-1], np.diff(first), flat).tobytes() for x in numbers]


@lru_cache(1)
def _encoder(source: str, end: int) -> Encoder:
    """One for a worker and its tasks."""
    return Encoder(source, end)


FILES = "part int, segment int, n_tokens long, docs array<{id}>, data binary"


def _writer(id_type: pa.DataType, source, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = _encoder(source.value, end), TaskContext.get().partitionId(), 0
        docs, pieces, size = [], [], 0

        def flush() -> pa.RecordBatch:
            first, flat = encoder.spelling()
            sizes, numbers = np.diff(first), np.concatenate(pieces)
            lengths = np.add.reduceat(sizes.take(numbers), np.cumsum([0, *map(len, pieces[:-1])]))
            data = encode_pieces(numbers, first, flat, lengths)
            # Pieces keep their numbers for a segment; then those that came once go.
            if len(sizes) > REMEMBERED // 2:
                encoder.keep(np.flatnonzero(np.bincount(numbers, minlength=len(sizes)) > 1))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([lengths.sum()], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([data], pa.binary())], names=["part", "segment", "n_tokens", "docs", "data"])

        for b in batches:
            for k in range(0, b.num_rows, 128):
                some = b.slice(k, 128)
                new = encoder.numbers([t or "" for t in some.column(1).to_pylist()])
                docs += some.column(0).to_pylist()
                pieces += new
                first = np.array(encoder.first)
                size += sum(int((first.take(x + 1) - first.take(x)).sum()) for x in new)
                if size >= SEGMENT or len(encoder.known) > 2 * REMEMBERED:
                    yield flush()
                    segment += 1
                    docs, pieces, size = [], [], 0
        if docs:
            yield flush()

    return lean(run)


def write_tokens(df: DataFrame, scratch: Scratch, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END_ID) -> DataFrame:
    """Segments of all documents in ascending id, written as the ``data`` of a
    Parquet table (a shared store that recovers with its tasks)."""
    from pyspark.sql.pandas.types import to_arrow_type

    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer's own file
    kind = df.schema[id_col].dataType
    ordered = df.select(id_col, text_col).repartitionByRange(shuffle_width(df.sparkSession), id_col).sortWithinPartitions(id_col)
    return scratch.table(ordered.mapInArrow(_writer(to_arrow_type(kind), source, end), FILES.format(id=kind.simpleString())), "tokens", compression="uncompressed")


def _reader(id_type: pa.DataType, id_col: str, then):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, docs, data in zip(b.column("base").to_pylist(), b.column("docs"), b.column("data"), strict=True):
                ids, lengths = decode_segment(bytes(data.as_buffer()))
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                flat = docs.values
                for k in range(0, len(lengths), 2000):
                    e = ends[k : k + 2001]
                    lists = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(ids[e[0] : e[-1]].view(np.int32)))
                    yield pa.RecordBatch.from_arrays([flat.slice(k, len(e) - 1).cast(id_type), pa.array(base + e[:-1]), lists], names=[id_col, "start", "ids"])

    return lean(lambda batches: then(run(batches)) if then else run(batches))


def read_tokens(files: DataFrame, id_col: str = "doc_id", then=None, schema: str | None = None) -> DataFrame:
    """``id_col``, ``start`` (ids of all documents before) and ``ids``; or, of
    ``schema``, what ``then`` makes of these in the tasks that read them."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = files.schema["docs"].dataType.elementType
    sizes = files.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))  # one row per segment
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(bases, ["part", "segment"]).select("base", "docs", "data").mapInArrow(_reader(to_arrow_type(kind), id_col, then), schema or f"{id_col} {kind.simpleString()}, start long, ids array<int>")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in b.column("ids")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array([len(x.values) for x in b.column("ids")], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the files, read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_tokens(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(files, then=_crc, schema="doc_id long, start long, n_tokens long, ids_crc32 long")
