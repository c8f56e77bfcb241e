"""Conversation repair against enumeration and a plain search over strings."""

import collections
import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from guardspark.llm import conversation_repair as c

GOOD = re.compile(r"(s?(ua)+)?\Z")
DDL = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(initials, fault, most=2):
    """The least (cost, labels) over all edits, with up to ``most`` inserts at a place."""
    gaps = [(n * 3, "I" * n, "".join(x)) for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    edits = []
    for i, f in zip(initials, fault):
        more = 3 * (f == "truncated")
        edits.append([(4, "D", "")] + ([] if f in ("blank", "duplicate") else [(more, "K", i), (3 + more, "R", "u"), (3 + more, "R", "a")]))
    best = None
    for path in itertools.product(gaps, *(x for e in edits for x in (e, gaps))):
        if GOOD.match("".join(p[2] for p in path)):
            found = sum(p[0] for p in path), "".join(p[1] for p in path)
            best = min(best or found, found)
    return best


def searched(initials, fault):
    """The same from the end, on whole strings."""
    rest = {s: (3 * len(c._tail(s)), c._tail(s)) for s in c.STATES}
    for i, f in zip(reversed(initials), reversed(fault)):
        one = {}
        for s in c.STATES:
            more = 3 * (f == "truncated")
            one[s] = [(4 + rest[s][0], "D" + rest[s][1])]
            if f not in ("blank", "duplicate"):
                one[s] += [(more + rest[t][0], "K" + rest[t][1]) for x, t in c.GRAMMAR[s].items() if x == i]
                one[s] += [(3 + more + rest[t][0], "R" + rest[t][1]) for x, t in c.GRAMMAR[s].items() if x != "s"]
        rest = {s: min(one[s] + [(3 + w, "I" + p) for x, t in c.GRAMMAR[s].items() if x != "s" for w, p in one[t]]) for s in c.STATES}
    return rest[0]


def test_search_against_enumeration():
    kinds = ["", "truncated", "blank", "duplicate"]
    for n in range(3):
        for initials in itertools.product("suat", repeat=n):
            for fault in itertools.product(kinds, repeat=n):
                assert searched(initials, fault) == enumerated(initials, fault), (initials, fault)
    random.seed(3)
    for _ in range(6):
        initials, fault = random.choices("sua", k=3), random.choices(kinds, [6, 2, 1, 1], k=3)
        assert searched(initials, fault) == enumerated(initials, fault)


def plain(rows):
    """All columns of the query but the damage, for one conversation's rows."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)
    fault, initials = faults([r[1:] for r in rows]), [r[1][:1] for r in rows]
    cost, labels = searched(initials, fault)
    turns = {t for t, _, _ in rows if t is not None}
    out, at, i = [], 0, 0
    for x in labels:
        role, text = (None, "") if x == "I" else rows[i][1:]
        i += x != "I"
        if x != "D":
            role = role if x == "K" else {"u": "user", "a": "assistant"}[c._made(at)]
            at = c.GRAMMAR[at][role[0]]
            out.append(f"{role}:{text}")
    assert GOOD.match("".join(x[0] for x in out))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, labels, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        hit, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        row = (conv, turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
        out += [row] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def by_conv(rows):
    out = collections.defaultdict(list)
    for conv, *rest in rows:
        out[conv].append(tuple(rest))
    return out


def held(spark, tmp_path, rows):
    path = str(tmp_path / f"t{random.getrandbits(60)}")
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in c.op13_conversation_repair(spark, path).collect()}
    after = by_conv(damage(rows))
    assert got == {conv: plain(after[conv])[0] for conv in {r[0] for r in rows}}


AWKWARD = [(1, None, "user", "no turn."), (1, None, "assistant", "no turn either."), (1, 3, None, "no role."), (1, 4, "", "empty role."), (1, 5, "user", None), (1, 6, "user", " \t\n"), (1, 7, "tool", "result."), (None, 1, "user", "no conversation."), (None, None, None, None), (2, 1, "system", "Be kind."), (2, 1, "system", "Be kind."), (3, 1, "user", "long " * 20_000 + "end?"), (3, 2, "assistant", "漢字 🙂 ünïcode! \x1c"), (4, 9, "user", "ends in U+0085.\x85"), (5, -3, "user", "Hm."), (5, 10**12, "assistant", "Hm.")]


def test_query(spark, sf, tmp_path, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    random.seed(5)
    wild = [(conv, t, random.choice(["user", "assistant", "system", "user", "assistant", "tool"]), random.choice(["a.", "b.", "c", "", "d!"]) + str(random.choice(["", t])) * random.choice([0, 1]) + random.choice(["", "."])) for conv in range(100, 160) for t in range(random.randrange(1, 60))]
    for bits in (12, 2):
        monkeypatch.setattr(c, "BLOCK", bits)
        held(spark, tmp_path, rows + AWKWARD + wild)
    monkeypatch.undo()
    held(spark, tmp_path, [])


def test_all_rows_dropped(spark, tmp_path):
    """Conversations that lose all rows are still there."""
    rows = [(i, 1, "user", "Hi.") for i in range(200)]
    assert any(zlib.crc32(f"{i}:1".encode()) % 20 == 0 for i in range(200))
    held(spark, tmp_path, rows)


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 2)
    random.seed(9)
    rows = [(conv, t, random.choice(["user", "assistant", "system"]), random.choice(["a.", "b.", "c", ""])) for conv in range(12) for t in range(20)]
    scratch = c.Scratch(spark)
    ordered = c.ordered_rows(spark.createDataFrame(rows, DDL).withColumn("path", F.lit(1)), scratch)
    got = collections.defaultdict(list)
    for r in sorted(c.repaired_rows(ordered, c.repair_paths(ordered, scratch)).collect(), key=lambda r: (r.conv, r.block, r.n)):
        if r.edit != "D":
            got[r.conv].append(f"{r.role}:{r.text}")
    assert dict(got) == {conv: plain(own)[1] for conv, own in by_conv(rows).items() if plain(own)[1]}


def test_hot_conversation(spark):
    """One conversation of all rows is dealt out over many tasks."""
    rows = spark.range(0, 60_000, 1, 4).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") % 5 == 0, "same.").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    scratch = c.Scratch(spark)
    ordered = c.ordered_rows(rows, scratch)
    sizes = [r["count"] for r in ordered.groupBy("block").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 1 << c.BLOCK and len(sizes) >= 15
    parts = [r["count"] for r in ordered.groupBy(F.shiftright("pos", 33)).count().collect()]
    assert len(parts) == 4 and max(parts) < 2 * min(parts)
    paths = c.repair_paths(ordered, scratch)
    own = [(r.turn, r.role, r.text) for r in rows.collect()]
    want = plain(own)[0]
    got = c.repair_summary(rows.select(F.col("conv_id").alias("conv")), ordered, paths, scratch).first()
    assert tuple(got)[1:] == want
