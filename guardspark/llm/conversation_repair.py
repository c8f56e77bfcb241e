"""Cheapest repair of conversations by weighted finite-state composition.

Three machines: an *input acceptor* reads a conversation's rows in order, each
as its role's initial and its fault; an *edit transducer* keeps, reroles,
deletes or inserts; a *role grammar* accepts ``(s?(ua)+)?``.  They are composed
one row class and grammar state at a time, when a row first needs it
(``_arcs``).  Weights are pairs (cost, labels), the labels compared as text.  Since

    c + a < c + b  exactly if  a < b,

but not so for a + c and b + c, the shortest path is taken from the end to the
beginning: for each row and grammar state the best rest of the labels, of which
only cost, first label and rank among the four states are kept.

A conversation of any length is cut into blocks of at most ``1 << BLOCK``
consecutive rows.  Tasks solve blocks for each pair of states at their ends
(every path of a block consumes the same rows and ends with one of them, so no
labels of a block are a beginning of others); then a conversation's blocks are
put together from costs and ranks alone, sixteen numbers each; then labels meet
their rows again, block by block.  Only the digest of a whole conversation,
which is sequential, streams through one task, with nothing but its labels in
memory.

Two inserts never stand side by side in a cheapest repair, since such a pair
can go (after a lone ``s``: with the ``s``) for less; so each place takes one.

Defined results: a null role or text is one space; a null conversation is one
of its own; rows of one turn (and those without a turn, which come first) are
ordered by role, then SHA-256 of the text; a role's initial is its first
character, and a role without one can't be kept; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from guardspark.llm.line_dedup import BLANK
from guardspark.llm.scratch import Scratch, shuffle_width

#: A block has at most two to this power rows.
BLOCK = 12
#: Rows with texts that a task reads at once.
TEXTS = 500
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL, STATES = (0, 3), range(4)
NAMES = {"u": "user", "a": "assistant"}


def _made(state: int) -> str:
    """The initial that an edit makes in a grammar state: never s."""
    return next(c for c in GRAMMAR[state] if c in NAMES)


@lru_cache(None)
def _arcs(initial: str, fault: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """The composed machine's arcs over one row: (labels, cost, next state)."""

    def row(at: int):
        yield "D", DELETE, at
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if initial in GRAMMAR[at]:
                yield "K", KEEP + more, GRAMMAR[at][initial]
            yield "R", REROLE + more, GRAMMAR[at][_made(at)]

    then = GRAMMAR[state][_made(state)]
    return (*row(state), *(("I" + label, INSERT + cost, end) for label, cost, end in row(then)))


def _tail(state: int) -> str:
    """Inserts that end a conversation."""
    out = ""
    while state not in FINAL:
        state, out = GRAMMAR[state][_made(state)], out + "I"
    return out


def _ranks(keys: dict) -> dict:
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return {s: order[k] for s, k in keys.items()}


def solve_block(rows: list[tuple[str, str]]) -> dict[tuple[int, int], tuple[int, str]]:
    """For (first state, last state) of a block the least cost and labels."""
    out = {}
    for end in STATES:
        cost, rank, back = {end: 0}, {end: 0}, []
        for initial, fault in reversed(rows):
            best = {}
            for s in STATES:
                found = [(w + cost[t], label, rank[t], t) for label, w, t in _arcs(initial, fault, s) if t in cost]
                if found:
                    best[s] = min(found)
            back.append(best)
            cost, rank = {s: b[0] for s, b in best.items()}, _ranks({s: b[1:3] for s, b in best.items()})
        back.reverse()
        for s in cost:
            at, labels = s, []
            for best in back:
                labels.append(best[at][1])
                at = best[at][3]
            out[s, end] = cost[s], "".join(labels)
    return out


def _blocks(schema):
    """Sorted rows to one record a block."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for (conv, block), own in groupby(rows, lambda r: r[:2]):
            seen = [(r[3], r[4]) for r in own]
            found = solve_block(seen)
            rank = _ranks({k: labels for k, (_, labels) in found.items()})
            pairs = [(s, e) for s in STATES for e in STATES]
            faults = [f for _, f in seen]
            initials = [i for i, _ in seen]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            out.append((conv, block, [found[p][0] if p in found else None for p in pairs], [rank.get(p) for p in pairs], [found[p][1] if p in found else None for p in pairs], faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, initials[0], initials[-1]))
            if len(out) >= 2000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _picked(schema):
    """A conversation's blocks, last first, to the states that each runs through."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for conv, own in groupby(rows, lambda r: r[0]):
            cost, rank = {s: INSERT * len(_tail(s)) for s in STATES}, _ranks({s: _tail(s) for s in STATES})
            back = []
            for _, block, costs, ranks in own:
                best = {}
                for s in STATES:
                    found = [(costs[4 * s + e] + cost[e], ranks[4 * s + e], rank[e], e) for e in STATES if e in cost and costs[4 * s + e] is not None]
                    if found:
                        best[s] = min(found)
                cost, rank = {s: b[0] for s, b in best.items()}, _ranks({s: b[1:3] for s, b in best.items()})
                back.append((block, {s: b[3] for s, b in best.items()}))
            at = 0
            for i in range(len(back) - 1, -1, -1):
                block, ends = back[i]
                out.append((conv, block, 4 * at + ends[at], "" if i else _tail(ends[at])))
                at = ends[at]
                if len(out) >= 5000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def ordered_rows(df: DataFrame, scratch: Scratch, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """All rows with ``pos``, which grows along each conversation, and ``block``.
    Range partitions split a conversation, a turn and even equal rows."""
    conv, turn, role, text = (F.col(c) for c in columns)
    rows = df.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    bare = F.rtrim("text", F.lit(BLANK))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "initial": F.substring("role", 1, 1), "blank": bare == "", "open": ~F.substring(bare, -1, 1).isin(".", "!", "?"), "own": F.monotonically_increasing_id()})
    key = ["conv", "turn", "role", "digest", "own"]
    rows = rows.repartitionByRange(shuffle_width(df.sparkSession), *key).sortWithinPartitions(*key).drop("own")
    rows = rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", BLOCK))
    return scratch.table(rows, "ordered", arrow_rows=TEXTS)


def _met(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join by ``conv``, which may be null, and columns that are not."""
    b = b.withColumnsRenamed({n: f"_{n}" for n in ("conv", *names)})
    on = F.col("conv").eqNullSafe(F.col("_conv"))
    for n in names:
        on &= F.col(n) == F.col(f"_{n}")
    return a.join(b, on, how).drop("_conv", *(f"_{n}" for n in names))


def repair_paths(ordered: DataFrame, scratch: Scratch) -> DataFrame:
    """Each block's ``labels`` and first ``state`` in its conversation's cheapest
    repair, with its ``cost`` and counts of faults."""
    kind = ordered.schema["conv"].dataType.simpleString()
    light = ordered.select("conv", "block", "pos", "role", "initial", "digest", "blank", "open")
    # Texts that come up again: aggregated before they move, met by a join that can be split.
    again = light.where("not blank").groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = _met(light, again, ["role", "digest"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    rows = marked.select("conv", "block", "pos", "initial", fault.alias("fault")).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")

    solved = StructType.fromDDL(f"conv {kind}, block long, costs array<int>, ranks array<int>, paths array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string")
    blocks = scratch.table(rows.mapInArrow(_blocks(to_arrow_schema(solved)), solved), "blocks")
    picked = StructType.fromDDL(f"conv {kind}, block long, pick int, tail string")
    picks = blocks.select("conv", "block", "costs", "ranks").repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    picks = picks.mapInArrow(_picked(to_arrow_schema(picked)), picked)
    found = _met(blocks, picks, ["block"])
    cost = F.get("costs", "pick") + INSERT * F.char_length("tail")
    out = found.select("conv", "block", F.shiftright("pick", 2).alias("state"), F.concat(F.get("paths", "pick"), "tail").alias("labels"), cost.cast("long").alias("cost"), "blank", "duplicate", "truncated", "illegal", "first", "last")
    out = scratch.table(out, "paths")
    scratch.drop(blocks)
    return out


def _repaired(state: int, labels: str, rows):
    """A block's rows after its edits: (label, role, text), deleted ones too."""
    for label in labels:
        role, text = (None, "") if label == "I" else next(rows)
        if label == "D":
            yield label, role, text
            continue
        made = role[:1] if label == "K" else _made(state)
        yield label, role if label == "K" else NAMES[made], text
        state = GRAMMAR[state][made]


def _with_paths(ordered: DataFrame, paths: DataFrame) -> DataFrame:
    """One record with a block's path before the records of its rows."""
    nothing = lambda kind: F.lit(None).cast(kind)
    path = F.struct(*(c for c in paths.columns if c not in ("conv", "block")))
    heads = paths.select("conv", "block", F.lit(0).alias("kind"), nothing("long").alias("pos"), nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), path.alias("path"))
    rows = ordered.select("conv", "block", F.lit(1).alias("kind"), "pos", "turn", "role", "text", F.lit(None).cast(heads.schema["path"].dataType).alias("path"))
    return heads.unionByName(rows)


def repaired_rows(ordered: DataFrame, paths: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv``, ``block``, ``n`` (place within the
    block), ``edit``, ``role``, ``text``; deleted rows have the edit D."""
    schema = StructType.fromDDL(f"conv {ordered.schema['conv'].dataType.simpleString()}, block long, n int, edit string, role string, text string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        records = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (conv, block), own in groupby(records, lambda r: r[:2]):
            path, out = next(own)[7], []
            for n, edit in enumerate(_repaired(path["state"], path["labels"], (r[5:7] for r in own))):
                out.append((conv, block, n, *edit))
                if len(out) >= TEXTS:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    records = _with_paths(ordered, paths).repartition("conv", "block").sortWithinPartitions("conv", "block", "kind", "pos")
    return records.mapInArrow(run, schema)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(schema):
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        records = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for conv, own in groupby(records, lambda r: r[0]):
            total, audit, digest, empty = dict.fromkeys(counts, 0), [], hashlib.sha256(), True
            turns, low, high, last = 0, None, None, ""

            def texts(rows):
                nonlocal turns, low, high
                for r in rows:
                    if r[4] is not None:
                        turns, low, high = turns + (r[4] != high), r[4] if low is None else low, r[4]
                    yield r[5], r[6]

            for _, block in groupby(own, lambda r: r[1]):
                path = next(block)[7]
                if path is None:  # stands for a conversation that may have lost all rows
                    continue
                for c in counts:
                    total[c] += path[c]
                total["illegal"] += bool(audit) and last + path["first"] not in ("su", "ua", "au")
                last = path["last"]
                audit.append(path["labels"])
                for label, role, text in _repaired(path["state"], path["labels"], texts(block)):
                    if label != "D":
                        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                        empty = False
            out.append((conv, high - low + 1 - turns if turns else 0, *(total[c] for c in counts), "".join(audit), digest.hexdigest()))
            if len(out) >= 2000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def repair_summary(convs: DataFrame, ordered: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each of ``convs``: gaps, faults, cost, labels and the digest
    of the repaired ``role:text`` lines."""
    schema = StructType.fromDDL(f"conv {ordered.schema['conv'].dataType.simpleString()}, {SUMMARY}")
    records = _with_paths(ordered, paths)
    known = convs.distinct().select(F.col("conv"), F.lit(-1).cast("long").alias("block"), *(F.lit(0 if c == "kind" else None).cast(records.schema[c].dataType).alias(c) for c in records.columns[2:]))
    records = records.unionByName(known).repartition("conv").sortWithinPartitions("conv", "block", "kind", "pos")
    return scratch.table(records.mapInArrow(_summed(to_arrow_schema(schema)), schema), "summary", arrow_rows=TEXTS)


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with the damage that the query repairs."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    scratch, rows = Scratch(spark), spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ordered = ordered_rows(damaged(rows), scratch)
    paths = repair_paths(ordered, scratch)
    out = repair_summary(rows.select(F.col("conv_id").alias("conv")), ordered, paths, scratch)
    scratch.drop(ordered, paths)
    return out.withColumnRenamed("conv", "conv_id")
