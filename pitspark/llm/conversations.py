"""Cheapest repair of a conversation's structure: an auction for shortest paths over an edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pitspark.session import materialize

BLOCK_ROWS = 64
BLOCK_BYTES = 4 << 20
_FAN_BITS = 5  # 32 blocks, or groups of blocks, are combined at a time

# The contract's costs and grammar. States are the role last written.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts after the last row
_LEGAL = {"su", "ua", "au"}
_KINDS = "suax"
_SPACE = " \t\n\x0b\x0c\r"


# --- the lattice ----------------------------------------------------------------
# A step takes the lattice from one boundary between rows to the next; it is a list of arcs
# (state, next state, cost, label). Node 4 * boundary + state.

def row_code(kind: str, truncated: bool) -> int:
    return -1 - _KINDS.index(kind) - 4 * truncated


def row_step(code: int) -> list[tuple]:
    """Arcs of a row (negative code), or of that many rows that have to go (positive)."""
    if code > 0:
        return [(q, q, DELETE * code, "D") for q in range(4)]
    truncated, kind = divmod(-1 - code, 4)
    extra = TRUNCATED * truncated
    arcs = [(q, q, DELETE, "D") for q in range(4)]
    arcs += [(q, to, extra, "K") for q, to in _KEPT[_KINDS[kind]].items()]
    return arcs + [(q, to, REROLE + extra, "R") for q, to in _NEXT.items()]


def block_step(costs: list[int], ranks: list[int]) -> list[tuple]:
    """Arcs of a whole block from its 16 costs (negative: none) and the ranks of its audits."""
    return [(i // 4, i % 4, c, r) for i, (c, r) in enumerate(zip(costs, ranks)) if c >= 0]


def build(steps: list[list[tuple]], inserts: bool, closed: bool) -> list[list[tuple]]:
    """Arcs (to, cost, label) by node. ``closed`` adds inserts after the last step and a sink, the last node."""
    arcs = [[] for _ in range(4 * len(steps) + 4 + closed)]
    for i, step in enumerate(steps):
        for q, to, cost, label in step:
            arcs[4 * i + q].append((4 * i + 4 + to, cost, label))
    if inserts:
        for i in range(len(steps) + closed):
            for q, to in _NEXT.items():
                arcs[4 * i + q].append((4 * i + to, INSERT, "I"))
    if closed:
        for q in (START, ASSISTANT):
            arcs[4 * len(steps) + q].append((len(arcs) - 1, 0, ""))
    return arcs


def leading_to(arcs: list[list[tuple]], sink: int) -> list[list[tuple]]:
    """The arcs on ways to ``sink`` only; a node without any cannot reach it."""
    into = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for to, _, _ in out:
            into[to].append(node)
    reached, todo = {sink}, [sink]
    while todo:
        for node in into[todo.pop()]:
            if node not in reached:
                reached.add(node)
                todo.append(node)
    return [[a for a in out if a[0] in reached] for out in arcs]


def least_prices(steps: list[list[tuple]], n_nodes: int) -> list[int]:
    """Feasible first prices: what every way on pays at least, step by step."""
    rest, prices = 0, [0] * n_nodes
    for i in range(len(steps) - 1, -1, -1):
        rest += min((a[2] for a in steps[i]), default=0)
        prices[4 * i:4 * i + 4] = [rest] * 4
    return prices


def auction(arcs: list[list[tuple]], prices: list[int], source: int, sink: int) -> int:
    """Shortest distance from ``source`` to ``sink``; ``prices`` become its dual prices.

    Prices never exceed cost plus price along any arc. A path grows from the source: its last
    node bids the least cost plus price of its arcs; below that its price is raised and the path
    gives the node up (contraction), at it the path takes the arc (extension). Cycles cost
    something, so it ends; ``arcs`` only lead to the sink and the source has some.
    """
    path = [source]
    while path[-1] != sink:
        node = path[-1]
        bid, to = min((cost + prices[to], to) for to, cost, _ in arcs[node])
        if prices[node] < bid:
            prices[node] = bid
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[source] - prices[sink]


def least_trace(arcs: list[list[tuple]], prices: list[int], source: int, sink: int) -> list[tuple]:
    """The (label, node) sequence of the least labels among all shortest ways.

    With converged prices the shortest ways are the ways of tight arcs. Arcs of one
    node have different labels, so the least label that still leads to the sink is taken each time.
    """
    tight = leading_to(
        [[a for a in out if prices[node] == a[1] + prices[a[0]]] for node, out in enumerate(arcs)], sink)
    found, node = [], source
    while node != sink:
        node, _, label = min(tight[node], key=lambda a: a[2])
        found.append((label, node))
    return found


@lru_cache(100_000)
def repair(codes: tuple[int, ...]) -> tuple[int, str]:
    """(cost, edits) of a whole conversation; a D stands for a whole step."""
    steps = [row_step(c) for c in codes]
    arcs = build(steps, inserts=True, closed=True)
    sink = len(arcs) - 1
    arcs = leading_to(arcs, sink)
    prices = least_prices(steps, len(arcs))
    cost = auction(arcs, prices, START, sink)
    return cost, "".join(label for label, _ in least_trace(arcs, prices, START, sink))


def summarise(steps: list[list[tuple]], inserts: bool) -> tuple[list[int], list[int]]:
    """The 16 costs (state in, state out; -1: no way) of a block, and the ranks of its least edits.

    Inserts before a row belong to its block, so edits of one block end with a row: none is
    the beginning of another, and comparing blocks one by one compares whole audits.
    """
    costs, ranks = [-1] * 16, [0] * 16
    whole = build(steps, inserts, closed=False)
    labels = {}
    for out in range(4):
        sink = 4 * len(steps) + out
        arcs, prices = leading_to(whole, sink), least_prices(steps, len(whole))
        for q in range(4):
            if arcs[q]:
                costs[4 * q + out] = auction(arcs, prices, q, sink)
                labels[q, out] = [label for label, _ in least_trace(arcs, prices, q, sink)]
    for q in range(4):
        for rank, out in enumerate(sorted((o for p, o in labels if p == q), key=lambda o: labels[q, o])):
            ranks[4 * q + out] = rank
    return costs, ranks


def trace_block(steps: list[list[tuple]], inserts: bool, entry: int, out: int) -> list[tuple]:
    """(label, state after it) of a block's least edits between two states."""
    sink = 4 * len(steps) + out
    arcs = leading_to(build(steps, inserts, closed=False), sink)
    prices = least_prices(steps, len(arcs))
    auction(arcs, prices, entry, sink)
    return [(label, node % 4) for label, node in least_trace(arcs, prices, entry, sink)]


def apply_edits(edits: str, codes: list[int], roles: list[str], texts: list[str], state: int) -> tuple[str, list[str]]:
    """(audit, repaired lines) of a block; ``edits`` has one D for a run of rows that go."""
    audit, lines, row = [], [], 0
    for edit in edits:
        if edit == "D":
            audit.append("D" * max(1, codes[row]))
        else:
            audit.append(edit)
            if edit == "K":
                role, text = roles[row], texts[row]
                state = _KEPT[role[0]][state]
            else:
                state = _NEXT[state]
                role, text = "user" if state == USER else "assistant", "" if edit == "I" else texts[row]
            lines.append(f"{role}:{text}")
        row += edit != "I"
    return "".join(audit), lines


# --- rows -----------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows after damage, equal ones folded with their number.

    ``conv`` is the id as text, empty for null. Nulls count as one space in the damage and below it.
    """
    space = F.lit(" ")
    turn, conv_id = F.col("turn"), F.col("conv_id")
    key = F.concat(F.coalesce(conv_id.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        conversation_key(conv_id).alias("conv"), turn.cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("times"), fault.alias("fault"),
    ).where(F.col("fault") != 0)
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("copies"))


def conversation_key(conv_id: Column) -> Column:
    """A non-null text that names a conversation."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def judged(rows: DataFrame) -> DataFrame:
    """Adds blank, truncated, and first: whether no row of an earlier turn has the same role and text.

    Equal rows of one turn are folded, so the first of them is no duplicate and its copies are.
    """
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.withColumns({
        "blank": bare == "", "truncated": ~F.substring(bare, -1, 1).isin(".", "!", "?"),
        "digest": F.sha2(F.col("text").cast("binary"), 256),
    })
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(
        F.min(turn).alias("least"), F.count("*").alias("turns"),
    ).where(F.col("turns") > 1).drop("turns")
    met = rows.join(again, ["conv", "role", "digest"], "left")
    return met.withColumn("first", F.col("least").isNull() | (F.col("least") == turn)).drop("least", "digest")


def conversation_counts(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of judged rows."""
    n, whole = F.col("copies"), F.lit(0).cast("long")
    per = rows.groupBy("conv").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
        F.sum(F.when(F.col("blank"), n).otherwise(whole)).alias("blank"),
        F.sum(F.when(F.col("blank"), whole).when(F.col("first"), n - 1).otherwise(n)).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("first") & F.col("truncated")).cast("long")).alias("truncated"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), whole)
    return per.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated")


BLOCKS = (
    "conv string, part long, number long, codes array<long>, roles array<string>, texts array<string>, "
    "first string, last string, illegal long"
)


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """Judged rows in order, as blocks of at most 64 lattice steps and about 4 MB of text.

    Rows are sorted by range over all conversations, so a long one spreads over
    partitions. (part, number) orders the blocks of a conversation.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, number, held, size, illegal = None, 0, [], 0, 0
        first = last = ""

        def block() -> pa.RecordBatch:
            codes, roles, texts = map(list, zip(*held))
            row = {"conv": conv, "part": part, "number": number, "codes": codes, "roles": roles, "texts": texts,
                   "first": first, "last": last, "illegal": illegal}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv"] != conv or len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                    yield block()
                    number = number + 1 if r["conv"] == conv else 0
                    held, size, illegal = [], 0, 0
                elif not held:
                    number = 0
                conv = r["conv"]
                initial, copies = r["role"][:1], r["copies"]
                if held:
                    illegal += last + initial not in _LEGAL
                else:
                    first = initial
                illegal += copies - 1  # a role never follows itself
                last = initial
                if not r["blank"] and r["first"]:
                    kind = initial if initial in _KEPT else "x"
                    held.append((row_code(kind, r["truncated"]), r["role"], r["text"]))
                    copies -= 1
                    size += len(r["text"])
                if copies:
                    held.append((copies, "", ""))
        if held:
            yield block()

    lists = pa.list_(pa.string())
    schema = pa.schema([
        ("conv", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("codes", pa.list_(pa.int64())),
        ("roles", lists), ("texts", lists), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
    ])
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.select("conv", "turn", "role", "text", "copies", "blank", "truncated", "first")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, BLOCKS)


# --- solving --------------------------------------------------------------------

RESULT = "conv string, illegal long, cost long, audit string, repaired_sha256 string"


def repair_single(blocks: DataFrame) -> DataFrame:
    """Results of conversations that are one block."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"conv": [], "illegal": [], "cost": [], "audit": [], "repaired_sha256": []}
            for b in batch.to_pylist():
                cost, edits = repair(tuple(b["codes"]))
                audit, lines = apply_edits(edits, b["codes"], b["roles"], b["texts"], START)
                digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
                for name, value in zip(out, (b["conv"], b["illegal"], cost, audit, digest)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([(n, pa.int64() if n in ("illegal", "cost") else pa.string())
                        for n in ("conv", "illegal", "cost", "audit", "repaired_sha256")])
    return blocks.mapInArrow(solve, RESULT)


NODES = "conv string, part long, number long, costs array<long>, ranks array<long>, first string, last string, illegal long"


def block_nodes(blocks: DataFrame) -> DataFrame:
    """Every block as costs and ranks between the states at its ends; without its texts."""
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [summarise([row_step(c) for c in codes], inserts=True) for codes in batch["codes"]]
            yield batch.drop(columns="codes").assign(costs=[p[0] for p in pairs], ranks=[p[1] for p in pairs])[_NODE_NAMES]

    return blocks.select("conv", "part", "number", "codes", "first", "last", "illegal").mapInPandas(summed, NODES)


_NODE_NAMES = [field.split()[0] for field in NODES.split(", ")]


def combine_nodes(nodes: DataFrame, by_part: bool) -> DataFrame:
    """One node for each group of at most 32 neighbours."""
    def combined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "number"])
        costs, ranks = summarise([block_step(c, r) for c, r in zip(group["costs"], group["ranks"])], inserts=False)
        first, last = group["first"].tolist(), group["last"].tolist()
        illegal = int(group["illegal"].sum()) + sum(a + b not in _LEGAL for a, b in zip(last, first[1:]))
        return pd.DataFrame({
            "conv": group["conv"].iloc[:1], "part": group["up_part"].iloc[:1], "number": group["up_number"].iloc[:1],
            "costs": [costs], "ranks": [ranks], "first": first[:1], "last": last[-1:], "illegal": illegal,
        })

    return _with_parents(nodes, by_part).groupBy("conv", "up_part", "up_number").applyInPandas(combined, NODES)


def _with_parents(nodes: DataFrame, by_part: bool) -> DataFrame:
    part, number = F.col("part"), F.col("number")
    return nodes.withColumns({
        "up_part": F.shiftright(part, _FAN_BITS) if by_part else part,
        "up_number": number if by_part else F.shiftright(number, _FAN_BITS),
    })


WAYS = "conv string, part long, number long, entry int, out int"


def choose_ends(nodes: DataFrame) -> DataFrame:
    """(conv, part, number, entry, out, cost, tail, illegal) of conversations that are one node."""
    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [
                min((c[q] + INSERT * _TAIL[q], r[q], q) for q in range(4) if c[q] >= 0)
                for c, r in zip(batch["costs"], batch["ranks"])
            ]
            yield batch[["conv", "part", "number"]].assign(
                entry=START, out=[q for _, _, q in ends], cost=[c for c, _, _ in ends],
                tail=[_TAIL[q] for _, _, q in ends], illegal=batch["illegal"])

    return nodes.mapInPandas(chosen, f"{WAYS}, cost long, tail int, illegal long")


def descend(nodes: DataFrame, ways: DataFrame, by_part: bool) -> DataFrame:
    """The states at both ends of every node, from those of the groups they were combined to."""
    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "number"])
        steps = [block_step(c, r) for c, r in zip(group["costs"], group["ranks"])]
        states = [state for _, state in trace_block(steps, False, int(group["entry"].iloc[0]), int(group["out"].iloc[0]))]
        return group[["conv", "part", "number"]].assign(entry=[int(group["entry"].iloc[0]), *states[:-1]], out=states)

    above = ways.select("conv", F.col("part").alias("up_part"), F.col("number").alias("up_number"), "entry", "out")
    keys = ["conv", "up_part", "up_number"]
    return _with_parents(nodes, by_part).join(above, keys).groupBy(keys).applyInPandas(spread, WAYS)


def repair_long(blocks: DataFrame) -> DataFrame:
    """Results of conversations of many blocks: costs combined upwards, states handed down, pieces joined in order."""
    levels, by_part = [materialize(block_nodes(blocks), "repair-nodes")], []
    while True:
        longest = levels[-1].groupBy("conv").agg(F.count("*").alias("n"), F.max("number").alias("k"))
        n, k = longest.agg(F.max("n"), F.max("k")).first()
        if (n or 0) <= 1:
            break
        by_part.append(k == 0)
        levels.append(materialize(combine_nodes(levels[-1], by_part[-1]), "repair-nodes"))
    ends = materialize(choose_ends(levels[-1]), "repair-ends")
    ways = ends
    for nodes, up in zip(levels[-2::-1], by_part[::-1]):
        ways = materialize(descend(nodes, ways, up), "repair-ways")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One conversation after the other; only the digest and the audit so far are held."""
        conv, digest, audit, begun, ending = None, None, [], False, None

        def finish() -> pa.RecordBatch:
            tail = _lines_after(ending["out_last"], ending["tail"])
            add(tail)
            row = {"conv": conv, "illegal": ending["all_illegal"], "cost": ending["cost"],
                   "audit": "".join(audit) + "I" * len(tail), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        def add(lines: list[str]) -> None:
            nonlocal begun
            for line in lines:
                digest.update(("\n" if begun else "").encode() + line.encode())
                begun = True

        for batch in batches:
            for b in batch.to_pylist():
                if b["conv"] != conv:
                    if conv is not None:
                        yield finish()
                    conv, digest, audit, begun, ending = b["conv"], hashlib.sha256(), [], False, b
                edits = "".join(e for e, _ in trace_block([row_step(c) for c in b["codes"]], True, b["entry"], b["out"]))
                done, lines = apply_edits(edits, b["codes"], b["roles"], b["texts"], b["entry"])
                audit.append(done)
                add(lines)
        if conv is not None:
            yield finish()

    schema = pa.schema([(n, pa.int64() if n in ("illegal", "cost") else pa.string())
                        for n in ("conv", "illegal", "cost", "audit", "repaired_sha256")])
    last = ends.select("conv", F.col("out").alias("out_last"), "tail", "cost", F.col("illegal").alias("all_illegal"))
    told = blocks.join(ways.select("conv", "part", "number", "entry", "out"), ["conv", "part", "number"]).join(last, "conv")
    return told.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(pieces, RESULT)


def _lines_after(state: int, inserts: int) -> list[str]:
    lines = []
    for _ in range(inserts):
        state = _NEXT[state]
        lines.append("user:" if state == USER else "assistant:")
    return lines


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows are damaged by a checksum of conv_id and turn (``damaged``), then judged and repaired in the order
    of their turn (null first; equal turns by role, then text, bytewise). The cheapest edits that
    give role initials ``(s?(ua)+)?`` are a shortest path over a lattice of rows and last roles, found by an
    auction; of equally cheap ones the ASCII-least audit is traced along the tight arcs of
    the converged prices.

    A conversation is cut in blocks of 64 rows, each reduced to costs between the four states at its
    ends and ranks of its audits; 32 at a time are combined by the same auction until one is left, and
    the states chosen are handed down again. So no task solves a whole long conversation; only the digest of
    its repaired text, which is sequential by definition, and its audit are
    written by one task, in a stream.

    Null text or role counts as one space: a blank row, a role that cannot be kept. A role with another initial
    than s, u or a (an empty one too) is never kept. Null turns come first and count for no gap;
    a null conv_id is a conversation of its own, its rows included. Repeated rows are duplicates. A
    conversation that loses all rows has zeros, an empty audit and the hash of an empty string. An empty
    table gives an empty result. Columns beside conv_id, turn, role and text are not read.
    """
    ids = conversations.select("conv_id", conversation_key(F.col("conv_id")).alias("conv")).distinct()
    rows = materialize(judged(materialize(damaged(conversations), "repair-damaged")), "repair-rows")
    blocks = materialize(conversation_blocks(rows), "repair-blocks")
    split = materialize(
        blocks.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("conv"), "repair-split")
    single = repair_single(blocks.join(split, "conv", "left_anti"))
    many = blocks.join(split, "conv", "left_semi")
    solved = single.union(repair_long(many)) if split.head(1) else single
    zero = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(conversation_counts(rows), "conv", "left").join(solved, "conv", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
