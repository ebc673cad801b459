"""Conversation repair against a plain dynamic programme over whole audit strings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pitspark.llm import conversations as cv
from test_filters import rows

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
DDL = "conv_id long, turn long, role string, text string, copies long, part int, first string, blank boolean, fault int"
WS = " \t\n\x0b\x0c\r"


def damage(table):
    out = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        f = zlib.crc32(key.encode()) % 20
        out[conv]
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out[conv] += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain(table):
    result = []
    for conv, found in damage(table).items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip(WS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                          "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit, lines = plain_repair(found, faults)
        c = Counter(faults)
        result.append((conv, gaps, c["blank"], c["duplicate"], c["truncated"], illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(result)


def plain_repair(found, faults):
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(ways):
        ways = dict(ways)
        for _ in range(3):
            for q, (c, a, ls) in list(ways.items()):
                to = after[q]
                new = c + 3, a + "I", ls + [("user:" if to == "u" else "assistant:")]
                ways[to] = min(ways.get(to, new), new)
        return ways

    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip(found, faults):
        nxt = {}

        def offer(q, way):
            nxt[q] = min(nxt.get(q, way), way)

        for q, (c, a, ls) in with_inserts(ways).items():
            offer(q, (c + 4, a + "D", ls))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                offer(role[:1], (c + extra, a + "K", ls + [f"{role}:{text}"]))
            to = after[q]
            offer(to, (c + 3 + extra, a + "R", ls + [("user:" if to == "u" else "assistant:") + text]))
        ways = nxt
    return min(w for q, w in with_inserts(ways).items() if q in ("", "a"))


def frame(spark, table):
    return spark.createDataFrame([(*r, 1, 2, "x", True, 3) for r in table], DDL)


def made(seed, n_convs, longest):
    rng = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", None, "", "tool", "usher", "User"]
    texts = ["Yes.", "No!", "So?", "cut", "", None, " \t", "dot. ", "ünï.", "x\n", "a\nb."]
    for conv in range(n_convs):
        for turn in range(rng.randint(1, longest)):
            kind = rng.random()
            text = rng.choice(texts) if kind < 0.3 else f"line {rng.randrange(10**6)}" + rng.choice([".", ".", "!", ""])
            alternate = ["user", "assistant"][turn % 2]
            yield (
                None if conv == 3 else conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 2]),
                alternate if rng.random() < 0.5 else rng.choice(roles), text,
            )


@pytest.mark.parametrize("block, bits", [(64, 5), (3, 1)])
def test_repair_equals_plain_version(spark, monkeypatch, block, bits):
    monkeypatch.setattr(cv, "BLOCK_ROWS", block)
    monkeypatch.setattr(cv, "_FAN_BITS", bits)
    table = list(made(block, 60, 9)) + [(500, t, r, x) for _, t, r, x in made(7, 30, 12)]
    table += table[:5] + [(600, 4, "user", "same.")] * 70 + [(601, None, None, None)] * 3
    assert rows(cv.repair_conversations(frame(spark, table)), *COLUMNS) == plain(table)


def test_long_conversation_of_one_role(spark):
    table = [(1, i, "user", f"text {i}.") for i in range(400)] + [(2, i, "assistant", f"text {i}") for i in range(150)]
    table.append((3, 1, "user", "word " * 200_000 + "end."))
    assert rows(cv.repair_conversations(frame(spark, table)), *COLUMNS) == plain(table)


def test_lost_and_empty_conversations(spark):
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = cv.repair_conversations(frame(spark, [(gone, 0, "user", "hello.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.repair_conversations(frame(spark, []).limit(0)).count() == 0


def test_auction_prices_show_all_shortest_ways():
    # two ways of cost 3; the least labels win
    arcs = [[(1, 1, "b"), (2, 2, "a")], [(3, 2, "a")], [(3, 1, "z"), (1, 5, "b")], []]
    prices = [0] * 4
    assert cv.auction(arcs, prices, 0, 3) == 3
    assert [label for label, _ in cv.least_trace(arcs, prices, 0, 3)] == ["a", "z"]
