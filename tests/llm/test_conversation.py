"""Conversation repair against a search over all edits, and against a fold from the other end."""

import hashlib
import random
import zlib
from functools import cache
from itertools import product

import pytest

from lexiforge.llm import conversation as C
from lexiforge.llm.shared import Tables

from .fixtures import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(x for x in text if x not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def next_state(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def cheapest(turns):
    """(cost, audit) of turns (initial, forced, weak), by what follows a turn rather than by what is before it."""

    @cache
    def rest(i, state, inserts):
        found = [(0, "")] if i == len(turns) and state in ("", "a") else []
        if i < len(turns):
            initial, forced, weak = turns[i]
            edits = [(3, "D", state)]
            if not forced:
                edits += [(weak, "K", next_state(state, initial))] + [(2 + weak, "R", next_state(state, r)) for r in "ua"]
            for cost, letter, after in edits:
                if after is not None and (r := rest(i + 1, after, 0)):
                    found.append((cost + r[0], letter + r[1]))
        if inserts < 3:
            for role in "ua":
                if (after := next_state(state, role)) and (r := rest(i, after, inserts + 1)):
                    found.append((2 + r[0], "I" + r[1]))
        return min(found, default=None)

    return rest(0, "", 0)


def all_edits(turns):
    """The same by trying every audit with at most two inserts before each turn and at the end."""
    best = None
    for letters in product("KRD", repeat=len(turns)):
        for inserts in product(range(3), repeat=len(turns) + 1):
            state, cost, audit = "", 0, ""
            for i in range(len(turns) + 1):
                for _ in range(inserts[i]):
                    if state is not None:
                        state = next_state(state, "a" if state == "u" else "u")
                    cost, audit = cost + 2, audit + "I"
                if i < len(turns) and state is not None:
                    initial, forced, weak = turns[i]
                    x = letters[i]
                    audit += x
                    if x == "D":
                        cost += 3
                    else:
                        cost += weak + (2 if x == "R" else 0)
                        state = None if forced else next_state(state, initial if x == "K" else "a" if state == "u" else "u")
            if state in ("", "a") and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_hand(rows):
    ids = {r[0] for r in rows}
    rows, out = hurt(rows), {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns, stats = set(), [], [0, 0, 0, 0]
        for i, (_, _, role, text) in enumerate(mine):
            solid = text.strip(WHITE)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                stats[fault] += 1
            if i and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au"):
                stats[3] += 1
            turns.append((role[:1], fault in (0, 1), int(fault == 2)))
        cost, audit = cheapest(tuple(turns))
        numbers = {r[1] for r in mine if r[1] is not None}
        text, at, state = [], 0, ""
        for x in audit:
            if x != "D":
                role = mine[at][2] if x == "K" else {"u": "assistant"}.get(state, "user")
                text.append((role, "" if x == "I" else mine[at][3]))
                state = role[:1]
            at += x != "I"
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *stats, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in text).encode()).hexdigest()), text
    return out


def conversations(seed=5, n=60, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "a b c?", "", " ", "\t\n", "x.\r\n", "é ö", "Ende. ", " ", "end.\x0b"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, turn * 3]), rng.choice(["user", "assistant", "system", "assistant", "user", "tool", "", None, "User"]), rng.choice([*texts, f"{turn} told.", f"{turn} tol", None])))
    rows += rows[3:9]
    rows += [(1000, i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 7 else "same") for i in range(300)]
    rows += [(1001, None, "user", "hot.")] * 70 + [(1002, 5, "assistant", "x" * 20_000 + ".")] * 3 + [(1003, i // 50, "user", "again?") for i in range(200)]
    gone = next(i for i in range(1000) if zlib.crc32(f"1004:{i}".encode()) % 20 == 0)
    return rows + [(1004, gone, "user", "x")] * 40


def found(repair):
    rows = repair.conversations().collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sizes", [{}, {"long": 5, "chunk": 3}, {"long": 20, "chunk": 16, "chunk_bytes": 200}])
def test_against_the_other_end(spark, sizes):
    rows = conversations()
    want = by_hand(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    repair = C.Repair(C.damaged(C.keyed(with_clashes(frame))), Tables(spark), **sizes)
    got = found(repair)
    assert got == {k: v[0] for k, v in want.items()}
    turns: dict = {}
    for r in sorted(repair.turns().collect(), key=lambda r: (r.part, r.place)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {k: v[1] for k, v in want.items() if v[1]}


def test_against_all_edits(spark):
    rng = random.Random(2)
    for _ in range(60):
        turns = tuple((rng.choice("suatx"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randint(0, 4)))
        assert cheapest(turns) == all_edits(turns)


def test_empty_table(spark):
    assert C.Repair(C.damaged(C.keyed(spark.createDataFrame([], SCHEMA))), Tables(spark)).conversations().count() == 0
