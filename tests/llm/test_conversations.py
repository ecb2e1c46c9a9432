"""Conversation repair against a plain search over all edits with their audits as strings."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from fathom.llm import conversations, queries

sys.setrecursionlimit(20_000)
HOSTILE = "conv_id long, turn long, role string, text string, none string, c string, mark string, part int, copy int"
SPACE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def order(row):
    return row[1] is not None, row[1] or 0, hashlib.sha256(f"{row[2]}\0{row[3]}".encode()).hexdigest()


def cheapest(rows, faults):
    """(cost, audit, repaired): the least of all edits; any number of rows may be put in, up to two at a place."""

    @lru_cache(None)
    def best(i, state, put):
        found = []
        if i == len(rows) and state in "0a":
            found.append((0, "", ()))
        nexts = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[nexts]
        if put < 3:
            c, a, r = best(i, nexts, put + 1)
            found.append((c + 3, "I" + a, (f"{name}:", *r)))
        if i < len(rows):
            role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                c, a, r = best(i + 1, nexts, 0)
                found.append((c + 3 + more, "R" + a, (f"{name}:{text}", *r)))
                initial = role[:1]
                if initial == nexts or initial == "s" and state == "0":
                    c, a, r = best(i + 1, initial, 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *r)))
        return min(found) if found else (10**9, "", ())

    return best(0, "0", 0)


def brute(rows, hurt=True):
    held = defaultdict(list)
    for r in rows:
        held[r[0]]
    for r in damage(rows) if hurt else [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows]:
        held[r[0]].append(r)
    out = []
    for conv, own in held.items():
        own.sort(key=order)
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, told = cheapest([r[2:] for r in own], faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed=4, n=150, most=14):
    rng = random.Random(seed)
    roles, ends = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"], [".", "!", "?", "", " ", ". \n", "。"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, most)):
            text = rng.choice(["same words", f"w{rng.randrange(9)}", "", "  \t", None, "one. two"])
            text = None if text is None else text + rng.choice(ends)
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(roles), text))
    rows += rows[:9]
    rows += [(None, 1, "user", "Nobody?"), (None, None, "assistant", "No."), (900, None, None, None), (901, 5, "user", "long. " * 20_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "c", "m", 1, 2) for r in rows], HOSTILE)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("long", [None, 0, 4])
def test_repair_equals_brute_force(spark, long):
    rows = talks()
    got = conversations.repair(conversations.damaged(frame(spark, rows)), long)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert told(got) == brute(rows)


def test_a_table_that_is_not_damaged(spark):
    rows = talks(8, 40, 9)
    assert told(conversations.repair(frame(spark, rows))) == brute(rows, False)


def test_a_conversation_of_all_rows_in_parts(spark):
    """Long, with rows that repeat, over several tasks."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["yes.", "no", "", f"text {t}."])) for t in range(400)] + [(1, 7, "user", "yes.")] * 30
    assert told(conversations.repair(frame(spark, rows), 100)) == brute(rows, False)


def test_edges(spark):
    none = frame(spark, [])
    assert told(conversations.repair(none)) == told(conversations.repair(conversations.damaged(none), 0)) == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    for long in (None, 0):
        assert told(conversations.repair(conversations.damaged(frame(spark, [(lost, 0, "user", "Hi.")])), long)) == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_halves_meet_in_the_least_audit():
    """Every sequence of kinds, short, and long random ones: the audit is the least of the cheapest."""
    rng = random.Random(1)
    roles = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    cases = [[a, b, c] for a in range(9) for b in range(9) for c in range(9)] + [[rng.randrange(9) for _ in range(rng.randrange(4, 40))] for _ in range(300)]
    for kinds in cases:
        rows = [(roles[min(k // 2, 3)], f"t{i}") for i, k in enumerate(kinds)]
        faults = ["blank" if k == 8 else "truncated" if k % 2 else "" for k in kinds]
        edits = []
        last = conversations.solve(bytes(kinds), 0, len(kinds), conversations.START, [c for c, _ in conversations.END], edits)
        cost, audit, lines = cheapest(rows, faults)
        assert "".join(edits) + conversations.END[last][1] == audit
        assert [f"{r}:{t}" for r, t in [*conversations.edited(iter(rows), edits, conversations.START), *conversations.closing(last)]] == list(lines)


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.queries()["op12_conversation_repair"](spark, folder)) == brute(rows)
