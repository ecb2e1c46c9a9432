"""Repair of the structure of conversations by cheapest edits, reconstructed by Hirschberg's divide and conquer.

A conversation is right if the initials of its roles are nothing or an optional s and then pairs ua. Reading one from the left is
in one of four states: nothing yet, after s, after u, after a. Rows are kept, reroled or deleted, and rows may be put in; the
edits' initials in order are the audit, and of all cheapest repairs the one whose audit is least is taken.

Forward and backward vectors of four costs meet in the middle of a conversation: states whose costs add up to the least are
on cheapest repairs. The forward vector also has the order of the least audits that lead to each state. An audit of some rows ends
with the last one's edit (rows put in count to the next), so none is the beginning of another, and the crossing of the least audit is the optimal state that
comes first in that order. Both halves are then solved alone. Nothing but a few vectors is held.

Conversations of up to LONG rows are solved where their rows meet. The rows of longer ones are sorted over all tasks, a task's part
of a conversation is summed up as what it costs from each state to each, a row a part tells where parts meet, and each part
is then solved by itself. Only the digest of the repaired text has to be taken in one go, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, shuffle_partitions

#: Rows, and bytes of text, up to which a conversation is solved in one piece.
LONG, LONG_BYTES = 50_000, 64_000_000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The pairs of initials that may follow each other.
PAIRS = {"su", "ua", "au"}
INFINITE = 1 << 60
#: Kinds of rows: 2 * place in "sua" (3 for any other initial) + 1 if cut off, or MUST for rows that have to go.
MUST = 8
#: The least cost, and the edits, that end a conversation in each state.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def kind_of(initial: str, cut: bool) -> int:
    return 2 * ("sua".find(initial) if initial else 3) % 8 + cut


def _moves(kind: int) -> list[list[tuple[int, int, str]]]:
    """By state, (state after, cost, edits) of a row of this kind, with or without a row put in before. Two put in are never part of a
    cheapest repair: left out, or with a lone s deleted, they make it cheaper."""
    nexts = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by rerole or insert

    def plain(s: int) -> list[tuple[int, int, str]]:
        out = [(s, DELETE, "D")]
        if kind != MUST:
            initial, more = kind // 2, CUT * (kind % 2)
            out.append((nexts[s], REROLE + more, "R"))
            if initial == 0 and s == START:
                out.append((SYSTEM, KEEP + more, "K"))
            elif (initial, nexts[s]) in ((1, USER), (2, ASSISTANT)):
                out.append((nexts[s], KEEP + more, "K"))
        return out

    found = []
    for s in range(4):
        best: dict[int, tuple[int, str]] = {}
        # nothing but s may stand before what a start allows, so a row put in at the start moves on as any other
        for t, cost, edits in plain(s) + [(t, INSERT + c, "I" + e) for t, c, e in plain(nexts[s])]:
            best[t] = min(best.get(t, (INFINITE, "")), (cost, edits))
        found.append([(t, c, e) for t, (c, e) in best.items()])
    return found


MOVES = [_moves(k) for k in range(MUST + 1)]


def forward(kinds: bytes, lo: int, hi: int, costs: list[int], order: list[int]) -> tuple[list[int], list[int]]:
    """Costs of the states after rows lo to hi, from those before, and the order of the least audits that lead to them."""
    for k in kinds[lo:hi]:
        best = [(INFINITE, 9, "")] * 4
        for s in range(4):
            if (c := costs[s]) < INFINITE:
                for t, more, edits in MOVES[k][s]:
                    if (found := (c + more, order[s], edits)) < best[t]:
                        best[t] = found
        costs = [b[0] for b in best]
        ways = sorted(range(4), key=lambda t: best[t][1:])
        order = [ways.index(t) for t in range(4)]
    return costs, order


def backward(kinds: bytes, lo: int, hi: int, costs: list[int]) -> list[int]:
    """Costs from the states before rows lo to hi to the end, from those after."""
    for k in reversed(kinds[lo:hi]):
        costs = [min(more + costs[t] for t, more, _ in MOVES[k][s]) for s in range(4)]
    return costs


def only(state: int) -> list[int]:
    return [0 if s == state else INFINITE for s in range(4)]


def crossing(costs: list[int], order: list[int], rest: list[int]) -> int:
    """The state in which the least of the cheapest audits crosses."""
    return min(range(4), key=lambda s: (costs[s] + rest[s], order[s]))


def solve(kinds: bytes, lo: int, hi: int, entry: int, after: list[int], out: list[str]) -> int:
    """Append the edits of each row of lo to hi, from a state to the costs after them; gives the state they end in."""
    if hi - lo == 0:
        return entry
    if hi - lo == 1:
        t, _, edits = min(MOVES[kinds[lo]][entry], key=lambda m: (m[1] + after[m[0]], m[2]))
        out.append(edits)
        return t
    mid = (lo + hi) // 2
    costs, order = forward(kinds, lo, mid, only(entry), [0] * 4)
    met = crossing(costs, order, backward(kinds, mid, hi, after))
    solve(kinds, lo, mid, entry, only(met), out)
    return solve(kinds, mid, hi, met, after, out)


def edited(rows: Iterator[tuple[str, str]], edits: list[str], state: int) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits of each row, from a state."""
    names = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
    to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    for (role, text), own in zip(rows, edits):
        for edit in own:
            if edit == "D":
                continue
            named = role if edit == "K" else names[state]
            state = to[named[0]]
            yield named, "" if edit == "I" else text


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults put in, and live = false for a row that was dropped, which is left as a conversation's mark.

    Nulls become one space, but for conv_id and turn themselves, which stay. By crc32(`conv_id:turn`) % 20 a row is 0 dropped, 1 emptied, 2 without its . ! ?,
    3 there twice, 4 the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    live = hit != 0
    there = lambda c: F.when(live, c)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        there(F.col("turn").cast("long")).alias("turn"),
        there(F.when(hit == 4, "user").otherwise(said("role"))).alias("role"),
        there(text).alias("text"),
        live.alias("live"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _named(rows: DataFrame) -> DataFrame:
    """(none, c, turn, role, text, live, mark): conversations by columns without nulls; mark orders rows of one turn."""
    live = F.coalesce(F.col("live"), F.lit(True)) if "live" in rows.columns else F.lit(True)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    mark = F.sha2(F.concat_ws("\x00", role, text).cast("binary"), 256)
    conv = F.col("conv_id").cast("long")
    return rows.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("c"), F.col("turn").cast("long").alias("turn"), F.when(live, role).alias("role"), F.when(live, text).alias("text"), live.alias("live"), F.when(live, mark).alias("mark"))


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = [x.split()[0] for x in FIGURES.split(", ")]


def _ordered() -> list[Column]:
    return [F.col("none"), F.col("c"), F.asc_nulls_first("turn"), F.col("mark")]


class _Whole:
    """A conversation that is taken in row by row."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.kinds = bytearray()
        self.turns: set[int] = set()
        self.seen: set[str] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, mark: str) -> None:
        told = text.rstrip(SPACE)
        if not told:
            kind, self.blank = MUST, self.blank + 1
        elif mark in self.seen:
            kind, self.duplicate = MUST, self.duplicate + 1
        else:
            cut = told[-1] not in ".!?"
            self.truncated += cut
            kind = kind_of(role[:1], cut)
        self.seen.add(mark)
        if self.rows and self.rows[-1][0][:1] + role[:1] not in PAIRS:
            self.illegal += 1
        if turn is not None:
            self.turns.add(turn)
        self.kinds.append(kind)
        self.rows.append((role, text))

    def figures(self) -> tuple:
        edits: list[str] = []
        kinds = bytes(self.kinds)
        last = solve(kinds, 0, len(kinds), START, [c for c, _ in END], edits)
        cost = backward(kinds, 0, len(kinds), [c for c, _ in END])[START]
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in [*edited(iter(self.rows), edits, START), *closing(last)]).encode("utf-8", "surrogatepass"))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(edits) + END[last][1], sha.hexdigest()


def closing(state: int) -> list[tuple[str, str]]:
    """The rows that are put in at the end."""
    return {SYSTEM: [("user", ""), ("assistant", "")], USER: [("assistant", "")]}.get(state, [])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to a row a conversation."""
    name, held, out = None, None, []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out))
        types = [pa.bool_(), pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["none", "c", *_COLUMNS])
        out.clear()
        return batch

    for batch in batches:
        for none, c, turn, role, text, live, mark in zip(*(batch.column(x).to_pylist() for x in ("none", "c", "turn", "role", "text", "live", "mark"))):
            if (none, c) != name:
                if held is not None:
                    out.append((*name, *held.figures()))
                name, held = (none, c), _Whole()
            if live:
                held.add(turn, role, text, mark)
        if out:
            yield made()
    if held is not None:
        out.append((*name, *held.figures()))
        yield made()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of one (part, none, c): the name and the rows."""
    name, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != name:
                if held:
                    yield name, held
                name, held = row[:3], []
            held.append(row[3:])
    if held:
        yield name, held


def _kinds(rows: list[tuple]) -> bytes:
    """Of rows (place, turn, role, n, blank, again, cut, ...): n equal rows, of which all but the first are duplicates."""
    out = bytearray()
    for _, _, role, n, blank, again, cut, *_ in rows:
        out.append(MUST if blank or again else kind_of(role[:1], cut))
        out += bytes([MUST]) * (n - 1)
    return bytes(out)


_LIGHT = ["part", "none", "c", "place", "turn", "role", "n", "blank", "again", "cut"]
_SUMMED = "none boolean, c long, part int, costs array<long>, orders array<int>, turns array<long>, counts array<long>, ends array<string>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a part of a conversation: costs and orders from each state to each; first, last, least, greatest turn and how many; counts of faults; outer initials."""
    for (part, none, c), rows in _segments(batches):
        kinds = _kinds(rows)
        ways = [forward(kinds, 0, len(kinds), only(s), [0] * 4) for s in range(4)]
        turns = [r[1] for r in rows]
        known = [t for t in turns if t is not None]
        changes = sum(a != b for a, b in zip(known, known[1:])) + bool(known)
        blank = sum(r[3] for r in rows if r[4])
        duplicate = sum(r[3] - 1 + r[5] for r in rows if not r[4])
        truncated = sum(r[6] for r in rows if not r[4] and not r[5])
        first = [r[2][:1] for r in rows]
        illegal = sum(r[3] - 1 for r in rows) + sum(a + b not in PAIRS for a, b in zip(first, first[1:]))
        values = [
            [none], [c], [part], [sum((w[0] for w in ways), [])], [sum((w[1] for w in ways), [])],
            [[turns[0], turns[-1], min(known, default=None), max(known, default=None), changes]],
            [[blank, duplicate, truncated, illegal]], [[first[0], first[-1]]],
        ]
        types = [pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[x.split()[0] for x in _SUMMED.split(", ")])


_MET = "none boolean, c long, part int, entry int, leave int, last int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _met(parts: pd.DataFrame) -> pd.DataFrame:
    """Where the parts of a conversation meet, and its figures; a row a part, of which there are at most as many as tasks."""
    parts = parts.sort_values("part")
    costs, order, vectors = only(START), [0] * 4, []
    for own, ways in zip(parts["costs"], parts["orders"]):
        best = [min((costs[s] + int(own[4 * s + t]), order[s], int(ways[4 * s + t])) for s in range(4)) for t in range(4)]
        costs = [min(b[0], INFINITE) for b in best]
        ranks = sorted(range(4), key=lambda t: best[t][1:])
        order = [ranks.index(t) for t in range(4)]
        vectors.append((costs, order))
    after, states = [c for c, _ in END], []
    for (at, way), own in zip(reversed(vectors), reversed(list(parts["costs"]))):
        states.append(crossing(at, way, after))
        after = [min(int(own[4 * s + t]) + after[t] for t in range(4)) for s in range(4)]
    states = [START, *reversed(states)]
    blank, duplicate, truncated, illegal = (sum(int(x[k]) for x in parts["counts"]) for k in range(4))
    ends, turns = list(parts["ends"]), [[None if pd.isna(t) else int(t) for t in x] for x in parts["turns"]]
    illegal += sum(a[1] + b[0] not in PAIRS for a, b in zip(ends, ends[1:]))
    distinct = sum(t[4] for t in turns) - sum(a[1] is not None and a[1] == b[0] for a, b in zip(turns, turns[1:]))
    known = [t for t in turns if t[4]]
    gaps = max(t[3] for t in known) - min(t[2] for t in known) + 1 - distinct if known else 0
    found = {"none": parts["none"], "c": parts["c"], "part": parts["part"], "entry": states[:-1], "leave": states[1:], "last": states[-1], "gaps": gaps}
    return pd.DataFrame(found | {"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": after[START]})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts that know where they meet to (part, place, edits, lines); a line is a role and whether the row's text follows."""
    for (part, _, _), rows in _segments(batches):
        kinds, entry, leave = _kinds(rows), *rows[0][7:9]
        edits: list[str] = []
        solve(kinds, 0, len(kinds), entry, only(leave), edits)
        done, out, state = 0, [], entry
        for place, _, role, n, *_ in rows:
            own = edits[done : done + n]
            done += n
            lines = list(edited(iter([(role, "text")] * n), own, state))
            if lines:
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[lines[-1][0][0]]
            out.append((part, place, "".join(own), [{"role": r, "own": bool(t)} for r, t in lines]))
        types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("own", pa.bool_())]))]
        for lo in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 10_000]), types)], names=["part", "place", "edits", "lines"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (none, c, last, edits, piece) to (none, c, audit, repaired_sha256): a conversation's pieces stream through one digest."""
    name, last, edits, sha, started = None, START, [], hashlib.sha256(), False

    def made() -> pa.RecordBatch:
        for role, text in closing(last):
            add(f"{role}:{text}")
        values = [[name[0]], [name[1]], ["".join(edits) + END[last][1]], [sha.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.bool_(), pa.int64(), pa.string(), pa.string()])], names=["none", "c", "audit", "repaired_sha256"])

    def add(piece: str) -> None:
        nonlocal started
        sha.update((("\n" if started else "") + piece).encode("utf-8", "surrogatepass"))
        started = True

    for batch in batches:
        for none, c, state, own, piece in zip(*(batch.column(x).to_pylist() for x in ("none", "c", "last", "edits", "piece"))):
            if (none, c) != name:
                if name is not None:
                    yield made()
                name, last, edits, sha, started = (none, c), state, [], hashlib.sha256(), False
            edits.append(own)
            if piece is not None:
                add(piece)
    if name is not None:
        yield made()


def _in_parts(rows: DataFrame) -> DataFrame:
    """(none, c, figures) of long conversations. Their rows are sorted over all tasks; only costs, states and edits are worked out in Python, texts stay aside."""
    tasks = shuffle_partitions(rows.sparkSession)
    told = F.rtrim("text", F.lit(SPACE))
    own = rows.groupBy("none", "c", "turn", "mark").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = rows.groupBy("none", "c", "mark").agg(F.min(when).alias("first"))
    marked = own.join(firsts, ["none", "c", "mark"]).withColumns({"again": F.col("first") != when, "blank": told == "", "cut": ~F.right(told, F.lit(1)).isin(".", "!", "?")})
    ordered = marked.drop("first").repartitionByRange(tasks, *_ordered()).sortWithinPartitions(*_ordered())
    table = settle(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    light = table.select(*_LIGHT)
    by_part = lambda df: df.repartition(tasks, "part").sortWithinPartitions("part", "none", "c", "place")
    states = settle(by_part(light).mapInArrow(_summed, _SUMMED).groupBy("none", "c").applyInPandas(_met, _MET))
    known = light.join(states.select("part", "none", "c", "entry", "leave"), ["part", "none", "c"]).select(*_LIGHT, "entry", "leave")
    edits = by_part(known).mapInArrow(_edits, "part int, place long, edits string, lines array<struct<role: string, own: boolean>>")
    joined = table.select("none", "c", "part", "place", "text").join(edits, ["part", "place"]).join(states.select("none", "c", "part", "last"), ["none", "c", "part"])
    line = lambda x: F.concat(x["role"], F.lit(":"), F.when(x["own"], F.col("text")).otherwise(""))
    pieces = joined.select("none", "c", "part", "place", "last", "edits", F.when(F.size("lines") > 0, F.array_join(F.transform("lines", line), "\n")).alias("piece"))
    digests = pieces.repartition("none", "c").sortWithinPartitions("none", "c", "part", "place").mapInArrow(_digested, "none boolean, c long, audit string, repaired_sha256 string")
    figures = states.groupBy("none", "c").agg(*[F.first(x).alias(x) for x in _COLUMNS[:6]])
    return digests.join(figures, ["none", "c"]).select("none", "c", *_COLUMNS)


def repair(rows: DataFrame, long_rows: int | None = None, long_bytes: int | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text) to a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows are taken by turn, nulls first, and rows of one turn by a hash of role and text. A row's first fault counts: blank, duplicate
    (role and text stood earlier), truncated (the last character that is no white space is not . ! ?). gaps are turns that are missing between the
    least and the greatest, illegal the adjacent initials that are none of su, ua, au. Keeping a row costs 0, reroling to user or assistant 3, deleting 4,
    which blank and duplicate rows have to be, putting in an empty row 3; truncated rows that stay cost 3 more. Null roles and texts are one space; an
    empty role fits nowhere. Null conv_ids are one conversation. Rows with live = false, if there is such a column, only say that their conversation exists; without any other
    row it has zeros, an empty audit and the digest of nothing. Other columns are ignored. Conversations of more than long_rows rows, or long_bytes of text, are solved in parts.
    """
    most, weight = LONG if long_rows is None else long_rows, LONG_BYTES if long_bytes is None else long_bytes
    ship(rows.sparkSession)
    named = _named(rows)
    sizes = named.groupBy("none", "c").agg(F.count_if("live").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    long = settle(sizes.where((F.col("n") > most) | (F.col("bytes") > weight)).select("none", "c"))
    there = not long.isEmpty()
    short = named.join(long, ["none", "c"], "left_anti") if there else named
    kinds = f"none boolean, c long, {FIGURES}"
    found = short.repartition("none", "c").sortWithinPartitions(*_ordered()).mapInArrow(_short, kinds)
    if there:
        found = found.unionByName(_in_parts(named.where("live").join(long, ["none", "c"], "left_semi")))
    return found.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), *_COLUMNS)
