"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Plan, for documents x with shingle sets S(x) and a threshold of p percent:

1. facts: one scan gives each row its set size and a 64-bit name of its set
   (equal sets share a name, so copies collapse before anything is joined), and
   shingles that stand out as frequent inside a chunk of rows. Summed over the
   corpus these give `heavy`, a list of bounded length that only fixes the
   global order of shingles: light ones first, then heavy by rising frequency.
   Any order gives the same result; this one keeps frequent shingles out of the
   short lists.
2. routing: partners of sizes n and m differ in at most d = (n + m)(100 - p)/(100 + p)
   shingles. For each class of sizes the light shingles are split by hash into
   more parts than d, so partners agree in all of some part; a set is routed by each of its parts
   that holds two shingles or more. Where a set has too few of these to be sure of one (short texts, mostly
   heavy ones), it is also routed by its first n - T + 1 shingles in the global order, one of which any partner
   has, T = ceil(n * p / 100). Routes are grouped by range of hash; each
   route ties its sets to one anchor (linear in the route's length, pre-tied on the map
   side), never pair by pair.
3. groups: the components of these ties hold all links.
4. blocks: each group is cut into blocks of bounded size, and a block is searched with
   DivideSkip: a query's longest lists are set aside, its short ones are
   heap-merged, sets that occur often enough are probed in the long ones by
   binary search. Sets already known to be connected are not verified again, and of the
   largest connected part no set needs to be a query.
5. across blocks: of a group of several blocks, first one set of each connected part of each block are searched among
   themselves. Where a group is still in several parts, the sets outside its largest part, and only these, meet all its blocks. If that
   would send sets more than COPIES times on average, these groups are routed again among themselves first, with a list of what is frequent there,
   apart for each class of sizes and each group.
6. links: the components of the verified links are the result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, passing, settle, ship, shuffle_partitions
from .components import components

#: Shingles in one chunk of rows while frequent ones are sought, and routes tied at a time.
CHUNK, ROUTES = 1_000_000, 500_000
#: Length of the list of frequent shingles, and the frequency from which a shingle counts as frequent.
HEAVY, HEAVY_FROM = 500_000, 10
#: Sets, and shingles, in a block.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
#: Rows of numbers up to which a table is broadcast; beyond that it is joined, spread over slices where keys may be hot.
BROADCAST_ROWS, SLICES = 500_000, 16
#: Times that a set may be sent to search across blocks, on average, before groups are routed again; and how often they are.
COPIES, ROUNDS = 8, 2


#: White space to blanks, A-Z to a-z.
_PLAIN = bytes(32 if bytes([b]) in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r") else LOWER[b] for b in range(256))
_KEEP = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time.
LONG = 64


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text: a sum of mixed groups of eight bytes, each by its place; a cryptographic hash of words of over LONG bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    raw = np.frombuffer(b" " + data + b" " * 9, np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    total = mix((eight[starts] & _KEEP[np.minimum(sizes, 8)]) + _PLACES[0]) + sizes.astype(np.uint64)
    for j in range(1, LONG // 8):
        more = np.flatnonzero(sizes > 8 * j)
        if not len(more):
            return total
        total[more] += mix((eight[starts[more] + 8 * j] & _KEEP[np.minimum(sizes[more] - 8 * j, 8)]) + _PLACES[j])
    for k in np.flatnonzero(sizes > LONG).tolist():
        total[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little")
    return total


_PLACES = mix(np.arange(1, LONG // 8 + 1, dtype=np.uint64))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; none for null or blank texts."""
    hashes = word_hashes(text or "")
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    place = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.full(len(hashes) - k + 1, k, np.uint64)
    for j in range(k):
        total += hashes[j : len(hashes) - k + 1 + j] * place[j]
    total = np.sort(mix(total))
    new = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def set_name(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n shingles has with any partner."""
    return -(-n * percent // 100)


def linked(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


# -- 1: facts -----------------------------------------------------------------


def _frequent(parts: list[np.ndarray]) -> bytes | None:
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    often = counts > 1
    if not often.any():
        return None
    return np.concatenate([values[often].view(np.int64), counts[often].astype(np.int64)]).tobytes()


def _facts(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.int64()), ("often", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, set()
        for batch in batches:
            ids, sizes, names, often = batch.column("doc_id").to_pylist(), [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), words)
                sizes.append(len(h))
                names.append(set_name(h) if len(h) else None)
                if len(h) and names[-1] not in seen:  # copies within a chunk say nothing about frequency
                    seen.add(names[-1])
                    parts.append(h)
                    held += len(h)
                if held >= CHUNK:
                    often.append(_frequent(parts))
                    parts, held, seen = [], 0, set()
            often = [x for x in often if x]
            marks = batch.column("mark").to_pylist() + [None] * len(often)
            yield pa.RecordBatch.from_arrays([pa.array(ids + [None] * len(often), pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes + [-1] * len(often), pa.int64()), pa.array(names + [None] * len(often), pa.int64()), pa.array([None] * len(ids) + often, pa.binary())], schema=schema)
        if parts and (last := _frequent(parts)):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([last], pa.binary())], schema=schema)

    return run


def _named(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shingles(text.as_py(), words) for text in batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([set_name(h) if len(h) else None for h in found], pa.int64()), batch.column("text")], names=["name", "text"])

    return run


def _unpack_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("often").to_pylist():
            both = np.frombuffer(blob, np.int64)
            half = len(both) // 2
            yield pa.RecordBatch.from_arrays([pa.array(both[:half]), pa.array(both[half:])], names=["g", "c"])


def _heavy(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY shingles, sorted, and their counts: a fixed bound, whatever the input."""
    rows = facts.where("n_shingles < 0").select("often").mapInArrow(_unpack_often, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") >= HEAVY_FROM).orderBy(F.desc("c"), "g").limit(HEAVY).toArrow()
    g, c = rows.column("g").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


# -- 2: routing ---------------------------------------------------------------


def prefix(h: np.ndarray, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - T + 1 shingles in the global order (light by hash, then heavy by frequency and hash)."""
    size = len(h) - needed(len(h), percent) + 1
    g, c = heavy
    if not len(g):
        return h[:size]
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    is_heavy = g[at] == h
    light = h[~is_heavy][:size]
    if len(light) == size:
        return light
    rest, often = h[is_heavy], c[at[is_heavy]]
    return np.concatenate([light, rest[np.lexsort((rest, often))][: size - len(light)]])


#: Sizes at which the next class of sizes begins, half an octave apart; shingles to a part in a class's largest set.
_ABOVE = sorted({math.ceil(2 ** (k / 2)) for k in range(2, 80)})
PART = 3


def classes_of(n: int, percent: int) -> list[int]:
    """The classes of sizes in which a set of n shingles may meet partners as large as it or larger: its own and those above that hold possible ones."""
    own = bisect_right(_ABOVE, n)
    out = [own]
    while n * 100 >= percent * _ABOVE[out[-1]]:
        out.append(out[-1] + 1)
    return out


def routes(h: np.ndarray, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(class of sizes, keys) of a set, such that linked sets have a key in common.

    A pair meets in the class of its larger set; a set therefore stands in its own class and in those
    above that hold possible partners. Of the parts of a class at most d differ between partners; if more than d
    parts of either set hold two light shingles or more, one of these is the same in both.
    """
    n = len(h)
    g, _ = heavy
    light = h if not len(g) else h[g[np.minimum(np.searchsorted(g, h), len(g) - 1)] != h]
    out = []
    for k in classes_of(n, percent):
        top = min(_ABOVE[k] - 1, n * 100 // percent)
        differ = (100 - percent) * (n + top) // (100 + percent)
        parts = max(1, _ABOVE[k] // PART)
        salt = mix(np.array([k], np.uint64))
        held, keys = 0, []
        if len(light):
            mixed = mix(light ^ salt)
            part = (mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            several = np.diff(np.append(first, len(part))) > 1
            sums = np.add.reduceat(mix(mixed[order] + np.uint64(1)), first)
            held = int(several.sum())
            keys.append(mix(sums[several] + salt * (part[first[several]] + np.uint64(1))))
        if held <= differ:
            keys.append(mix(prefix(h, percent, heavy) + salt * np.uint64(3)))
        out.append((k, np.unique(np.concatenate(keys))))
    return out


def _tie(g: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One posting a list, (g, anchor), and the ties (name, anchor) of the others."""
    order = np.lexsort((name, g))
    g, name = g[order], name[order]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    anchor = name[first][np.cumsum(first) - 1]
    apart = anchor != name
    ties = np.unique(np.stack([name[apart], anchor[apart]], 1), axis=0)
    return g[first], name[first], ties[:, 0], ties[:, 1]


def _postings(words: int, percent: int, heavy, buckets: int, again: bool):
    """Rows (text, root, only) to packed routes and ties. again: routes and nodes of their own for each group `root` and class of sizes (`only` that one, if
    it is not null); else a node is a set."""

    def out(gs: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, name, u, v = _tie(np.concatenate(gs), np.concatenate(nodes))
        bucket = (g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, False, np.concatenate([g[lo:hi].view(np.int64), name[lo:hi]]).tobytes()) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
        if len(u):
            rows.append((int(abs(int(u[0]))) % buckets, True, np.concatenate([u, v]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "tied", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = heavy.value
        gs, nodes, held, seen = [], [], 0, set()
        for batch in batches:
            for text, root, only in zip(batch.column("text"), batch.column("root").to_pylist(), batch.column("only").to_pylist()):
                h = shingles(text.as_py(), words)
                if not len(h) or ((name := set_name(h)), root) in seen:
                    continue
                seen.add((name, root))
                for k, keys in routes(h, percent, order):
                    if only is not None and k != only:
                        continue
                    if again:
                        keys = mix(keys ^ np.uint64(root & _MASK))
                    gs.append(keys)
                    nodes.append(np.full(len(keys), node(name, root, k) if again else name, np.int64))
                    held += len(keys)
                if held >= ROUTES:
                    yield from out(gs, nodes)
                    gs, nodes, held, seen = [], [], 0, set()
        if gs:
            yield from out(gs, nodes)

    return run


_MASK = 2**64 - 1


def node(name: int, root: int, k: int) -> int:
    """The number of a set of a group in a class of sizes."""
    return int(mix(mix(np.array([name & _MASK], np.uint64)) + np.uint64((root * 0x9E3779B97F4A7C15 + k) & _MASK)).view(np.int64)[0])


def _nodes(percent: int):
    """(node, name, n_shingles, only) for each class of sizes that a set of a group stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(node(name, root, k), name, n, k) for name, n, root, only in zip(*(batch.column(c).to_pylist() for c in ("name", "n_shingles", "root", "only"))) for k in classes_of(n, percent) if only in (None, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["node", "name", "n_shingles", "only"])

    return run


def _halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gs, names, us, vs = [], [], [], []
    for batch in batches:
        for tied, blob in zip(batch.column("tied").to_pylist(), batch.column("packed").to_pylist()):
            a, b = _halves(blob)
            (us if tied else gs).append(a)
            (vs if tied else names).append(b)
    if gs:
        _, _, u, v = _tie(np.concatenate(gs).view(np.uint64), np.concatenate(names))
        us.append(u)
        vs.append(v)
    if us:
        ties = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ties[:, 0]), pa.array(ties[:, 1])], names=["u", "v"])


# -- 3: T-occurrence search -----------------------------------------------------


class DivideSkip:
    """Inverted lists over sets of rising size; finds the sets that share at least T shingles with a query. A list is a slice of one array of set numbers."""

    def __init__(self, sets: list[np.ndarray], weight: float = 0.01):
        self.weight = weight
        self.sizes = [len(s) for s in sets]
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        first = np.flatnonzero(np.append(np.ones(min(1, len(every)), bool), every[1:] != every[:-1]))
        self.shingles, self.starts = every[first], np.append(first, len(every))

    def _lists(self, at: np.ndarray, lo: int, hi: int) -> list[list[int]]:
        """The lists of these shingles, as far as their sets are from lo to hi; empty ones are left out."""
        starts, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        flat = self.owner[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
        if lo or hi < len(self.sizes):
            kept = (flat >= lo) & (flat < hi)
            ends = np.append(0, np.cumsum(kept))[ends]
            flat = flat[kept]
        every, cuts = flat.tolist(), ends.tolist()
        return [every[i:j] for i, j in zip([0, *cuts], cuts) if j > i]

    def search(self, query: np.ndarray, need: int, skip=lambda k: False, lo: int = 0, hi: int | None = None, own: bool = False) -> Iterator[tuple[int, int]]:
        """(set, overlap) for sets from lo to hi with overlap >= need, in rising number; those that skip(k) names are passed over when they come up.

        own: the query is one of the sets, and not asked for; lists that hold it alone are no matter then.
        """
        if not len(self.shingles) or need < 1:
            return
        hi = len(self.sizes) if hi is None else hi
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        lengths = self.starts[at + 1] - self.starts[at]
        if own:
            at, lengths = at[lengths > 1], lengths[lengths > 1]
        if len(at) < need:
            return
        order = np.argsort(lengths, kind="stable")
        at = at[order]
        aside = min(need - 1, max(0, math.floor(need / (self.weight * math.log2(int(lengths[order[-1]]) + 1) + 1))), len(at) - 1)
        short, long = self._lists(at[: len(at) - aside], lo, hi), at[len(at) - aside :].tolist()
        least = need - aside
        found, counts = [], []
        heap = [(x[0], i, 0) for i, x in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            k, count = heap[0][0], 0
            while heap and heap[0][0] == k:
                _, i, place = heap[0]
                count += 1
                place += 1
                if place < len(short[i]):
                    heapq.heapreplace(heap, (short[i][place], i, place))
                else:
                    heapq.heappop(heap)
            if count >= least and not skip(k):
                found.append(k)
                counts.append(count)
        ks, overlap = np.array(found, np.int64), np.array(counts, np.int64)
        for left, k in zip(range(len(long), 0, -1), long):  # binary search in each long list for all that can still make it
            fits = overlap + left >= need
            ks, overlap = ks[fits], overlap[fits]
            if not len(ks):
                return
            x = self.owner[self.starts[k] : self.starts[k + 1]]
            place = np.searchsorted(x, ks)
            overlap += x[np.minimum(place, len(x) - 1)] == ks
        for k, n in zip(ks.tolist(), overlap.tolist()):
            if n >= need and not skip(k):
                yield k, n


class Union:
    """Classes of numbers; `held` counts the members among `counted` of each class."""

    def __init__(self, n: int, counted: list[bool]):
        self.up, self.held = list(range(n)), [int(x) for x in counted]

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> int:
        """The class of both."""
        a, b = sorted((self.find(a), self.find(b)))
        if a != b:
            self.up[b] = a
            self.held[a] += self.held[b]
        return a


def block_links(sets: list[np.ndarray], parts: list[int], left: list[bool], right: list[bool], percent: int) -> Iterator[tuple[int, int, int]]:
    """Links (a, b, overlap) between sets of `left` and sets of `right`, enough to connect whatever all of them connect.

    parts: what is known to be connected has the same number. Where all sets are left and right, no set of the largest class
    needs to be a query: any link that leaves the class is found from its other end.
    """
    union = Union(len(sets), right)
    first: dict[int, int] = {}
    for k, part in enumerate(parts):
        union.join(first.setdefault(part, k), k)
    names = sorted((k for k, r in enumerate(right) if r), key=lambda k: len(sets[k]))
    index, total = DivideSkip([sets[k] for k in names]), len(names)
    both = all(left) and all(right)
    largest = max((union.find(k) for k in names), key=lambda k: union.held[k], default=0)
    asked: list[int] = sorted((k for k, x in enumerate(left) if x), key=lambda k: len(sets[k]), reverse=True)
    later: list[int] = []
    while asked:
        a = asked.pop()
        mine = union.find(a)
        if union.held[mine] == total:
            continue
        if both and mine == union.find(largest) and union.held[mine] > 1:
            later.append(a)
        else:
            n = len(sets[a])
            lo, hi = bisect_left(index.sizes, needed(n, percent)), bisect_right(index.sizes, n * 100 // percent)
            for j, overlap in index.search(sets[a], needed(n, percent), lambda j, a=a: union.find(a) == union.find(names[j]), lo, hi, right[a]):
                if linked(overlap, n, index.sizes[j], percent):
                    yield a, names[j], overlap
                    mine = union.join(a, names[j])
            if union.held[mine] > union.held[union.find(largest)]:
                largest = mine
        if not asked:  # what was put off in a class that is not the largest any more
            top = union.find(largest)
            asked, later = [k for k in later if union.find(k) != top], [k for k in later if union.find(k) == top]


def _search(words: int, percent: int):
    out = ["u", "v", "overlap"]

    def flush(rows: dict[int, list]) -> Iterator[pa.RecordBatch]:
        held = [(name, h, *flags) for name, (text, *flags) in rows.items() if len(h := shingles(text, words)) and set_name(h) == name]
        names = [r[0] for r in held]
        found = list(block_links([r[1] for r in held], [r[2] for r in held], [r[3] for r in held], [r[4] for r in held], percent))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([names[a] for a, _, _ in found], pa.int64()), pa.array([names[b] for _, b, _ in found], pa.int64()), pa.array([o for _, _, o in found], pa.int64())], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}
        for batch in batches:
            for root, i, j, name, part, text, is_left, is_right in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "name", "part", "text", "is_left", "is_right"))):
                if (root, i, j) != at:
                    yield from flush(rows)
                    at, rows = (root, i, j), {}
                if name in rows:  # ids may repeat, with other texts; a set may be on both sides
                    if set_name(shingles(rows[name][0], words)) == name:
                        text = rows[name][0]
                    is_left, is_right = is_left or rows[name][2], is_right or rows[name][3]
                rows[name] = [text, part, is_left, is_right]
        yield from flush(rows)

    return run


# -- 4: the operator ------------------------------------------------------------


def _near(df: DataFrame) -> DataFrame:
    """Broadcast if it is small. df is read more than once."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def classes(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, mark, n_shingles, name, often) for each row, mark being a hash of its text; kept apart as the other steps read it again and again."""
    ship(docs.sparkSession)
    return settle(docs.select("doc_id", _mark(), "text").mapInArrow(_facts(words), "doc_id long, mark long, n_shingles long, name long, often binary"))


def _mark() -> Column:
    return F.xxhash64("text").alias("mark")


class _Sets:
    """The distinct sets of docs, each by one row that has it."""

    def __init__(self, docs: DataFrame, facts: DataFrame, words: int):
        self.docs, self.words = docs, words
        self.rows = settle(facts.where("name is not null").groupBy("name").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("at"), F.max("n_shingles").alias("n_shingles")).select("name", "at.doc_id", "at.mark", "n_shingles"))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """wanted(name, ...) with the text of each set, found by an id and a hash of the text: rows that share an id don't meet each other's sets."""
        columns = wanted.columns
        wanted = settle(wanted.join(self.rows.select("name", "doc_id", "mark"), "name"))
        texts = self.docs.where("doc_id is not null").select("doc_id", _mark(), "text").join(_near(wanted.where("doc_id is not null")), ["doc_id", "mark"]).select(*columns, "text")
        lone = wanted.where("doc_id is null")  # sets that only rows without an id hold: found by name, with one text each
        if lone.limit(1).count():
            named = self.docs.where("doc_id is null").select("text").mapInArrow(_named(self.words), "name long, text string")
            named = named.join(_near(lone.select("name").distinct()), "name", "left_semi").groupBy("name").agg(F.min("text").alias("text"))
            texts = texts.unionByName(named.join(_near(lone), "name").select(*columns, "text"))
        return texts


def _routed(texts: DataFrame, heavy: tuple, words: int, percent: int, again: bool) -> DataFrame:
    """texts(text, root, only) to (node, root): the components of the ties of all routes."""
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    held = spark.sparkContext.broadcast(heavy)
    postings = texts.select("text", "root", "only").mapInArrow(_postings(words, percent, held, parts * 4, again), "bucket int, tied boolean, packed binary")
    ties = postings.repartition(parts, "bucket").select("tied", "packed").mapInArrow(_ties, "u long, v long")
    return components(settle(ties))  # written, as each Python step of a stage holds a worker of its own for every core


def _sized(members: DataFrame) -> DataFrame:
    """(root, cut): the groups that need more than one block."""
    cut = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    return settle(members.groupBy("root").agg(cut.alias("cut")).where("cut > 1"))


def _found(sets: _Sets, rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v, overlap) in the blocks of rows(name, root, i, j, part, is_left, is_right), written."""
    parts = shuffle_partitions(rows.sparkSession)
    dealt = sets.texts(rows).repartition(parts * 4, "root", "i", "j").sortWithinPartitions("root", "i", "j", "name")
    return settle(dealt.mapInArrow(_search(sets.words, percent), "u long, v long, overlap long"))


def _block(cut: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("name", F.lit(salt)), cut).cast("int")


class _Parts:
    """(name, part) of the sets that verified links connect, as links are found."""

    def __init__(self, found: DataFrame):
        self.table = settle(components(found.select("u", "v")).select(F.col("node").alias("name"), F.col("root").alias("part")))

    def of(self, rows: DataFrame, name: str = "name", part: str = "part") -> DataFrame:
        """rows with the part of each set; one without links is a part of its own."""
        known = self.table.select(F.col("name").alias(name), F.col("part").alias("_part"))
        return rows.join(_near(known), name, "left").withColumn(part, F.coalesce("_part", name)).drop("_part")

    def join(self, found: DataFrame) -> None:
        """More links, few: they tie whole parts."""
        if not found.limit(1).count():
            return
        ends = self.of(self.of(found.select("u", "v"), "u", "a"), "v", "b")
        moved = settle(components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        near = _near(moved.select(F.col("node").alias("part"), "root"))
        old = self.table.join(near, "part", "left").select("name", F.coalesce("root", "part").alias("part"))
        new = moved.select(F.col("node").alias("name"), F.col("root").alias("part")).join(self.table.select("name"), "name", "left_anti")
        self.table = settle(old.unionByName(new))


def _apart(rows: DataFrame) -> DataFrame:
    """rows(name, root, part, ...) of the groups that are in several parts, written."""
    several = rows.groupBy("root").agg((F.min("part") < F.max("part")).alias("several")).where("several").select("root")
    return settle(rows.join(_near(settle(several)), "root", "left_semi"))


def _routed_again(sets: _Sets, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """rows(name, n_shingles, root, only) in smaller groups: by new routes, with a list of their own of what is frequent, for each class of sizes."""
    texts = settle(sets.texts(rows.select("name", "root", "only")))
    often = texts.select(F.lit(None).cast("long").alias("doc_id"), _mark(), "text").mapInArrow(_facts(words), "doc_id long, mark long, n_shingles long, name long, often binary")
    tied = _routed(texts, _heavy(settle(often)), words, percent, True)
    nodes = rows.select("name", "n_shingles", "root", "only").mapInArrow(_nodes(percent), "node long, name long, n_shingles long, only int")
    return settle(nodes.join(tied, "node").select("name", "n_shingles", "root", "only"))


def connected(docs: DataFrame, facts: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(name, part) of the sets that have a link: sets are of one part if links connect them."""
    with passing() as tables:
        found = _connected(docs, facts, words, percent)
        tables[:] = [t for t in tables if t is not found]
    return found


def _connected(docs: DataFrame, facts: DataFrame, words: int, percent: int) -> DataFrame:
    sets = _Sets(docs, facts, words)
    no_class = F.lit(None).cast("int").alias("only")
    tied = _routed(docs.select("text", F.lit(0).cast("long").alias("root"), no_class), _heavy(facts), words, percent, False)
    members = settle(sets.rows.join(tied.withColumnRenamed("node", "name"), "name").select("name", "n_shingles", "root", no_class))

    def cut(rows: DataFrame) -> DataFrame:
        return rows.join(_near(_sized(rows)), "root", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))

    whole = [F.lit(True).alias("is_left"), F.lit(True).alias("is_right")]
    one = F.lit(0).alias("j")
    rest = settle(cut(members))
    parts = _Parts(_found(sets, rest.select("name", "root", _block(F.col("cut"), 1).alias("i"), one, F.col("name").alias("part"), *whole), percent))
    rest = rest.where("cut > 1")
    for again in range(ROUNDS + 1):
        if not rest.limit(1).count() or not (rest := _apart(parts.of(rest))).limit(1).count():
            break
        leaders = settle(rest.groupBy("root", "part", _block(F.col("cut"), 1).alias("block")).agg(F.min("name").alias("name"), F.min_by("n_shingles", "name").alias("n_shingles")))
        parts.join(_found(sets, cut(leaders).select("name", "root", _block(F.col("cut"), 2).alias("i"), one, "part", *whole), percent))
        if not (rest := _apart(parts.of(rest.drop("part")))).limit(1).count():
            break
        sizes = rest.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.sum("n").alias("sets"), F.max("n").alias("largest"), F.sum("total").alias("total"))
        others = F.col("sets") - F.col("largest")
        outside = F.ceil(F.greatest(others / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES * others / F.col("sets"), F.lit(1))).cast("int")
        rest = settle(rest.join(_near(settle(sizes.select("root", "most", outside.alias("outside")))), "root"))
        sent = rest.agg(F.count("*").alias("sets"), F.sum(F.col("outside") + F.when(F.col("part") != F.col("most"), F.col("cut")).otherwise(0)).alias("sent")).first()
        if again < ROUNDS and sent["sent"] > COPIES * sent["sets"]:
            rest = settle(cut(_routed_again(sets, rest.drop("most", "outside"), words, percent)))
            parts.join(_found(sets, parts.of(rest).select("name", "root", _block(F.col("cut"), 1).alias("i"), one, "part", *whole), percent))
            rest = rest.where("cut > 1")
            continue
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        asking = rest.where("part <> most").select("name", "root", _block(F.col("outside"), 3).alias("i"), every(F.col("cut")).alias("j"), "part", F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
        asked = rest.select("name", "root", every(F.col("outside")).alias("i"), _block(F.col("cut"), 1).alias("j"), "part", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
        parts.join(_found(sets, asking.unionByName(asked), percent))
        break
    return parts.table


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, name, root, component_id) for each row; name and root are null without shingles."""
    facts = classes(docs, words)
    roots = connected(docs, facts, words, percent).select("name", F.col("part").alias("root"))
    rows = facts.where("n_shingles >= 0").select("doc_id", "n_shingles", "name")
    # a set that no link or copy leaves needs no look-up
    names = rows.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(roots, "name", "left").where("n > 1 or root is not null")
    names = names.select("name", F.coalesce("root", "name").alias("root"), "least")
    least = settle(names.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")))
    named = settle(names.join(_near(least.where("sets > 1").select("root", "component_id")), "root", "left").select("name", "root", F.coalesce("component_id", "least").alias("component_id")))
    if named.count() <= BROADCAST_ROWS:
        full = rows.join(F.broadcast(named), "name", "left")
    else:  # a set that many rows hold is no hot key
        spread = named.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        full = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")).join(spread, ["name", "slice"], "left")
    return full.select("doc_id", "n_shingles", "name", F.coalesce("root", "name").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id.

    Documents link when 100 * |intersection| >= percent * |union| of their sets
    of `words`-word shingles (fewer words: the whole sequence is one shingle).
    component_id is the least doc_id that links reach. Null and blank texts have
    no shingles and stand alone; so does a row whose text is linked with nothing.
    Rows that share a doc_id are each judged by their own text. A null doc_id takes part as any other;
    it is null in the result and never a component_id unless all ids are null.
    Other columns of docs are ignored. No rows give no rows.
    """
    return _placed(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of its least doc_id; all columns stay.

    Null ids come last. Of rows of a component that share the least doc_id, or of null ids alone, the one with the least set name and then
    the least text stays. Rows without shingles all stay.
    """
    placed = settle(_placed(docs, words, percent))
    moved = F.max(F.col("component_id") != F.col("doc_id"))
    left = settle(placed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows"), moved.alias("_moved")).where("_rows > 1 or _moved"))
    near = F.broadcast if left.count() <= BROADCAST_ROWS else lambda df: df
    kept = docs.where("doc_id is not null").join(near(left.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    repeated = left.where("_rows > 1").select("doc_id")
    if not repeated.limit(1).count() and not placed.where("doc_id is null").limit(1).count():
        return kept
    # Rows that their id does not tell apart are judged by id and set name.

    @F.pandas_udf("long")
    def name_of(texts: pd.Series) -> pd.Series:
        found = (shingles(t if isinstance(t, str) else None, words) for t in texts)
        return pd.Series([set_name(h) if len(h) else None for h in found], dtype="Int64")

    shared = docs.where("doc_id is not null").join(near(repeated), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    shared = shared.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), name_of("text").alias("_name"))
    first = placed.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "name")).alias("f")).select(F.col("f.doc_id").alias("_first"), F.col("f.name").alias("_name"))
    texts = shared.where("_name is not null").groupBy("_id", "_name").agg(F.min_by("_row", "_text").alias("_row"))
    chosen = texts.join(first, (texts["_name"] == first["_name"]) & texts["_id"].eqNullSafe(first["_first"]), "left_semi")
    return kept.unionByName(chosen.select("_row.*")).unionByName(shared.where("_name is null").select("_row.*"))
