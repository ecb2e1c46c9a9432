"""Packing of tokenized documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one separator. It is cut into whole windows of
`window` tokens and a rest, which is cut again into pieces of at most `piece` tokens. The pieces of about
`group` windows at a time are dealt out by multiway differencing: each piece
starts as a partial partition (piece, 0, ..., 0); the two partitions with the
largest spread are merged, the fullest part of one with the emptiest of the
other, until one is left. If its fullest part exceeds the window, the window
count rises by one and the group is dealt again. Short groups (the last of a
task) end with a window as full as their tokens allow.

Each task packs its own rows, so nothing is shuffled, a hot source is no hot
task, and memory holds one group. sequence_id is unique over all tasks: the task's
number in the upper bits, a counter in the lower. It depends only on the rows
that a task reads, so a lost task makes the same rows again.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PATTERN, byte_symbols, codec
from .common import ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[str, object] = {}
#: Runs of white space that the encoder's splitter, which needs stack for each blank, is not given.
_BLANKS = re.compile(r"\s{10000}")


def encoder(path: str):
    """text -> 32-bit ids of the tokenizers file at `path`. One a process; special tokens in a text keep their own id.

    Texts with very long runs of white space are split and encoded by the tokenization automaton instead, to the same ids.
    """
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        symbols = byte_symbols()
        special = {x["content"]: x["id"] for x in held["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): k for token, k in held["model"]["vocab"].items() if token not in special}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            if _BLANKS.search(text):
                return np.array(codec(path).encode(text).split(","), np.uint32)
            return encoding.encode_to_numpy(text, allowed_special="all")

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def difference(sizes: list[int], parts: int) -> list[list[int]]:
    """Deal the items into `parts` parts with near-equal sums: Karmarkar-Karp multiway differencing. Gives the items of each part."""
    heap, made = [], 0
    for i, n in enumerate(sizes):
        sums = [0] * (parts - 1) + [n]
        heap.append((-n, made, sums, [()] * (parts - 1) + [(i,)]))
        made += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        merged = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda s: s[0])
        low = merged[0][0]
        # only differences matter from here on, but the true sums are kept to check the capacity
        sums = [s for s, _ in merged]
        held = [(in_a[i], in_b[parts - 1 - i]) for _, i in merged]
        heapq.heappush(heap, (-(sums[-1] - low), made, sums, held))
        made += 1
    if not heap:
        return [[] for _ in range(parts)]
    return [_items(x) for x in heap[0][3]]


def _items(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            out.append(x)
        else:
            stack.extend(x)
    return sorted(out)


def pack(sizes: list[int], window: int) -> list[list[int]]:
    """Windows over all items, near-equally full; their number rises from the least possible until none exceeds `window`."""
    if not sizes:
        return []
    if max(sizes) > window:
        raise ValueError("an item exceeds the window")
    parts = -(-sum(sizes) // window)
    while True:
        dealt = difference(sizes, parts)
        if max(sum(sizes[i] for i in x) for x in dealt) <= window:
            return [x for x in dealt if x]
        parts += 1


class Packer:
    """Collects the pieces of one task and gives rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_id: int, window: int, piece: int, group: int):
        self.next, self.window, self.piece, self.limit = first_id, window, piece, group * window
        self.held: list[tuple] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            yield (doc_id, at, self.window, _crc(ids[at : at + self.window]), n, self.next, 0)
            self.next += 1
        rest = n - whole
        if rest:
            cuts = -(-rest // self.piece)
            edges = [whole + rest * i // cuts for i in range(cuts + 1)]
            self.held += [(doc_id, a, b - a, _crc(ids[a:b]), n) for a, b in zip(edges, edges[1:])]
            self.total += rest
        if self.total >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for part in pack([x[2] for x in self.held], self.window):
            offset = 0
            for i in part:
                yield (*self.held[i], self.next, offset)
                offset += self.held[i][2]
            self.next += 1
        self.held, self.total = [], 0


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, separator: int = 0, piece: int = 256, group: int = 32) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, its separator included, lies in exactly one
    piece. A null or empty text is the separator alone. Repeated rows are packed
    as documents of their own; null doc_ids stay null. Empty input gives no rows; other
    columns are ignored. `tokenizer` is the path of a tokenizers file.
    """
    ship(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, window, piece, group)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                rows.extend(packer.add(doc_id, np.append(encode(text.as_py() or ""), separator).astype("<u4")))
            yield out(rows)
        yield out(list(packer.flush()))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
