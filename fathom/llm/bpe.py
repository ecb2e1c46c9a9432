"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token ids. It starts as one state with a loop for every byte and takes one gadget for each merge
(a, b) -> ab, in order of rank, each applied to the automaton so far:

* the state t(a) that all arcs labelled a lead to loses its arc b (a then b is no longer a right tokenization);
* every state with an arc a gets an arc ab;
* ab leads to a state t(ab) of its own, which starts as a copy of t(b) as it stood.

So there is one state per token, and the automaton accepts exactly the token
sequences that applying the merges by rank can produce. Kept are the cut arcs and, for
each copied arc set and state, whose copy it is and as of which gadget.

To encode, the automaton is turned into one that reads bytes: with every arc spelled out byte by byte, the
subset construction gives a deterministic transition table, (state, byte) -> state. Every beginning of a word has exactly
one right tokenization, so a state has exactly one token that ends in it. A word is encoded by one table look-up a byte;
its tokens are read off from the end, each taking as many bytes as its label has. States are built when first
reached and stay in the table, whose size is bounded. Decoding emits the arcs' labels. Words are split off
beforehand by the byte-level pattern; words met before come from a table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship

#: Code points that are unassigned up to Unicode 16, whose classes the tokenizers library knows, and
#: that the regex module takes for letters or numbers. Ranges of hexadecimal code points.
LATER = """
558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686
16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168
1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF
2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_LATER = "[" + "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (r.split("-") for r in LATER.split())) + "]"
_later = re.compile(_LATER)
#: The byte-level split, for texts without code points of LATER.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for any text: code points of LATER are neither letters nor numbers.
_EXACT = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--{_LATER}]+| ?[\p{{N}}--{_LATER}]+| ?[[^\s\p{{L}}\p{{N}}]||{_LATER}]+|\s+(?!\S)|\s+")
#: The same over characters for which the standard library's classes agree with it.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-©«-±¶-¸»¿-ſ‐-‧€]")
#: Words and states kept in the tables of a process.
WORDS, STATES = 300_000, 400_000


def split_words(text: str) -> list[str]:
    other = _OTHER.search(text)
    if not other:
        return _PLAIN.findall(text)
    return (_EXACT if _later.search(text, other.start()) else PATTERN).findall(text)


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """labels: the bytes of each token; merges: (left, right, made) token numbers by rank."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.born = {k: -1 for k, b in labels.items() if len(b) == 1}
        self.arc_of: dict[int, int] = {}
        self.state_of: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            self._gadget(rank, *merge)
        self.end = len(merges) + 1
        # the labels as a tree of bytes: (node, byte) -> node, and the token that a node spells
        self.below: dict[int, int] = {}
        self.spelled: dict[int, int] = {}
        self.inner: set[int] = set()
        nodes = 1
        for token in self.born:
            node = 0
            for byte in labels[token]:
                self.inner.add(node)
                nxt = self.below.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.below[node << 8 | byte] = nodes
                    nodes += 1
                node = nxt
            self.spelled[node] = token
        self.length = {token: len(labels[token]) for token in self.born}
        self._forget()

    def _forget(self) -> None:
        """An empty table: the state before the first byte."""
        self.start = State(self, -1, (0,))
        self.states = {self.start.parts: self.start}

    def _gadget(self, rank: int, left: int, right: int, made: int) -> None:
        if made in self.born:
            raise ValueError(f"token {made} is made by two merges")
        self.cut[left, right] = rank
        self.born[made] = rank
        self.arc_of[made] = left
        self.state_of[made] = right

    def arc(self, state: int, token: int) -> bool:
        """Whether token has an arc from the state that token `state` leads to: copies are followed back, cuts by gadgets before `time` hold."""
        time, born = self.end, self.born
        while True:
            if self.cut.get((state, token), self.end) < time:
                return False
            a, b = born[state], born[token]
            if a < 0 and b < 0:
                return True
            if b >= a:  # this arc was put beside the left part's arc, once that gadget's cut was made
                time, token = b + 1, self.arc_of[token]
            else:  # this state was copied before its gadget
                time, state = a, self.state_of[state]

    def step(self, state: State, byte: int) -> State:
        """The transition by a byte that the table doesn't have yet."""
        parts, end = [], -1
        for part in state.parts:
            token, node = (part >> 24) - 1, self.below.get((part & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            made = self.spelled.get(node)
            if made is not None and (token < 0 or self.arc(token, made)):
                end = made
            if node in self.inner:
                parts.append((token + 1) << 24 | node)
        parts.append((end + 1) << 24)
        subset = tuple(sorted(parts))
        to = self.states.get(subset)
        if to is None:
            if len(self.states) >= STATES:
                self._forget()
            to = self.states[subset] = State(self, end, subset)
        state[byte] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a word by one transition a byte."""
        state, ends = self.start, []
        for byte in word:
            state = state[byte]
            ends.append(state.end)
        out, at = [], len(word)
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]


class State(dict):
    """A row of the table, byte to state. parts: (last whole token + 1) << 24 | node of what is spelled since; end: the token that ends here."""

    __slots__ = ("automaton", "end", "parts")

    def __init__(self, automaton: Automaton, end: int, parts: tuple[int, ...]):
        self.automaton, self.end, self.parts = automaton, end, parts

    def __missing__(self, byte: int) -> State:
        return self.automaton.step(self, byte)


class Words(dict):
    """Words to what `make` makes of them. Two generations: when the young one is full it becomes the old one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        symbols, vocab = byte_symbols(), held["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        labels = {k: bytes(symbols[c] for c in token) for token, k in vocab.items() if token not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.label = {str(k): b for k, b in labels.items()} | {str(k): token.encode() for token, k in self.special.items()}
        self.words = Words(lambda word: ",".join(map(str, self.automaton.encode(word.encode("utf-8", "surrogatepass")))))
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas. Special tokens in a text keep their own id."""
        if self._special is None or not self._special.search(text):
            return ",".join(map(self.words.__getitem__, split_words(text)))
        out, at = [], 0
        for m in self._special.finditer(text):
            out += map(self.words.__getitem__, split_words(text[at : m.start()]))
            out.append(str(self.special[m[0]]))
            at = m.end()
        out += map(self.words.__getitem__, split_words(text[at:]))
        return ",".join(out)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.label.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text as array<int>. A null or empty text has none.

    One row per row, in any order; null doc_ids and repeats are kept, other columns ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(tokenizer).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [[int(x) for x in s.split(",")] if (s := encode(t.as_py() or "")) else [] for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the labels of the arcs in turn; null ids give an empty text. Unknown ids raise."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(tokenizer).decode
        for batch in batches:
            found = [decode(",".join(map(str, x.as_py() or []))) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids again, and digest both.

    The digests are taken where the ids are made, so that ids of very long texts
    never travel. Nulls, empties, repeats and other columns as in encode_documents.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(tokenizer)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = held.encode(text.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(held.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
