"""Byte-level BPE by a global shuffle of distinct words.

Texts are split by the byte-level pattern. A bounded table of frequent words, told from an eighth of the rows, is encoded
once and sent to every task: frequent words are never shuffled, so none can be a hot key, and the choice has no effect on
results. Every other word of a text goes out once a text and is shuffled by the word: its rows come together, sorted, the word is encoded once, and they
leave with the ids. Text and ids meet by the text's key. The positions of words are those of the text, which travels compressed, at half the size
of rows with positions or of ids: it is split again and each position takes the ids of its word. Decoding joins the table of
the tokens' bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import split_words
from .common import ship

#: Frequent words that every task holds, of at most WORD_BYTES bytes each: a million are about 200 MB in a task.
FREQUENT, WORD_BYTES = 1_000_000, 64
#: One row in so many tells which words are frequent.
SHARE = 8
#: Distinct words that a task counts before it gives them on.
COUNTED = 200_000
#: Bytes of frequent words that texts are compressed against, and the level of compression.
DICTIONARY, LEVEL = 100_000, 9

_RANKS: dict[str, dict[bytes, int]] = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of lines `base64 rank`. Read once a process."""
    if path not in _RANKS:
        with open(path, "rb") as f:
            _RANKS[path] = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return _RANKS[path]


def merged(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of a word: itself if it is a token, else its bytes with the pair of least rank merged, leftmost first, while there is one."""
    if word in rank:
        return [rank[word]]
    if len(word) > 64:
        return _merged_long(word, rank)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(rank)
    pairs = [rank.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = rank.get(parts[i] + parts[i + 1], none)
    return [rank[p] for p in parts]


def _merged_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over linked parts, for words of any length."""
    n = len(word)
    ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := rank.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or (j := right[i]) >= n or ends[j] != end:
            continue  # one of the two parts has been merged meanwhile
        ends[i], right[i], gone[j] = end, right[j], 1
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [rank[word[i : ends[i]]] for i in range(n) if not gone[i]]


def packed(word: str, rank: dict[bytes, int]) -> bytes:
    """The ids of a word as little-endian unsigned 32-bit integers."""
    return np.array(merged(word.encode("utf-8", "surrogatepass"), rank), "<u4").tobytes()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n), summed in the task."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words = [w for w in held if len(w) <= WORD_BYTES and len(w.encode()) <= WORD_BYTES]
        made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
        held.clear()
        return made

    for batch in batches:
        for text in batch.column("text"):
            held.update(split_words(text.as_py() or ""))
            if len(held) > COUNTED:
                yield out()
    yield out()


#: Between a word and its ids; no byte of UTF-8.
END = b"\xff"


def _entries(path: str):
    """Rows (key, word) in order of the word to (key, entry), an entry being the word and its ids in as few bytes as the vocabulary's size allows: a
    word is encoded when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, last, entry = ranks(path), None, b""
        width = _width(rank)
        for batch in batches:
            found = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, plain = word, word.encode("utf-8", "surrogatepass")
                    entry = plain + END + np.array(merged(plain, rank), width).tobytes()
                found.append(entry)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "entry"])

    return run


def _width(rank: dict[bytes, int]) -> str:
    return "<u2" if max(rank.values(), default=0) < 1 << 16 else "<u4"


def _encoded(path: str):
    """Rows (word) to (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([packed(w, rank) for w in batch.column("word").to_pylist()], pa.binary())], names=["word", "ids"])

    return run


def frequent_words(texts: DataFrame, path: str, most: int) -> dict[str, bytes]:
    """The `most` words that are most frequent in an eighth of texts(key, text), encoded: at most `most` rows of short words reach the driver."""
    seen = texts.where(F.pmod("key", F.lit(SHARE)) == 0).select("text").mapInArrow(_counted, "word string, n long")
    leading = seen.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")
    found = leading.mapInArrow(_encoded(path), "word string, ids binary").toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("ids").to_pylist()))


def _rare(known) -> object:
    """(key, text) to (key, word): the words that are not known, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            texts, words = [], []
            for row, text in enumerate(batch.column("text")):
                rare = set(split_words(text.as_py() or "")).difference(table)
                texts += [row] * len(rare)
                words += rare
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(texts, pa.int32())), pa.array(words, pa.string())], names=["key", "word"])

    return run


def _phrases(known: dict[str, bytes]) -> zstandard.ZstdCompressionDict | None:
    """What texts are compressed against: the most frequent words, DICTIONARY bytes of them, the first of all last, where it is cheapest to name."""
    held, size = [], 0
    for word in known:
        held.append(word.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > DICTIONARY:
            break
    return zstandard.ZstdCompressionDict(b"".join(reversed(held)), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if size >= 8 else None


def _small(known):
    """(key, doc_id, text) with the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=LEVEL, dict_data=_phrases(known.value), write_checksum=False).compress
        for batch in batches:
            texts = [small((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(texts, pa.binary())], names=["key", "doc_id", "text"])

    return run


def _joined(docs: DataFrame, path: str, frequent: int) -> tuple[DataFrame, object]:
    """(doc_id, text, rare): compressed texts and their rare words with ids; and the table of frequent words."""
    spark = docs.sparkSession
    ship(spark)
    # texts that share a key only see each other's words, whose ids are the same everywhere
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = spark.sparkContext.broadcast(frequent_words(texts.select("key", "text"), path, frequent))
    rare = texts.select("key", "text").mapInArrow(_rare(known), "key long, word string")
    met = rare.repartition("word").sortWithinPartitions("word").mapInArrow(_entries(path), "key long, entry binary")
    of_text = met.groupBy("key").agg(F.collect_set("entry").alias("rare"))  # no more than the text itself
    whole = texts.mapInArrow(_small(known), "key long, doc_id long, text binary")
    return whole.join(of_text, "key", "left").select("doc_id", "text", "rare"), known


def _assembled(known, path: str):
    """Batches of _joined to the packed ids of each text: each position takes the ids of its word."""

    def run(batch: pa.RecordBatch) -> Iterator[bytes]:
        table, width = known.value, _width(ranks(path))
        whole = zstandard.ZstdDecompressor(dict_data=_phrases(table)).decompress
        for text, rare in zip(batch.column("text"), batch.column("rare").to_pylist()):
            own = {}
            for word, _, ids in (x.partition(END) for x in rare or ()):
                own[word.decode("utf-8", "surrogatepass")] = np.frombuffer(ids, width).astype("<u4").tobytes()
            words = split_words(whole(text.as_py()).decode("utf-8", "surrogatepass"))
            yield b"".join([x or own[w] for x, w in zip(map(table.get, words), words)])

    return run


def token_bytes(path: str) -> list[bytes | None]:
    """The bytes of each id; ids that the vocabulary leaves free have None."""
    held = ranks(path)
    found: list[bytes | None] = [None] * (max(held.values(), default=-1) + 1)
    for token, k in held.items():
        found[k] = token
    return found


def encode_documents(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text as array<int>, by the ranks of the file `vocabulary`, without special tokens.

    A null or empty text has none. One row per row, in any order; null doc_ids and repeats are kept, other columns ignored, whatever their names. `frequent`
    bounds the words that are sent to every task; at 0 every word is shuffled.
    """

    joined, known = _joined(docs, vocabulary, frequent)
    assembled = _assembled(known, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(ids, "<u4").astype(np.int32) for ids in assembled(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return joined.mapInArrow(run, "doc_id long, ids array<int>")


def _shared_table(spark: SparkSession, vocabulary: str):
    return spark.sparkContext.broadcast(token_bytes(vocabulary))


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids): the bytes of the ids in turn; null ids give none. Ids that the vocabulary lacks raise."""
    ship(encoded.sparkSession)
    table = _shared_table(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = table.value.__getitem__
        for batch in batches:
            found = [b"".join(map(label, x.as_py() or [])) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids again, and digest both where they are made.

    Ids are digested as little-endian unsigned 32-bit integers. Nulls, empties, repeats and other columns as in encode_documents.
    """
    table = _shared_table(docs.sparkSession, vocabulary)
    joined, known = _joined(docs, vocabulary, frequent)
    assembled = _assembled(known, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = table.value.__getitem__
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in assembled(batch):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(label, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
