"""Byte-level BPE by distinct words, against the tiktoken library and a plain merge."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fathom.llm import queries, word_bpe
from fathom.llm.bpe import split_words

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
HOSTILE = "doc_id long, text string, ids string, key string, word string, at int, mark int, rare string"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    made = [" ".join(rng.choice(["alpha", "Beta", "ñandú", "x" * 90, "12345", "日本語", "🙂", "it's", "\t\n", "-" * 70]) for _ in range(n)) for n in (1, 2, 9, 300)]
    return [*made, made[3], None, "", " ", "\n\n  \t", "<|endoftext|>", "à‍", "ab" * 20_000, "rare " * 5_000, "\x00\x1c\x85 end"]


def rows(spark):
    return spark.createDataFrame([(i, t, "i", "k", "w", 1, 2, "r") for i, t in [*enumerate(texts()), (3, texts()[3]), (3, "other"), (None, "none"), (None, None)]], HOSTILE)


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("frequent", [0, 5, 100_000])
def test_round_trip_equals_the_library(spark, library, frequent):
    held = rows(spark)
    got = word_bpe.round_trip(held, PATH, frequent)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r.doc_id, *digests(library, r.text)) for r in held.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_documents_there_and_back(spark, library):
    held = rows(spark).where("doc_id is not null")
    encoded = word_bpe.encode_documents(held, PATH, 3)
    assert sorted((r.doc_id, list(r.ids)) for r in encoded.collect()) == sorted((r.doc_id, library.encode_ordinary(r.text or "")) for r in held.collect())
    back = word_bpe.decode_documents(encoded, PATH)
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in held.collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], HOSTILE)
    assert word_bpe.round_trip(none, PATH).collect() == []
    assert word_bpe.encode_documents(none, PATH).collect() == []


def test_ids_that_the_vocabulary_lacks_raise(spark):
    with pytest.raises(Exception, match="index out of range"):
        word_bpe.decode_documents(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), PATH).collect()


def test_words_by_a_plain_merge(library):
    rank, rng = word_bpe.ranks(PATH), random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abcthe ingé=-1") for _ in range(rng.randrange(1, 200)))
        parts = [bytes([b]) for b in word.encode()]
        while True:
            pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert word_bpe.merged(word.encode(), rank) == ([rank[word.encode()]] if word.encode() in rank else [rank[p] for p in parts])


def test_splits_as_the_library(library):
    """Around code points of every class, and those that later Unicode versions assign."""
    rank, rng = word_bpe.ranks(PATH), random.Random(11)
    for cp in [*range(0x250), *rng.sample(range(0xE000, 0x110000), 3000), 0x558, 0xC5C, 0x1ACF, 0x10940, 0x187F8, 0x323B0, 0x3FC3F]:
        text = f"a{chr(cp)}b1{chr(cp)}2 {chr(cp)}{chr(cp)}!{chr(cp)}' {chr(cp)}\n{chr(cp)}"
        assert [i for w in split_words(text) for i in word_bpe.merged(w.encode(), rank)] == library.encode_ordinary(text), hex(cp)


def test_query_over_whole_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    got = queries.queries()["op13_word_bpe_round_trip"](spark, folder).collect()
    want = [(r.doc_id, *digests(library, r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_texts_are_compressed_against_frequent_words():
    import pyarrow as pa
    import zstandard

    from fathom.llm import word_bpe

    class Held:
        value = {f" frequent{k}": b"" for k in range(50)}

    texts = ["".join(f" frequent{k}" for k in range(0, 50, 3)), "", None, "lone \ud800 ä"]
    encode = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    batch = pa.RecordBatch.from_pydict({"key": [1, 2, 3], "doc_id": [1, 2, 3], "text": texts[:3]})
    (made,) = word_bpe._small(Held)(iter([batch]))
    found = made.column("text").to_pylist()
    whole = zstandard.ZstdDecompressor(dict_data=word_bpe._phrases(Held.value)).decompress
    assert [whole(x) for x in found] == encode[:3]
    assert len(found[0]) < len(zstandard.ZstdCompressor(level=6).compress(encode[0]))
    assert word_bpe._phrases({}) is None
