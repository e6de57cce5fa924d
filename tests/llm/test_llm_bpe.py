"""Byte-level BPE against the public library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from orbitframe.llm import byte_bpe

RANKS = byte_bpe.load_ranks(byte_bpe.default_ranks())
#: What makes the pattern's cases meet: endings, blanks and other white space, numbers, marks, long characters.
PARTS = ["a", "s", "t", "re", "ve", "m", "ll", "d", "'", "'", " ", " ", "\n", "\t", " ", "　", "1", "٣", "é", "中", "!", "?", "\x1c", "\x85", "​", "́", "²", "Ⅷ", "😀", "\x00"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_words_are_the_patterns():
    texts = [*odd_texts(20_000), None, "", " ", "it's  don't'll 's''s"]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for first, last, joined, _, starts, ends, bounds in byte_bpe.word_runs(texts):
        for i in range(first, last):
            a, b = bounds[i - first : i - first + 2]
            assert [joined[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)] == pattern.findall(texts[i] or "")


@pytest.mark.parametrize("dictionary", [byte_bpe.DICTIONARY, 300])
def test_ids_are_the_librarys(spark, sf_dir, library, dictionary):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, dictionary=dictionary).collect()}
    assert got == {r.doc_id: digests(library, r.text) for r in docs.collect()}


def test_odd_and_long_texts(spark, library, monkeypatch):
    rng = random.Random(4)
    texts = [*odd_texts(300), None, "", "a" * 60_000, "=" * 30_001, "é" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "\n" * 5000 + "x", "word " * 40_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for long_word in (byte_bpe.LONG_WORD, 4):  # also with all but the shortest words merged from the heap
        monkeypatch.setattr(byte_bpe, "LONG_WORD", long_word)
        got = {r.doc_id: r for r in byte_bpe.round_trip(docs).collect()}
        for k, t in enumerate(texts):
            assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == digests(library, t), (k, (t or "")[:40])


def test_encode_and_decode(spark, library):
    docs = spark.createDataFrame([(1, "Hello world's  end"), (1, "again"), (None, "no name"), (None, "ohne Namen"), (2, None)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "word", "n", "key", "extra", "bytes")})
    for dictionary in (byte_bpe.DICTIONARY, 0):
        encoded = byte_bpe.encode(docs, dictionary=dictionary)
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=key)
        assert got == sorted(((r.doc_id, library.encode_ordinary(r.text or "")) for r in docs.collect()), key=key)
        back = sorted(((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded).collect()), key=key)
        assert back == sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=key)
    assert byte_bpe.round_trip(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(none).collect()] == [(1, b"")]


def test_dictionary_by_threshold(spark):
    rows = spark.createDataFrame([(f"w{k}", k % 5, [k]) for k in range(5000)], "word string, n long, ids array<int>")
    some = byte_bpe.most_frequent(rows, 2500).groupBy("n").count().collect()
    counts = {r.n: r["count"] for r in some}
    assert counts[4] == counts[3] == 1000 and 430 < counts[2] < 500 and set(counts) == {4, 3, 2}
    assert byte_bpe.most_frequent(rows, 0).isEmpty()
    assert byte_bpe.most_frequent(rows, 5000).count() == 5000
