"""Vectorised word hashing over Arrow batches.

All functions work on the UTF-8 bytes of a whole batch at once; a batch is cut
into pieces of about a MB so that memory stays bounded by the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
LONG_WORD = 48
_R = np.uint64(0x9E3779B97F4A7C15)
#: One odd multiplier for each place in a shingle.
PLACES = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    dtype=np.uint64,
)

#: Word bytes: everything but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: ASCII letters and digits and all bytes of longer characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALNUM[ord(_a) : ord(_b) + 1] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def release() -> None:
    """Give freed memory back to the system: Python workers are kept for later tasks, and would keep their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(function):
    """``function`` over batches, with :func:`release` at its end."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts with about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes; a run never crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    lengths = ends - starts
    out = lengths.astype(np.uint64) * _R
    # by descending length; of bytes the stable sort is a radix sort
    place = (LONG_WORD + 1 - np.minimum(lengths, LONG_WORD + 1)).astype(np.uint8)
    order = np.argsort(place, kind="stable")
    longer = np.cumsum(np.bincount(place, minlength=LONG_WORD + 2))  # those of at least LONG_WORD + 1 - k bytes
    start, acc = starts[order], out[order]
    for k in range(LONG_WORD):
        alive = int(longer[LONG_WORD - k])
        if not alive:
            break
        acc[:alive] = (acc[:alive] ^ data[start[:alive] + k].astype(np.uint64)) * np.uint64(0x100000001B3) + _R
    out[order] = acc
    for i in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return mix(out)


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and for each text the place of its first word (one more entry at the end)."""
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, offsets, is_word)
    return hash_words(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct 64-bit shingle hashes) of each text.

    A text of fewer words than ``width`` has its whole word sequence as its only
    shingle; a text without words has none.
    """
    places = PLACES[:width]
    for first, last, data, offsets in pieces(texts):
        words, bounds = words_of(data, offsets)
        whole = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            whole += words[k : k + len(whole)] * places[k]
        whole = mix(whole)
        for i in range(last - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                s = np.sort(whole[a : b - width + 1])
                yield first + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                short = (words[a:b] * places[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield first + i, mix(short + np.array([b - a], dtype=np.uint64) * _R)
            else:
                yield first + i, np.zeros(0, dtype=np.uint64)
