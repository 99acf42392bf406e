"""Small helpers on the words of one text, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multiplier of rolling hashes, and the two of the finaliser.
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def split(text: str | None) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of a text as UTF-8: bytes.split() separates at just these bytes."""
    return text.encode().split() if text else []


#: What becomes of each byte: A-Z are lower-cased; all of ASCII but digits and letters separates.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def folded(text: str | bytes | None) -> list[bytes]:
    r"""The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text, or of its UTF-8, after A-Z are lower-cased."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(FOLD).split()


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)


def given_back() -> None:
    """Gives memory that is free back to the system: workers live on and count with their executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that what is made of their texts in between stays small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
        given_back()


class WordHashes(dict):
    """64-bit hashes of words; keeps those of the first words it sees, up to a bound."""

    KEPT = 100_000

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.KEPT:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def window_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window of `length` values, each made from two windows of half the length."""
    if length == 1:
        return mixed(x)
    if length % 2:
        return mixed(window_hashes(x, length - 1)[:-1] * STEP + x[length - 1 :])
    half = window_hashes(x, length // 2)
    return mixed(half[: len(half) - length // 2] * STEP + half[length // 2 :])
