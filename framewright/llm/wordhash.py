"""Words of texts as arrays of 64-bit hashes, and names of word sequences.

A word is a run of bytes other than space and 0x09 to 0x0D, which in UTF-8 never occur inside a character. Hashes only propose: what
they miss or bring together is decided by codes, which are exact within one block of texts, by the bytes of the words, or by names, which are
126 bits of a cryptographic digest (BLAKE2b) of those bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.wordlists import kinds, split_words

#: Bytes of texts that are worked on at once, about; a longer text is taken whole.
BLOCK = 1 << 20
LOW = (1 << 63) - 1
KIND = kinds(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class TextWords:
    """The words of some texts in order. ``h``: their hashes; ``codes``: numbers under ``distinct`` that are equal for equal words alone;
    ``first``: for each text where its words begin, one more at the end. ``lower`` changes A-Z alone."""

    def __init__(self, texts: pa.Array | list[str | None], lower: bool) -> None:
        found = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), KIND, lower)
        self.codes, self.distinct = found.codes, max(1, len(found.words))
        self.h = hash_words(found.words.to_pylist())[found.codes]
        self.first = np.searchsorted(found.text, np.arange(len(texts) + 1))
        n = len(self.codes)
        joined = np.full(len(found.packed) + n, 32, dtype=np.uint8)
        joined[np.arange(len(found.packed)) + np.repeat(np.arange(n), np.diff(found.offsets))] = found.packed
        self.data, self.at = joined.tobytes(), found.offsets + np.arange(n + 1)

    def spelled(self, i: int, j: int) -> bytes:
        """Words i to j, without the last, joined by one space."""
        return self.data[self.at[i] : max(self.at[i], self.at[j] - 1)]


class Spans:
    """Hashes of spans of one sequence: those of 1, 2, 4, ... values are mixed from halves, and two of them cover any span."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [mix(values)]

    def of(self, starts: np.ndarray, lengths: int | np.ndarray) -> np.ndarray:
        """Hashes of the spans of at least one value each; they depend on the values alone."""
        lengths = np.broadcast_to(np.asarray(lengths, dtype=np.int64), starts.shape)
        out = np.zeros(len(starts), dtype=np.uint64)
        for k in np.unique(np.frexp(lengths)[1] - 1).tolist():
            while len(self.levels) <= k:
                h, half = self.levels[-1], 1 << len(self.levels) - 1
                self.levels.append(mix(h[: max(0, len(h) - half)] * np.uint64(3) + h[half:]))
            at = np.flatnonzero(np.frexp(lengths)[1] - 1 == k)
            a, n = starts[at], lengths[at]
            out[at] = mix(mix(self.levels[k][a] + n.astype(np.uint64)) * np.uint64(3) + self.levels[k][a + n - (1 << k)])
        return out


def names(spelled: bytes) -> tuple[int, int]:
    """Two independent 63-bit names of a sequence of words, ``(0, 0)`` for an empty one."""
    if not spelled:
        return 0, 0
    d = int.from_bytes(hashlib.blake2b(spelled, digest_size=16).digest(), "little")
    return (d & LOW) or 1, d >> 64 & LOW


def shared_names(named: DataFrame) -> frozenset[int]:
    """Names ``v`` that stand for different ``w`` in ``named(v, w)``. Names are random, so of n texts about n * n / 2**64 are expected:
    none for a billion, hundreds for 10**11."""
    twice = named.groupBy("v").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a < b")
    return frozenset(r.v for r in twice.select("v").collect())


def final_name(twice: frozenset[int]) -> Column:
    """The name of a row of ``v, w``: ``v``, or ``w`` where different texts share ``v``."""
    return F.when(F.col("v").isin(*twice), F.col("w")).otherwise(F.col("v")) if twice else F.col("v")


def text_blocks(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK`` bytes in these columns, at least one row each."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    start, used = 0, 0
    for i, n in enumerate(sizes.tolist()):
        used += n
        if used >= BLOCK:
            yield start, i + 1
            start, used = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
