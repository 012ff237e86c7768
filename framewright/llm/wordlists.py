"""Words of whole blocks of texts at once: the distinct ones, and codes for all in order."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """``words``: the distinct ones (binary). For each word in order: its place among them, its text, and the breaks before it; and
    the bytes of all words with their offsets."""

    words: pa.Array
    codes: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    packed: np.ndarray
    offsets: np.ndarray


def kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte: 0 part of a word, 1 between words, 2 between words and a break."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(between)] = 1
    out[list(breaks)] = 2
    return out


def split_words(texts: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """The words of all texts (null: empty), lower-cased in A-Z or as they are; line feed has to end words in ``kind``."""
    line = pa.scalar(b"\n", pa.large_binary())
    ended = pc.binary_join_element_wise(texts.cast(pa.large_binary()), line, pa.scalar(b"", pa.large_binary()), null_handling="replace", null_replacement=b"")
    ends = np.frombuffer(ended.buffers()[1], dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, dtype=np.uint8)
    data = LOWER[data] if lower else data
    what = kind[data]
    word = what == 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # the last byte is no part of a word
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    offsets = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths)])
    packed = data[word]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    text, piece = np.searchsorted(ends[1:] - ends[0], starts, side="right"), np.searchsorted(np.flatnonzero(what == 2), starts)
    return Words(found.dictionary, found.indices.to_numpy(), text, piece, packed, offsets)


def as_strings(words: pa.Array) -> pa.Array:
    """Binary words as strings, which they are slices of."""
    return words.cast(pa.binary()).view(pa.string())
