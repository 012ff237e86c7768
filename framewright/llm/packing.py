"""Best-fit packing by a length histogram.

Pieces of texts are counted by length; best-fit decreasing runs over the counts (at most ``capacity`` of them, whatever the
corpus), and pieces take the planned slots by their rank within their length. Ranks come from salted windows, so a length that
holds most pieces is spread over many groups.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import batches_by_bytes, discard, fresh, giving_back, small, stored

CAPACITY = 4096
END_ID = 1
#: Words, and parts of words, whose ids a task remembers, and the characters of the longest of them.
MEMO_WORDS, MEMO_CHARS = 250_000, 40
#: Pieces that one salted window ranks, about.
RANK_ROWS = 20_000

# The tokenizer's letters and digits up to U+017F, its rule for pre-tokens, and the characters that stand for bytes.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = dict(zip(_SHOWN + [b for b in range(256) if b not in _SHOWN], map(chr, _SHOWN + list(range(256, 512))), strict=False))


class PartIds(dict):
    """Little-endian ids of a pre-token in lower case, remembered."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        found = [t.id for t in self.tokenize(part if part.isascii() else "".join(map(BYTE_CHARS.__getitem__, part.encode())))]
        return remembered(self, part, struct.pack(f"<{len(found)}I", *found))


class WordIds(dict):
    """Little-endian ids of a word between spaces, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in order. A word of
    characters up to U+017F is split into pre-tokens here, which go straight to the merges: below that, composed forms are normal and
    lower case is character by character. Any other word, and one that may hold a special token, goes through the tokenizer whole.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.parts = tokenizer, PartIds(tokenizer)

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        if core.isalpha() and (core.isascii() or PLAIN.fullmatch(core)):  # letters, and marks after them
            ids = self.parts[core.lower()] + (self.parts[word[len(core) :]] if core != word else b"")
        elif PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids if word else []
            ids = struct.pack(f"<{len(found)}I", *found)
        return remembered(self, word, ids)


def remembered(memo: dict, key: str, ids: bytes) -> bytes:
    """``ids``, kept under ``key`` if that is short; a full memo starts anew."""
    if len(key) <= MEMO_CHARS:
        if len(memo) >= MEMO_WORDS:
            memo.clear()
        memo[key] = ids
    return ids


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every text: its ids and then ``END_ID``, cut only beyond ``capacity``.

    ``ids`` is binary, little-endian unsigned 32-bit. A null text counts as empty and gives one piece of one id; repeated rows each
    give their pieces; a text of any length is cut whole. Other columns of ``docs`` are left out. ``tokenizer`` is a file that all
    executors see; by default each finds the public one where its library is installed.
    """
    key = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        words = WordIds(Tokenizer.from_file(tokenizer or tokenizer_path()))
        end, step = struct.pack("<I", END_ID), 4 * capacity
        for part in batches_by_bytes(batches, 1):
            row, piece, ids = [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                whole = b"".join(map(words.__getitem__, (t or "").replace("\n", " ").split(" "))) + end
                for j in range(0, len(whole), step):
                    row.append(i)
                    piece.append(j // step)
                    ids.append(whole[j : j + step])
            pieces = pa.array(piece, pa.int32())
            starts = np.asarray(piece, dtype=np.int64) * capacity
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pieces, pa.array(starts), pa.array(lengths), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", text).mapInArrow(giving_back(run), f"doc_id {key.dataType.simpleString()}, piece int, start long, length long, ids binary")


@dataclass(frozen=True)
class Plan:
    """Segments in order of (length, first rank). A segment's pieces fill ``each`` a sequence from ``sequence`` on, from ``offset`` on."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over counts of lengths.

    Sequences that were filled alike and are numbered in a row are one group. Pieces of one length go to the group with the
    least room that fits, as many to each sequence as fit there, which is what best fit does piece by piece. Only the last
    group that a length meets is split, and a group that is used up has less than half its room left, so the plan has at most
    about 40 segments for each length.
    """
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, sequences), sorted
    out, opened = [], 0
    for length in sorted(counts, key=lambda x: x or 0, reverse=True):
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            i = bisect_left(groups, (length, -1, -1))
            if i < len(groups):
                room, first, n = groups.pop(i)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, each, first, capacity - room))
                insort(groups, (room - each * length, first, full))
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                out.append((length, rank, left, first + full, capacity - room))
                insort(groups, (room - left * length, first + full, 1))
                full, rank, left = full + 1, rank + left, 0
            if full < n:
                insort(groups, (room, first + full, n - full))
    a = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(a[:, i]) for i in range(5)), opened)


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``, gapless from 0 in every sequence.

    Columns of ``pieces`` are kept, but ``sequence_id`` and ``offset`` are replaced; rows that agree in all keys each get a slot of
    their own. Lengths must be 1 to ``capacity``; a null one raises. An empty table gives an empty table.

    A length that holds many pieces is ranked in salted windows of about ``RANK_ROWS`` rows. The salt is drawn once and stored, so
    that neither repeated rows nor one key can fill a window.
    """
    pieces = pieces.drop("sequence_id", "offset")
    salt, rank, first, n, slot_ = (fresh(x, pieces) for x in ("_salt", "_rank", "_first", "_n", "_slot"))
    counts = stored(pieces.groupBy("length").agg(F.count("*").alias(n)))
    plan = pieces.sparkSession.sparkContext.broadcast(best_fit_plan({r[0]: r[1] for r in counts.collect()}, capacity))  # at most capacity rows
    draw = F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.ceil(F.col(n) / RANK_ROWS))
    salted = stored(pieces.join(F.broadcast(counts), "length").select(*pieces.columns, draw.alias(salt)))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    before = F.sum(n).over(W.partitionBy("length").orderBy(salt)) - F.col(n)
    firsts = stored(sizes.select("length", salt, before.alias(first)))
    ranked = salted.withColumn(rank, F.row_number().over(W.partitionBy("length", salt).orderBy(*keys)) - 1)
    ranked = ranked.join(small(firsts), ["length", salt]).withColumn(rank, F.col(first) + F.col(rank))
    discard(counts)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, n, r = plan.value, length.to_numpy(), rank.to_numpy()
        span = int(max(r.max(initial=0), p.rank.max(initial=0))) + 1
        i = np.searchsorted(p.length * span + p.rank, n * span + r, side="right") - 1
        nth = r - p.rank[i]
        return pd.DataFrame({"sequence_id": p.sequence[i] + nth // p.each[i], "offset": p.offset[i] + nth % p.each[i] * n})

    placed = ranked.withColumn(slot_, slot("length", rank))
    return placed.select(*pieces.columns, f"{slot_}.sequence_id", f"{slot_}.offset")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(digests, ["doc_id", "piece"])
