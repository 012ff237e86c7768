"""Sums of vectors by key as partial and final states.

A task sums the vectors of a key as matrices, batch by batch, and sends one state for each key: what is shuffled is keys times
tasks rows, whatever the number of vectors, so a key that holds a third of them costs no more than another. States
meet sorted by key and are added as they stream by, one key at a time; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that a task holds before it adds up those of one key, or sends them on where that doesn't halve them.
HELD = 2048


def _groups(keys: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """``(group, first)``: rows numbered by key, in order of first occurrence, and the first row of each. Nulls are equal."""
    code = np.zeros(len(keys[0]), dtype=np.int64)
    for k in keys:
        found = k.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(found.dictionary) + 1) + found.indices.to_numpy(), return_inverse=True)[1]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[group], first[order]


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, and where it holds a value; nulls and what a shorter list lacks are zeros without one."""
    values, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    flat = np.where(valid, values.fill_null(0).to_numpy(), 0)
    if (lengths == width).all():
        return flat.reshape(-1, width), valid.reshape(-1, width)
    out, seen = np.zeros((len(lists), width), dtype=flat.dtype), np.zeros((len(lists), width), dtype=bool)
    there = np.arange(width) < lengths[:, None]
    out[there], seen[there] = flat, valid
    return out, seen


def merged(states: pa.Table, n_keys: int) -> pa.RecordBatch:
    """One state for each key of ``keys..., total, seen, n``: sums and counts by dimension, and the weight of all vectors."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in states.columns]
    columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    group, first = _groups(columns[:n_keys])
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(first)))
    width = pc.max(columns[n_keys].value_lengths()).as_py() or 0
    lengths = np.maximum.reduceat(columns[n_keys].value_lengths().fill_null(0).to_numpy()[order], starts).astype(np.int64)
    keep = np.arange(width) < lengths[:, None]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    out = []
    for c in columns[n_keys : n_keys + 2]:
        x = np.add.reduceat(_matrix(c, width)[0][order], starts, axis=0)
        out.append(pa.ListArray.from_arrays(offsets, pa.array(x[keep])))
    n = np.add.reduceat(columns[n_keys + 2].to_numpy()[order], starts)
    keys = [c.take(pa.array(first)) for c in columns[:n_keys]]
    return pa.RecordBatch.from_arrays([*keys, *out, pa.array(n)], states.column_names)


def _states(batch: pa.RecordBatch, n_keys: int) -> pa.RecordBatch:
    """Each vector as a state of its own: its values, its weight where it has one, its weight."""
    lists, weight = batch.column(n_keys), batch.column(n_keys + 1).to_numpy()
    width = pc.max(lists.value_lengths()).as_py() or 0
    x, seen = _matrix(lists, width)
    there = np.arange(width) < lists.value_lengths().to_numpy()[:, None]
    offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(m[there])) for m in (x, seen * weight[:, None])]
    return pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *lists, pa.array(weight)], [*batch.schema.names[:n_keys], "_total", "_seen", "_n"])


def vector_sums(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """``keys, _total, _seen, _n``: by key the sums of its vectors' dimensions, the weight of the vectors that have a value there, and of all.

    Null and empty vectors take no part; null values count as missing; vectors of one key may differ in length. A weight (of 1 unless given) counts but
    doesn't scale, as a chunk's sum and its number of frames do; a null weight is 0.
    """
    n_keys = len(keys)
    own = df.where(F.size(F.coalesce(F.col(vec), F.array())) > 0)
    rows = own.select(*keys, F.col(vec).cast("array<double>").alias("_v"), (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("bigint").alias("_w"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = f"{types}, _total array<double>, _seen array<bigint>, _n bigint"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, HELD):
                held.append(merged(pa.Table.from_batches([_states(batch.slice(a, HELD), n_keys)]), n_keys))
                if sum(b.num_rows for b in held) > HELD:
                    one = merged(pa.Table.from_batches(held), n_keys)
                    held = [one]
                    if one.num_rows > HELD // 2:
                        yield one
                        held = []
        if held:
            yield merged(pa.Table.from_batches(held), n_keys)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for a in range(0, batch.num_rows, HELD):
                part = [b for b in (rest, batch.slice(a, HELD)) if b is not None]
                one = merged(pa.Table.from_batches(part), n_keys)
                if one.num_rows > 1:
                    yield one.slice(0, one.num_rows - 1)
                rest = one.slice(one.num_rows - 1)
        if rest is not None:
            yield rest

    states = rows.mapInArrow(partial, schema)
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(final, schema)


def means(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, vec, n_frames`` from ``vector_sums``; a dimension that no vector has a value in is null."""
    each = F.zip_with("_total", "_seen", lambda t, n: F.when(n > 0, t / n.cast("double")))
    return sums.select(*keys, each.alias("vec"), F.col("_n").alias("n_frames"))
