"""Removal of long word sequences that repeat across documents, by compaction of a de Bruijn graph in minimizer space.

Nodes are k-mers of words, thinned by winnowing: of every window's k-mers the one with the smallest hash is kept, so equal
windows keep equal nodes at equal places. An edge leads from a node of a text to its next one and is named by all words from
the start of the one to the end of the other. Nodes that occur in one text alone are dropped. Joins on node and edge counts find
edges without branches - as many occurrences as both their ends have - and runs of these are paths that occur whole
wherever any of their nodes does. The graph only proposes: the words of each whole path, and of each single window across a path's
ends, are read again at their source coordinates, and only ranges whose words have equal names, digests of their bytes, count as
repeats. Where words differ under one path, which takes hashes that collide, its windows are read one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import discard, fresh, small, stored
from framewright.llm.wordhash import Spans, TextWords, final_name, names, shared_names, text_blocks

WINDOW, NODE = 50, 16


def _name(h: np.ndarray) -> np.ndarray:
    """Hashes as positive longs; 0 stands for none."""
    return (h >> np.uint64(1)).astype(np.int64) | 1


def graph_of(h: np.ndarray, window: int, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(positions, nodes, edges)`` of one text's word hashes; the last edge is 0. Nothing if it has no whole window."""
    if len(h) < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    spans = Spans(h)
    grams = spans.of(np.arange(len(h) - node + 1), node)
    span = window - node + 1
    at = np.unique(sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1))
    edges = np.zeros(len(at), dtype=np.int64)
    edges[:-1] = _name(spans.of(at[:-1], at[1:] + node - at[:-1]))
    return at, _name(grams[at]), edges


def _graphs(docs: DataFrame, text: str, window: int, node: int) -> DataFrame:
    """``doc_id, n, v, w, pos, node, edge``: words and names of each row's text; the graph's rows once for each task and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids = batch.column(0)
            for a, b in text_blocks(batch.column(1)):
                found = TextWords(batch.column(1).slice(a, b - a), False)
                h, first = found.h, found.first
                named, counts, cuts, parts = [], [], [0], [[], [], []]
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    named.append(names(found.spelled(i, j)))
                    counts.append(j - i)
                    size = 0
                    if j - i >= window and named[-1] not in seen:
                        seen.add(named[-1])
                        graph = graph_of(h[i:j], window, node)
                        size = len(graph[0])
                        for out, x in zip(parts, graph, strict=True):
                            out.append(x)
                    cuts.append(cuts[-1] + size)
                pos, nodes, edges = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in parts)
                offsets = pa.array(cuts, pa.int32())
                v, w = (pa.array(x, pa.int64()) for x in zip(*named, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(counts, pa.int64()), v, w, *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pos.astype(np.int32), nodes, edges))],
                    ["doc_id", "n", "v", "w", "pos", "node", "edge"],
                )

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, v long, w long, pos array<int>, node array<long>, edge array<long>")


def proposed(path: pa.Array, n: int, window: int, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a text's shared nodes (``pos, linked``), of its n window starts: the first and last of each range inside one path, and the
    starts of every other window that holds a shared node."""
    pos, linked = path.field("pos").to_numpy(), path.field("linked").to_numpy(zero_copy_only=False)
    touched = np.zeros(n + 1, dtype=np.int64)
    np.add.at(touched, np.maximum(pos - (window - node), 0), 1)
    np.add.at(touched, np.minimum(pos + 1, n), -1)
    open_ = np.cumsum(touched[:-1]) > 0
    heads = np.flatnonzero(np.concatenate([[True], ~linked[:-1]]))
    tails = np.concatenate([heads[1:] - 1, [len(pos) - 1]])
    lo, hi = pos[heads].astype(np.int64), pos[tails].astype(np.int64) + node - window
    lo, hi = lo[hi >= lo], hi[hi >= lo]
    for i, j in zip(lo.tolist(), hi.tolist(), strict=True):
        open_[i : j + 1] = False
    return lo, hi, np.flatnonzero(open_)


def _windows(docs: DataFrame, text: str, window: int, node: int, twice: frozenset[int], single: bool = False) -> DataFrame:
    """From ``doc_id, text, v, path`` rows, ranges of window starts with both names of their words: the ranges that lie inside one
    path, with a hash ``p`` of its words, and every other window that holds a shared node (``p`` is 0). ``single``: ``path`` has ranges,
    whose windows come one by one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_blocks(batch.column(1)):
                found = TextWords(batch.column(1).slice(a, b - a), False)
                for r in range(a, b):
                    at, end = found.first[r - a : r - a + 2].tolist()
                    v, w = names(found.spelled(at, end))
                    if (w if v in twice else v) != batch.column(2)[r].as_py():
                        continue  # another text under the same id
                    path = batch.column(3)[r].values
                    if single:
                        lo = hi = np.zeros(0, dtype=np.int64)
                        s = np.concatenate([np.arange(x["start"], x["end"] + 1) for x in path.to_pylist()])
                    else:
                        lo, hi, s = proposed(path, end - at - window + 1, window, node)
                    first, last = np.concatenate([lo, s]), np.concatenate([hi, s])
                    named = np.array([names(found.spelled(i, j)) for i, j in zip((at + first).tolist(), (at + last + window).tolist(), strict=True)], dtype=np.int64).reshape(-1, 2)
                    p = np.zeros(len(first), dtype=np.int64)
                    if len(lo):
                        p[: len(lo)] = _name(Spans(found.h[at:end]).of(lo, hi - lo + window))
                    rows = pa.array(np.full(len(first), r, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named[:, 0]), pa.array(named[:, 1]), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(p)],
                        ["w", "x", "doc_id", "v", "start", "end", "p"],
                    )

    return docs.select("doc_id", text, "v", "path").mapInArrow(run, f"w long, x long, doc_id {kind}, v long, start int, end int, p long")


def repeated_ranges(docs: DataFrame, text: str = "text", window: int = WINDOW, node: int = NODE) -> tuple[DataFrame, frozenset[int]]:
    """``doc_id, v, ranges`` (stored), and the first names that different texts share: for each text (by id and name ``v``) with
    repeats, the ranges of window starts, ends included, whose windows also start in a document with a smaller id."""
    named = stored(_graphs(docs, text, window, node))
    twice = shared_names(named)
    graphs = named.withColumn("v", final_name(twice)).drop("w")
    classes = stored(graphs.where(F.col("doc_id").isNotNull() & (F.col("n") >= window)).groupBy("v").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("n") - window).cast("int").alias("end")))
    again = stored(classes.where("low < high").select("v", "low"))
    copies = graphs.select("doc_id", "v", "n").join(small(again), "v").where("low < doc_id").select("doc_id", "v", whole.alias("ranges")).distinct()

    following = F.concat(F.slice("node", 2, F.size("node")), F.array(F.lit(0).cast("long")))
    edges = graphs.where(F.size("node") > 0).select("v", F.inline(F.arrays_zip("pos", "node", "edge", following.alias("next"))))
    shared = stored(edges.groupBy("node").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("node"))
    edges = stored(edges.join(shared, "node").select("v", "pos", "node", "edge", "next"))
    nodes = stored(edges.groupBy("node").agg(F.count("*").alias("c")))
    uses = stored(edges.where("edge <> 0").groupBy("edge").agg(F.count("*").alias("e")))
    counted = edges.join(nodes, "node").join(uses, "edge", "left").join(nodes.select(F.col("node").alias("next"), F.col("c").alias("d")), "next", "left")
    linked = F.coalesce((F.col("c") == F.col("e")) & (F.col("c") == F.col("d")), F.lit(False))
    paths = counted.groupBy("v").agg(F.array_sort(F.collect_set(F.struct("pos", linked.alias("linked")))).alias("path"))
    paths = stored(paths.join(classes.select("v", F.col("low").alias("_low")), "v"))
    discard(shared, edges, nodes, uses)

    few = stored(paths.select("_low").distinct())
    wanted = docs.select("doc_id", text).join(few, F.col("doc_id") == F.col("_low"), "left_semi")
    met = wanted.join(paths, F.col("doc_id") == F.col("_low")).select("doc_id", text, "v", "path")
    windows = stored(_windows(met, text, window, node, twice))
    ends = [F.min(F.struct("w", "x")).alias("a"), F.max(F.struct("w", "x")).alias("b")]
    mixed = stored(windows.where("p <> 0").groupBy("p").agg(*ends).where("a <> b").select("p"))
    every = windows.select("w", "x", "doc_id", "v", "start", "end")
    if not mixed.isEmpty():
        apart = windows.join(mixed, "p", "left_semi").groupBy("v", F.col("doc_id").alias("_low")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("path"))
        again_read = docs.select("doc_id", text).join(apart, F.col("doc_id") == F.col("_low")).select("doc_id", text, "v", "path")
        every = every.unionByName(_windows(again_read, text, window, node, twice, single=True).drop("p"))
    lows = stored(every.groupBy("w", "x").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("m")).where("l < m").select("w", "x", "l"))
    found = every.join(lows, ["w", "x"]).where("l < doc_id").select("doc_id", "v", "start", "end").distinct()
    # neighbouring starts become one range
    order = W.partitionBy("doc_id", "v").orderBy("start")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-9))
    island = F.sum((F.col("start") > F.col("_reach") + 1).cast("int")).over(order)
    ranges = found.withColumn("_reach", reach).withColumn("_i", island).groupBy("doc_id", "v", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ranges = ranges.groupBy("doc_id", "v").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    out = stored(ranges.join(copies, ["doc_id", "v"], "left_anti").unionByName(copies))
    discard(named, classes, again, paths, few, windows, mixed, lows)
    return out, twice


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, node: int = NODE) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: each text without the words that a window covers whose
    word sequence also starts in a document with a smaller ``doc_id``.

    Words stay as they are and are joined by one space. Windows are judged on the input. A text with fewer words than a window, an
    empty or a null one (no words) loses nothing; a row without id loses nothing and is no source; rows that share an id aren't
    smaller than each other. All columns of ``docs`` are kept but those named as an output, which are replaced; an empty table gives
    an empty table.
    """
    ranges, twice = repeated_ranges(docs, text, window, node)
    own, plan, done = fresh("_d", docs), fresh("_plan", docs), fresh("_k", docs)
    ranges = ranges.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("v", "ranges")).alias(plan))  # more than one only where ids repeat
    ranges = stored(ranges)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    planned = docs.join(small(ranges), F.col("doc_id") == F.col(own), "left")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, plans: pd.Series) -> pd.DataFrame:
        out = []
        for t, ways in zip(texts, plans, strict=True):
            words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
            n = len(words)
            if ways is not None and n >= window:
                v, w = names(b" ".join(words))
                for way in ways:
                    if way["v"] == (w if v in twice else v):
                        keep = np.ones(n, dtype=bool)
                        for r in way["ranges"]:
                            keep[r["start"] : r["end"] + window] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                        break
            out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    return planned.select(*kept, cut(F.col(text), F.col(plan)).alias(done)).select(*kept, f"{done}.*")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``: ``doc_id, n_words, n_removed, kept_sha256``."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
b AS MATERIALIZED (SELECT k.doc_id, k.i FROM k JOIN (SELECT x, min(doc_id) AS low FROM k GROUP BY 1) m ON k.x = m.x AND m.low < k.doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
c AS (SELECT p.doc_id, p.i, p.word,
             count(b.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
      FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND p.i = b.i),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(g.n_words, 0) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
