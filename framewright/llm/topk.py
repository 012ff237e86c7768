"""Exact top-k search by inner product over KD-trees, one for each shard.

Rows are dealt to shards by coarse cells of space, so that shards have tight boxes; a cell that holds more is dealt on by a hash. Each
shard is a KD-tree of median splits with tight bounding boxes. A query goes to its own shard first; its kth score there is carried
to the other shards, and those whose root box can't beat it are left out before anything is moved. In a tree, bounds go down from
the root, a query keeps only nodes that may beat its kth best, and its leaves are visited in the order of the largest inner product
that their boxes allow until none can; queries that visit the same leaf are scored together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import discard, small, stored

LEAF = 256
#: Rows of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
#: Vectors of a length that are sampled to cut space into cells, and lengths that are cut so, the most frequent ones; vectors of other
#: lengths are dealt by a hash alone.
SAMPLE_VECTORS, CUT_LENGTHS = 8192, 16
#: Beyond this magnitude sums of products might not be exact in doubles.
EXACT = 2.0**52
#: Bounds of shards, in doubles, are loosened by this share of their terms, so that rounding drops nothing.
SLACK = 1e-9
#: The largest magnitude of a component; a vector beyond it takes no part.
LARGEST = 2**62


@dataclass
class Tree:
    """Rows reordered by leaf. ``low``, ``high``: boxes of nodes; ``first``, ``last``: their rows; ``child``: the first of two children or -1."""

    ids: np.ndarray
    rows: np.ndarray
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    least_id: list[int] = field(default_factory=list)


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """Splits at the median of the widest side until a node has ``leaf`` rows or its box is a point."""
    order = np.arange(len(ids))
    t = Tree(ids, rows)

    def node(a: int, b: int) -> int:
        part = rows[order[a:b]]
        t.low.append(part.min(axis=0))
        t.high.append(part.max(axis=0))
        t.first.append(a)
        t.last.append(b)
        t.child.append(-1)
        t.least_id.append(int(ids[order[a:b]].min()))
        return len(t.first) - 1

    open_ = [node(0, len(ids))] if len(ids) else []
    while open_:
        i = open_.pop()
        a, b = t.first[i], t.last[i]
        wide = t.high[i].astype(np.float64) - t.low[i] if rows.shape[1] else np.zeros(1)
        if b - a <= leaf or wide.max() == 0:
            continue
        middle = (b - a) // 2
        side = rows[order[a:b], int(wide.argmax())]
        order[a:b] = order[a:b][np.argpartition(side, middle)]
        t.child[i] = node(a, a + middle)
        open_ += [t.child[i], node(a + middle, b)]
    t.ids, t.rows = ids[order], rows[order]
    return t


def search(tree: Tree, qid: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray, bound_id: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query ``(position, scores, ids)`` of at most ``k`` rows that come before ``(bound, bound_id)`` in the order of larger
    score, then smaller id. Rows with the query's id take no part."""
    if not len(tree.ids) or not len(qid):
        return []
    low, high = np.array(tree.low), np.array(tree.high)
    top = max(float(np.abs(x).max(initial=0)) for x in (low, high)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    as_ = np.float64 if top < EXACT else object
    q, rows = queries.astype(as_), tree.rows.astype(as_)
    best = np.maximum(q, 0) @ high.astype(as_).T + np.minimum(q, 0) @ low.astype(as_).T  # the most that each box allows
    limit, last = bound.astype(as_), bound_id.astype(np.int64)
    scores, ids = [np.zeros(0, dtype=as_) for _ in q], [np.zeros(0, dtype=np.int64) for _ in q]

    least = np.array(tree.least_id)
    may = (best > limit[:, None]) | (best == limit[:, None]) & (least <= last[:, None])
    for i, c in enumerate(tree.child):  # parents come before their children
        if c >= 0:
            may[:, c : c + 2] &= may[:, i : i + 1]
    leaves = np.flatnonzero(np.array(tree.child) < 0)
    order = np.argsort(-best[:, leaves].astype(np.float64), axis=1, kind="stable")
    active = np.arange(len(q))
    for turn in range(len(leaves)):
        leaf = leaves[order[active, turn]]
        beats = best[active, leaf] >= limit[active]
        if as_ is np.float64:  # exact: the bounds of the leaves that follow are no larger
            active, leaf, beats = active[beats], leaf[beats], beats[beats]
        if not len(active):
            break
        going = may[active, leaf] & beats.astype(bool)
        for n in np.unique(leaf[going]).tolist():
            who = active[(leaf == n) & going]
            a, b = tree.first[n], tree.last[n]
            s, d = q[who] @ rows[a:b].T, tree.ids[a:b]
            ok = ((s > limit[who, None]) | (s == limit[who, None]) & (d <= last[who, None])) & (d != qid[who, None])
            for j in np.flatnonzero(ok.any(axis=1)).tolist():
                i = who[j]
                all_s, all_d = np.concatenate([scores[i], s[j][ok[j]]]), np.concatenate([ids[i], d[ok[j]]])
                o = np.lexsort((all_d, -all_s))[:k]
                scores[i], ids[i] = all_s[o], all_d[o]
                if len(o) == k:
                    limit[i], last[i] = scores[i][-1], ids[i][-1]
    return [(i, scores[i], ids[i]) for i in range(len(q)) if len(ids[i])]


def _searched(queries: DataFrame, shards: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Queries against the shards that they meet by ``keys``."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = build(right["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, dtype=np.int64) for v in right["v"]]))
            qid = left["query_id"].to_numpy(np.int64)
            vectors = np.stack([np.asarray(v, dtype=np.int64) for v in left["q"]])
            bound = [-float("inf") if b is None or b != b else int(b) for b in left["bound"]]
            last = [np.iinfo(np.int64).max if b is None or b != b else int(b) for b in left["bound_id"]]
            for i, scores, ids in search(tree, qid, vectors, k, np.array(bound, dtype=object), np.array(last, dtype=np.int64)):
                out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return queries.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def cuts_of(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Median splits of a sample as a heap of axes and thresholds, with ``cells`` (a power of two) leaves."""
    axis, at, parts = np.zeros(cells - 1, dtype=np.int64), np.zeros(cells - 1, dtype=np.int64), {0: sample}
    for i in range(cells - 1):
        part = parts.pop(i)
        if len(part):
            axis[i] = int((part.max(axis=0).astype(np.float64) - part.min(axis=0)).argmax())
            at[i] = np.sort(part[:, axis[i]])[len(part) // 2]
        side = part[:, axis[i]] < at[i]
        parts[2 * i + 1], parts[2 * i + 2] = part[side], part[~side]
    return axis, at


def _cells(sized: DataFrame, totals: DataFrame, shard_rows: int) -> DataFrame:
    """``sized(vec_id, v, dim)`` with the ``cell`` of each vector, by cuts through a bounded sample of each frequent length."""
    large = totals.where((F.col("n") > shard_rows) & (F.col("dim") > 0)).orderBy(F.desc("n")).limit(CUT_LENGTHS)
    cuts = {}
    for r in large.collect():
        share = min(1.0, 1.2 * SAMPLE_VECTORS / r["n"])
        rows = sized.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        sample = np.array([x["v"] for x in rows.select("v").limit(SAMPLE_VECTORS).collect()], dtype=np.int64).reshape(-1, r["dim"])
        cells = 1 << max(0, int(np.ceil(np.log2(r["n"] / shard_rows))))
        cuts[r["dim"]] = cuts_of(sample, min(cells, 1 << 10))
    shared = sized.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), dtype=np.int32)
        lengths = vectors.map(len).to_numpy()
        for dim, (axis, at) in shared.value.items():
            mine = np.flatnonzero(lengths == dim)
            if len(mine) and len(axis):
                x, i = np.stack([np.asarray(v, dtype=np.int64) for v in vectors.iloc[mine]]), np.zeros(len(mine), dtype=np.int64)
                while i.min() < len(axis):
                    go = i < len(axis)
                    j = i[go]
                    i[go] = 2 * j + 1 + (x[go, axis[j]] >= at[j])
                out[mine] = i - len(axis)
        return pd.Series(out)

    return sized.withColumn("cell", cell("v"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each row of ``vectors(vec_id, v array<long>)`` that
    ``is_query`` picks with every row of another ``vec_id``, ties to the smaller id.

    Vectors that are null or hold nulls must have been dropped. A query meets vectors of its own length alone. A repeated
    ``vec_id`` is one query, by its smallest vector; as candidates repeated rows each count. Fewer candidates than ``k`` give
    fewer rows, an empty table none.
    """
    sized = stored(vectors.select("vec_id", "v", F.size("v").alias("dim")))
    totals = stored(sized.groupBy("dim").agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("nq")))
    celled = stored(_cells(sized, totals, shard_rows))
    plan = totals.select("dim", F.greatest(F.lit(1), F.ceil(F.col("nq") / block).cast("int")).alias("blocks"))
    counts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    before = F.sum("parts").over(W.partitionBy("dim").orderBy("cell")) - F.col("parts")
    shards = F.sum("parts").over(W.partitionBy("dim"))
    plan = stored(counts.select("dim", "cell", "parts", before.cast("int").alias("first"), shards.cast("int").alias("shards")).join(F.broadcast(plan), "dim"))
    dealt = celled.join(small(plan), ["dim", "cell"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
    dealt = stored(dealt.select("vec_id", "v", "dim", "shard", "shards", "blocks"))
    discard(sized, totals, celled, plan)

    ends = dealt.select("dim", "shard", F.posexplode("v").alias("i", "x")).groupBy("dim", "shard", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes = stored(ends.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("box")))
    queries = dealt.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "shard", "shards", "blocks")).alias("s")).select(F.col("vec_id").alias("query_id"), "s.*")
    queries = stored(queries.select("query_id", F.col("v").alias("q"), "dim", "shards", F.col("shard").alias("home"), F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int").alias("block")))
    nothing = F.lit(None).cast("long")
    copies = dealt.select("vec_id", "v", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    keys = ["dim", "shard", "block"]
    at_home = queries.select("query_id", "q", "dim", F.col("home").alias("shard"), "block", nothing.alias("bound"), nothing.alias("bound_id"))
    first = stored(_best(_searched(at_home, copies, keys, k), k))
    kth = stored(first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"), F.col("vec_id").alias("bound_id")))
    away = queries.join(small(kth), "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> home")
    away = away.join(small(boxes), ["dim", "shard"], "left").where(F.col("bound").isNull() | F.col("box").isNull() | (_most(F.col("q"), F.col("box")) >= F.col("bound")))
    rest = _searched(away.select("query_id", "q", *keys, "bound", "bound_id"), copies, keys, k)
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def _most(q: Column, box: Column) -> Column:
    """The largest inner product that a box of ``i, low, high`` allows, a little more for rounding."""

    def add(sums: Column, x: Column) -> Column:
        a, b = x["q"].cast("double") * x["b"]["low"], x["q"].cast("double") * x["b"]["high"]
        return F.struct((sums["most"] + F.greatest(a, b)).alias("most"), (sums["size"] + F.greatest(F.abs(a), F.abs(b))).alias("size"))

    nothing = F.struct(F.lit(0.0).alias("most"), F.lit(0.0).alias("size"))
    return F.aggregate(F.arrays_zip(q.alias("q"), box.alias("b")), nothing, add, lambda s: s["most"] + s["size"] * SLACK)


def scaled_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` with each component x as floor(64 * x). Vectors that are null, hold nulls or numbers that aren't finite, or
    leave the range of a long, are dropped, as are rows without ``vec_id``."""
    doubles = F.col("embedding").cast("array<double>")
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST) / 64))
    whole = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return whole.select("vec_id", F.transform(doubles, lambda x: F.floor(x * 64.0).cast("long")).alias("v"))


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for each row whose ``vec_id`` is divisible by 20: ``query_id, rank, vec_id, score``."""
    vectors = scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
