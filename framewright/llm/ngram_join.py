"""Exact similarity join of documents by the Jaccard similarity of their word n-grams.

Sets of hashed n-grams are compared within tiles: documents of one size band whose hashed signatures agree in one of the
band's slices. Two sets that link differ in few n-grams, fewer than there are slices, so they agree in a slice that holds two
n-grams or more (see ``Band``); no link is missed, however common single n-grams are. Within a tile all documents are
compared with its hub, the one that shares most tiles, and then only those of different components with each other, in blocks of
bitmaps. A bitmap holds the parity of the n-grams that hash to each bit, and its size follows the set's, so the differing bits of two
bitmaps are at most the n-grams that only one set has: they bound the overlap from above, closely enough that few pairs which do
not link leave a tile. What is left is decided by exact intersection of sorted arrays of codes, which stand for the bytes of the words.

Hashes lose no link and make none: n-grams that share a hash only bring sets closer, sizes are counted by codes, and a set
is named by a digest of its text's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import discard, giving_back, small, stored
from framewright.llm.components import components
from framewright.llm.wordhash import TextWords, final_name, mix, names, shared_names, text_blocks

#: Links: 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 85
#: Bits of a bitmap: at least two for each n-gram, within these bounds.
LEAST_BITS, MAX_BITS = 64, 1 << 22
BAND_GROWTH = 1.35
MAX_SIZE = 1 << 40
#: Members of a tile that are compared at once with as many others, and bytes of their bitmaps, about.
TILE_ROWS, TILE_BYTES = 1024, 16 << 20


@dataclass(frozen=True)
class Band:
    """Sizes up to ``top``. Linked sets s, t of the band have s + t <= 2 * top and differ in at most ``apart`` n-grams, so of
    ``slices`` slices at least slices - apart agree. A set skips its slices of fewer than k n-grams for the largest k <= 2 for
    which these are fewer than slices - apart; of two linked sets the one with the larger k emits an agreeing slice, which the
    other then emits too."""

    bottom: int
    top: int
    apart: int
    slices: int


def bands(percent: int) -> list[Band]:
    out, bottom = [], 1
    while bottom < MAX_SIZE:
        top = max(bottom, int(bottom * BAND_GROWTH) - 1)
        apart = 2 * top * (100 - percent) // (100 + percent)
        out.append(Band(bottom, top, apart, apart + 1 + 1 + apart // 8))
        bottom = top + 1
    return out


def gram_codes(found: TextWords, words: int) -> np.ndarray:
    """For each place in the texts taken as one sequence a number that is equal for equal n-grams alone."""
    n, most = max(0, len(found.codes) - words + 1), found.distinct
    code, high = found.codes[:n].astype(np.int64), most
    for k in range(1, words):
        if high * most >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            high = int(code.max(initial=0)) + 1
        code, high = code * most + found.codes[k : n + k], high * most
    return code


def ngram_sets(found: TextWords, words: int) -> list[tuple[int, np.ndarray]]:
    """Each text's number of distinct n-grams, and their sorted distinct hashes; a text with fewer words has one for all its words, one without words none."""
    grams, codes, out = _grams(found.h, words), gram_codes(found, words), []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append((len(np.unique(codes[a : b - words + 1])), np.unique(grams[a : b - words + 1])))
        else:
            out.append((int(b > a), np.unique(_grams(found.h[a:b], max(1, b - a)))))
    return out


def _grams(h: np.ndarray, words: int) -> np.ndarray:
    n = max(0, len(h) - words + 1)
    g = np.full(n, words, dtype=np.uint64)
    for k in range(words):
        g = mix(g * np.uint64(3) + h[k : n + k])
    return g


def tile_keys(s: np.ndarray, n: int, plan: list[Band], bottoms: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles that a set of n n-grams with these sorted hashes belongs to: those of its own band, and of higher bands with sizes it may link to."""
    out = []
    mixed = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    i = int(np.searchsorted(bottoms, n, side="right")) - 1
    while i < len(plan) and 100 * n >= percent * plan[i].bottom:
        band, i = plan[i], i + 1
        if not band.apart:  # only equal sets link
            out.append(mix(mixed.sum(keepdims=True) + np.uint64(n << 20)))
            continue
        edges = np.searchsorted(s, (np.arange(1, band.slices, dtype=np.float64) * (2.0**64 / band.slices)).astype(np.uint64))
        edges = np.concatenate([[0], edges, [len(s)]])
        counts = np.diff(edges)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed)])
        sums = sums[edges[1:]] - sums[edges[:-1]]
        least = next(k for k in (2, 1, 0) if (counts < k).sum() < band.slices - band.apart)
        slice_no = np.arange(band.slices, dtype=np.uint64)
        key = mix(sums + mix(slice_no + np.uint64(band.bottom << 20)))
        out.append(key[counts >= least])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _rows(docs: DataFrame, text: str, words: int, what: str, schema: str, percent: int = PERCENT, twice: frozenset[int] = frozenset()) -> DataFrame:
    """One pass over texts. ``what``: ``ids`` (doc_id, size, both names of the text, and once for each task and text the keys of its tiles) or,
    once for each task and text, ``bits`` (name, size, bitmap) or ``texts`` (name, size, words). ``twice``: first names that different texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        plan = bands(percent)
        bottoms = np.array([b.bottom for b in plan])
        for batch in batches:
            ids = batch.column(0)
            for a, b in text_blocks(batch.column(1)):
                found = TextWords(batch.column(1).slice(a, b - a), True)
                spelled = [found.spelled(i, j) for i, j in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)]
                both = [names(x) for x in spelled]
                sets = ngram_sets(found, words)
                if what == "ids":
                    keys = [None if x in seen or seen.add(x) or not n else tile_keys(s, n, plan, bottoms, percent).view(np.int64) for x, (n, s) in zip(both, sets, strict=True)]
                    v, w = (pa.array(x, pa.int64()) for x in zip(*both, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([n for n, _ in sets], pa.int64()), v, w, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "v", "w", "keys"])
                    continue
                name = [w if v in twice else v for v, w in both]
                new = [i for i, v in enumerate(name) if sets[i][0] and not (v in seen or seen.add(v))]
                last = [bitmap(sets[i][1]) for i in new] if what == "bits" else [spelled[i] for i in new]
                yield pa.RecordBatch.from_arrays([pa.array([name[i] for i in new], pa.int64()), pa.array([sets[i][0] for i in new], pa.int64()), pa.array(last, pa.binary())], ["v", "n", what])

    return docs.select("doc_id", text).mapInArrow(giving_back(run), schema)


def bitmap(s: np.ndarray) -> bytes:
    """Two bits or more for each n-gram: the parity of the n-grams that hash to each bit."""
    size = min(MAX_BITS, max(LEAST_BITS, 1 << int(2 * len(s) - 1).bit_length()))
    at = (s >> np.uint64(40)) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size) & 1).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of one length, the shortest; longer ones are folded, which keeps parities."""
    size = min(map(len, maps)) // 8
    if max(map(len, maps)) // 8 == size:
        return np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(-1, size)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, dtype=np.uint64).reshape(-1, size), axis=0) for m in maps])


def may_link(n1: np.ndarray, n2: np.ndarray, b1: np.ndarray, b2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes may link: an n-gram of one alone flips one bit, so at least the differing bits are of one alone."""
    apart = np.bitwise_count(b1 ^ b2).sum(axis=-1, dtype=np.int64)
    return (n1 + n2 - apart) // 2 >= -(-percent * (n1 + n2) // (100 + percent))


def _named(docs: DataFrame, text: str, words: int, what: str, classes: DataFrame, twice: frozenset[int]) -> DataFrame:
    """``bits`` or ``texts`` of the sets in ``classes(v, few)`` (stored), from the texts of their smallest ids alone; stored."""
    few = small(classes.select(F.col("few").alias("_few")))
    texts = docs.select("doc_id", text).join(few, F.col("doc_id").eqNullSafe(F.col("_few")), "left_semi")
    return stored(_rows(texts, text, words, what, f"v long, n long, {what} binary", twice=twice).join(small(classes.select("v")), "v", "left_semi").dropDuplicates(["v"]))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` (stored, and deleted) that may link by their sizes and bitmaps, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keep = [may_link(a, b, *folded([x, y]), percent) for a, b, x, y in zip(n1, n2, batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("v").alias("u"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    right = sets.select("v", F.col("n").alias("n2"), F.col("bits").alias("b2"))
    both = left.join(small(pairs), "u").join(right, "v").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    out = stored(both.select("u", "v", "n1", "b1", "n2", "b2").mapInArrow(giving_back(run), "u long, v long"))
    discard(pairs)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` (stored) whose sets link, by exact intersection of their n-grams (``texts`` is stored, and deleted); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, dtype=bool)
            sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            for a, b in text_blocks(batch.column(3), batch.column(5)):
                found = TextWords(pa.concat_arrays([batch.column(c).slice(a, b - a) for c in (3, 5)]), False)
                codes, first = gram_codes(found, words), found.first
                ends = np.maximum(first[1:] - words + 1, first[:-1])
                for i in range(b - a):
                    x, y = (np.unique(codes[first[k] : ends[k]]) for k in (i, i + b - a))
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    hit[a + i] = (100 + percent) * shared >= percent * sizes[a + i]
            yield batch.select(["u", "v"]).filter(pa.array(hit))

    both = texts.select(F.col("v").alias("u"), F.col("n").alias("n1"), F.col("texts").alias("t1")).join(small(pairs), "u").join(texts.select("v", F.col("n").alias("n2"), F.col("texts").alias("t2")), "v")
    out = stored(both.select("u", "v", "n1", "t1", "n2", "t2").mapInArrow(giving_back(run), "u long, v long"))
    discard(texts)
    return out


def _crossing(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` of one tile that are of different components and may link, from ``key, blocks, v, r, n, bits`` rows.

    A tile is dealt in blocks of about ``TILE_ROWS`` rows and ``TILE_BYTES`` bytes by a hash; every pair of blocks is one group of rows,
    compared by bitmaps alone, so that only pairs that may link leave it.
    """
    dealt = members.withColumn("c", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("c", "other")).withColumn("j", F.greatest("c", "other"))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(v: np.ndarray, r: np.ndarray, n: np.ndarray, c: np.ndarray, bits: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(v) <= 64 and bits.shape[1] <= 256:  # all pairs at once take 4 MB at most
            a, b = np.triu_indices(len(v), 1)
            ok = (r[a] != r[b]) & ((c[a] != c[b]) if two else True)
            a, b = a[ok], b[ok]
            ok = may_link(n[a], n[b], bits[a], bits[b], percent)
            return v[a[ok]], v[b[ok]]
        left, right = [], []
        for a in range(len(v) - 1):
            b = np.flatnonzero((r[a + 1 :] != r[a]) & ((c[a + 1 :] != c[a]) if two else True)) + a + 1
            b = b[may_link(n[a], n[b], bits[a], bits[b], percent)]
            left.append(np.full(len(b), v[a]))
            right.append(v[b])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _ended(batches):
            now = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest is not None or batch is not None else None
            if now is None or not now.num_rows:
                continue
            whole = now.to_batches()[0]
            key, i, j = (whole.column(x).to_numpy() for x in range(3))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = [0, *edge.tolist(), *([len(key)] if batch is None else [])]
            v, r, n, c = (whole.column(x).to_numpy() for x in range(3, 7))
            maps = whole.column(7).to_pylist()
            found = [pairs(v[x:y], r[x:y], n[x:y], c[x:y], folded(maps[x:y]), bool(i[x] != j[x])) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1]
            rest = whole.slice(cuts[-1]) if batch is not None else None
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    return dealt.select("key", "i", "j", "v", "r", "n", "c", "bits").mapInArrow(giving_back(run), "u long, v long").distinct()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _tiles(keys: DataFrame) -> DataFrame:
    """``key, v`` of tiles with two sets or more, from ``v, key``; tiles of the same sets become one, named by a hash of its members.

    Should two tiles share a name, they are worked on as one, which loses no pair. The large shuffle of keys is unreachable on
    return, so that Spark can drop it.
    """
    in_key = W.partitionBy("key")
    low = F.col("v").bitwiseAND(F.lit((1 << 31) - 1))
    met = keys.select("v", F.min("v").over(in_key).alias("a"), F.max("v").over(in_key).alias("b"), F.count("*").over(in_key).alias("n"), F.sum(low).over(in_key).alias("lows"))
    return stored(met.where("a < b").select(F.xxhash64("a", "b", "n", "lows").alias("key"), "v").distinct())


def similar_documents(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are lower-cased in A-Z alone. ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included; a
    row without words (or with a null text) links with nothing. Rows with a null id are compared too, but give no id to a component
    (null if it has none else). Rows that repeat an id each get a row. Other columns are left out, whatever their names; a text of
    any length is one set; an empty table gives an empty table.
    """
    named = stored(_rows(docs, text, words, "ids", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, v long, w long, keys array<long>", percent))
    twice = shared_names(named)
    slim = named.select("doc_id", "n", final_name(twice).alias("v"))
    tiles = _tiles(named.select(final_name(twice).alias("v"), F.explode("keys").alias("key")))
    met = stored(tiles.groupBy("v").agg(F.count("*").alias("degree")))
    classes = stored(slim.join(small(met), "v").groupBy("v").agg(F.min("doc_id").alias("few")))
    sets = _named(docs, text, words, "bits", classes, twice)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "v")
        few = stored(classes.join(ends, "v"))
        links = _verified(pairs, _named(docs, text, words, "texts", few, twice), words, percent)
        discard(few)
        return links

    hubs = stored(tiles.join(small(met), "v").groupBy("key").agg(F.max_by("v", "degree").alias("u")))
    stars = _bounded(stored(tiles.join(small(hubs), "key").where("u <> v").select("u", "v").distinct()), sets, percent)
    links = verified(stars)
    discard(met, hubs)

    roots = components(links)
    rooted = stored(sets.select("v", "n").join(small(roots.withColumnRenamed("node", "v")), "v", "left").select("v", "n", F.coalesce("root", "v").alias("r")))
    labelled = stored(tiles.join(small(rooted), "v").select("key", "v", "r", "n"))
    room = F.least(F.greatest(F.col("n") / 2, F.lit(LEAST_BITS / 8)), F.lit(MAX_BITS / 8))  # a bitmap has at most 4 bits for each n-gram
    blocks = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(room) / TILE_BYTES)).cast("int")
    mixed = stored(labelled.groupBy("key").agg(F.min("r").alias("a"), F.max("r").alias("b"), blocks.alias("blocks")).where("a < b").select("key", "blocks"))
    discard(roots, rooted, tiles)
    found = _crossing(labelled.join(small(mixed), "key").join(sets.select("v", "bits"), "v"), percent)
    crossing = stored(found.join(stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"))
    discard(labelled, mixed, stars, sets)
    more = verified(crossing)
    roots = components(links.union(more)).select(F.col("node").alias("v"), "root")
    discard(crossing, links, more, classes)

    grouped = slim.join(small(roots), "v", "left").withColumn("_c", F.when(F.col("n") > 0, F.coalesce("root", "v")))
    smallest = stored(grouped.where("n > 0").groupBy("_c").agg(F.min("doc_id").alias("component_id")))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return grouped.join(small(smallest), "_c", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` by 4-word shingles at 85/100: ``doc_id, n_shingles, component_id``."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * k >= 85 * (n + m - k)),
t AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.v FROM r JOIN t ON r.b = t.u),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON s.doc_id = c.a
"""
