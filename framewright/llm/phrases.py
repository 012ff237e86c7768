"""Mining of collocations: frequent phrases of up to four words, by level-wise passes, scored at their weakest cut.

Pass k counts the k-word phrases of every text, but only those whose two overlapping (k-1)-word phrases are both frequent. What is
broadcast for this is a bitmap of the hashes of the frequent (k-1)-word phrases, 16 bits for each and 32 MB at most: a bit
set by chance lets a phrase through that the threshold then drops, so counts are exact at every size. Phrases are counted as codes within blocks of text, and as
their words from there on. Cuts are scored by joins of the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.common import batches_by_bytes, small, stored
from framewright.llm.wordhash import mix
from framewright.llm.wordlists import as_strings, kinds, split_words

MOST_WORDS, LEAST_COUNT, BEST = 4, 30, 2000
#: A candidate goes if a longer one around it has this share of its occurrences; scores are this many times a / (l + r).
INSIDE_PERCENT, SCALE = 80, 2_000_000
#: Bytes of text that a task gathers before it counts the language it has most of; a longer text is taken whole.
BLOCK = 3 << 20
#: Rows that leave a task at once.
OUT_ROWS = 1 << 15
#: Bits of a bitmap for each phrase, at least and at most in all.
BITS_EACH, LEAST_BITS, MAX_BITS = 16, 1 << 10, 1 << 28
KIND = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")


def phrase_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from their words' hashes, by phrase and place."""
    h = np.full(len(words), words.shape[1], dtype=np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(3) + words[:, k])
    return h


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def among(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether hashes may be of phrases in the bitmap; true for all that are."""
    a, b = _probes(h, 8 * len(bitmap))
    return (bitmap[a >> np.uint64(3)] >> (a & np.uint64(7)) & bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)) & 1).astype(bool)


def counted(columns: list[np.ndarray], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, whose values are under ``most``, and how often each occurs. Codes that would pass 62 bits are replaced by their rank on the way."""
    code, high, steps = columns[0].astype(np.int64), most, []
    for c in columns[1:]:
        if high * most >= 1 << 62:
            ranks, code = np.unique(code, return_inverse=True)
            steps.append(ranks)
            high = len(ranks)
        else:
            steps.append(None)
        code, high = code * most + c, high * most
    code, n = np.unique(code, return_counts=True)
    out = []
    for ranks in reversed(steps):
        code, last = np.divmod(code, most)
        out.append(last)
        code = code if ranks is None else ranks[code]
    return [code, *reversed(out)], n


def count_block(texts: pa.Array, lang: str, k: int, bitmap: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The k-word phrases of texts of one language, as space-joined strings, and their counts; for ``k`` of 1 also a null with the count of all."""
    words, codes, _, piece, *_ = split_words(texts, KIND)
    if k == 1:
        return pa.concat_arrays([words, pa.nulls(1, words.type)]), np.append(np.bincount(codes, minlength=len(words)), len(codes))
    n = len(codes) - k + 1
    if n < 1:
        return words.slice(0, 0), np.zeros(0, dtype=np.int64)
    whole = np.flatnonzero(piece[:n] == piece[k - 1 :])
    each = word_hashes(words.to_pylist(), lang)
    if k == 2:
        known = among(phrase_hashes(each[:, None]), bitmap)[codes]
    else:
        shorter = np.flatnonzero(piece[: n + 1] == piece[k - 2 :])
        known = np.zeros(n + 1, dtype=bool)
        known[shorter] = among(phrase_hashes(np.stack([each[codes[shorter + i]] for i in range(k - 1)], axis=1)), bitmap)
    at = whole[known[whole] & known[whole + 1]]
    kept = np.flatnonzero(np.bincount(np.concatenate([codes[at + i] for i in range(k)]), minlength=len(words)))
    dense = np.zeros(len(words), dtype=np.int64)
    dense[kept] = np.arange(len(kept))
    columns, counts = counted([dense[codes[at + i]] for i in range(k)], max(1, len(kept)))
    parts = [words.take(pa.array(kept[c])) for c in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type)), counts


def _counts(docs: DataFrame, k: int, bitmap) -> DataFrame:
    """``lang, phrase, f`` of all k-word phrases that pass ``bitmap`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        bits = np.frombuffer(bitmap.value, dtype=np.uint8) if bitmap is not None else None

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            parts = [x.cast(pa.large_string()) for x in held.pop(lang)]
            phrase, f = count_block(pa.concat_arrays(parts), lang, k, bits)
            for a in range(0, len(f), OUT_ROWS):
                n = f[a : a + OUT_ROWS].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), as_strings(phrase.slice(a, OUT_ROWS)), pa.array(n)], ["lang", "phrase", "f"])

        for batch in batches_by_bytes(batches, 1):
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, i))
                held.setdefault(lang, []).append(texts)
                sizes[lang] = sizes.get(lang, 0) + texts.nbytes
            while sum(sizes.values()) > BLOCK:
                yield from flush(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from flush(lang)

    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame, k: int, n: int) -> bytes:
    """Bits of the hashes of n stored phrases; what comes to the driver is no more than the bitmap."""
    bits = min(MAX_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h.append(phrase_hashes(word_hashes(phrase.split(b" "), lang)[None, :])[0])
            both = np.concatenate(_probes(np.array(h, dtype=np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(3)).astype(np.int64)), pa.array((1 << (both & np.uint64(7))).astype(np.int32))], ["place", "bit"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "place long, bit int").groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[found.column("place").to_numpy()] = found.column("bit").to_numpy().astype(np.uint8)
    return out.tobytes()


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: ``lang, phrase, words, f`` of all phrases with ``least`` occurrences or more, and ``lang, n``, the words of each language.

    A null language is ``und``, a null text empty. Occurrences overlap and lie within pieces; copies of a text count each. Other
    columns are left out, whatever their names; an empty table gives empty tables.
    """
    context = docs.sparkSession.sparkContext
    one = stored(_counts(docs, 1, None).where((F.col("f") >= least) | F.col("phrase").isNull()))
    totals = one.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    levels = [one.where("phrase IS NOT NULL").withColumn("words", F.lit(1))]
    for k in range(2, most_words + 1):
        n = levels[-1].count()
        if not n:
            break
        shared = context.broadcast(_bitmap(levels[-1], k - 1, n))
        levels.append(stored(_counts(docs, k, shared).where(F.col("f") >= least).withColumn("words", F.lit(k))))
        shared.destroy()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "phrase", "words", "f"), totals


def score_cuts(phrases: DataFrame, totals: DataFrame, best: int = BEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best of each language by their weakest cuts, without those that a longer phrase nearly always surrounds."""
    longer = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))

    def part(start, n):
        return F.array_join(F.slice("w", start, n), " ")

    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("words") - k).alias("tail")))
    cut = longer.select("lang", "phrase", "a", F.inline(cuts))
    known = phrases.select("lang", "phrase", "f")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cut = cut.join(small(heads), ["lang", "head"]).join(small(tails), ["lang", "tail"])
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE} div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: part(i, m))))
    around = longer.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.expr(f"around IS NULL OR CAST(around AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {INSIDE_PERCENT}"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(small(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language in all of ``documents``."""
    return score_cuts(*frequent_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
s AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, range(1, 5) t(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.phrase, c.k, c.f AS a, j, array_to_string(c.w[1:j], ' ') AS head, array_to_string(c.w[j + 1:], ' ') AS tail FROM c, range(1, 4) t(j) WHERE j < c.k),
y AS (SELECT x.lang, x.phrase, x.a, x.j, h.f AS l, t.f AS r, CAST(CAST(x.a AS HUGEINT) * 2000000 // (h.f + t.f) AS BIGINT) AS score
      FROM x JOIN f h ON x.lang = h.lang AND x.head = h.phrase JOIN f t ON x.lang = t.lang AND x.tail = t.phrase),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS first FROM y),
o AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, k, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY 1, 2),
q AS (SELECT z.* FROM z LEFT JOIN o ON z.lang = o.lang AND z.phrase = o.phrase WHERE z.first = 1 AND (o.f IS NULL OR 100 * o.f < 80 * z.a)),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q)
SELECT e.lang, e.rank, e.phrase, e.a, e.l, e.r, n.n, e.score FROM e JOIN n ON e.lang = n.lang WHERE e.rank <= 2000
"""
