"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts. A context that has seen a byte n times among N predicts it with
n / (N + q), where q is the number of different bytes it has seen; the escape, q / (N + q), hands the remaining bytes to the
context one byte shorter, whose probabilities are scaled to the bytes not yet seen. Statistics are frozen after training, so
a byte's code length depends on the bytes before it alone: the trees become sparse tables by (context, byte, language), and the
exact code length of a text is a sum of look-ups. The language with the shortest code wins. Languages whose tables don't fit
together are scored in blocks, one pass over the texts for each, so neither contexts nor languages are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import batches_by_bytes, fresh, giving_back, small, stored

#: Bytes of context.
ORDER = 3
#: Labelled rows sampled for each language, a documented parameter.
SAMPLE_ROWS = 2500
#: What one block of languages may hold: entries of its largest table, languages. A language that is larger is alone in its block.
BLOCK_ENTRIES = 12_000_000
BLOCK_LANGUAGES = 32
#: The longest code of a byte.
MAX_BITS = -np.log2(1e-30)
#: Bytes that a task scores at once.
BLOCK = 1 << 19


def held_out(doc_id: Column) -> Column:
    """True for one row in five, by crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _bytes(text: str) -> bytes:
    return b" " * ORDER + text.lower().encode("utf-8", "replace")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n``: counts of ``ORDER + 1`` bytes in the lower-cased texts, the gram packed into a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, 1):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, texts, strict=True):
                b = np.frombuffer(_bytes(text), dtype=np.uint8).astype(np.int64)
                if len(b) > ORDER:
                    gram = np.zeros(len(b) - ORDER, dtype=np.int64)
                    for k in range(ORDER + 1):
                        gram = gram << 8 | b[k : len(gram) + k]
                    by.setdefault(lang, []).append(gram)
            for lang, grams in by.items():
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = labelled.select("lang", "text").mapInArrow(giving_back(run), "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Tables of a block of languages, with a column for each. ``root``: bits of a byte in the empty context. For each order from 1:
    ``keys``, the sorted contexts-and-bytes that a language of the block has seen, packed, and their ``bits``; ``contexts``, and the
    bits of their escapes, 0 where a language hasn't seen the context. ``alphabet`` are the bytes seen in training."""

    languages: list[str]
    alphabet: np.ndarray
    root: np.ndarray
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @property
    def cost(self) -> np.ndarray:
        """The whole table, for small models: bits by context of the highest order and by byte, one that was never seen first."""
        new = np.setdiff1d(np.arange(256), self.alphabet)[:1]
        grams = self.contexts[-1].astype(np.int64)[:, None] << 8 | np.concatenate([new, self.alphabet])[None, :]
        return gram_bits(self, grams.ravel().astype(np.uint32))


def fit(counts: pd.DataFrame, alphabet: np.ndarray | None = None) -> Model:
    """The frozen tables from ``lang, gram, n`` rows; an empty frame gives a model without languages. ``alphabet`` are the bytes of
    all languages if these rows are of some only."""
    languages = sorted(counts["lang"].unique())
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    if alphabet is None:
        alphabet = np.unique(np.concatenate([gram >> 8 * k & 255 for k in range(ORDER + 1)]))
    if not languages:
        return Model([], alphabet, np.zeros((256, 0), dtype=np.float32), [], [], [], [])
    number = {x: j for j, x in enumerate(languages)}
    lang, size = counts["lang"].map(number).to_numpy(np.int64), len(alphabet) + 1
    mine = [np.flatnonzero(lang == j) for j in range(len(languages))]

    root = np.zeros((256, len(languages)), dtype=np.float32)
    prob = []  # of each language's own keys of the order below
    for j, at in enumerate(mine):
        c = np.bincount(gram[at] & 255, weights=n[at], minlength=256)
        q = np.count_nonzero(c)
        p = (c + q / size) / (c.sum() + q)  # what escapes from the empty context is uniform
        root[:, j] = -np.log2(p)
        prob.append((np.arange(256), p))
    below, lower = np.arange(256), root
    all_keys, all_bits, all_contexts, all_escapes = [], [], [], []
    for k in range(1, ORDER + 1):
        packed = gram & ((1 << 8 * (k + 1)) - 1)
        keys = np.unique(packed)
        contexts = np.unique(keys >> 8)
        escapes = np.zeros((len(contexts), len(languages)), dtype=np.float32)
        own = []
        for j, at in enumerate(mine):
            key, which = np.unique(packed[at], return_inverse=True)
            c = np.bincount(which, weights=n[at])
            context, of = np.unique(key >> 8, return_inverse=True)
            low = prob[j][1][np.searchsorted(prob[j][0], key & ((1 << 8 * k) - 1))]
            total, q, rest = np.bincount(of, weights=c), np.bincount(of), 1 - np.bincount(of, weights=low)
            closed = rest <= 1e-12  # every byte has been seen: nothing to escape to
            p = c / np.where(closed, total, total + q)[of]
            escapes[np.searchsorted(contexts, context), j] = np.where(closed, 2 * MAX_BITS, -np.log2(q / (total + q) / np.where(closed, 1.0, rest)))
            prob[j] = key, p
            own.append((np.searchsorted(keys, key), p))
        bits = escapes[np.searchsorted(contexts, keys >> 8)]
        bits += lower[np.searchsorted(below, keys & ((1 << 8 * k) - 1))]
        for j, (rows, p) in enumerate(own):
            bits[rows, j] = -np.log2(p)
        all_keys.append(keys.astype(np.uint32))
        all_bits.append(bits)
        all_contexts.append(contexts.astype(np.uint32))
        all_escapes.append(escapes)
        below, lower = keys, bits
    return Model(languages, alphabet, root, all_keys, all_bits, all_contexts, all_escapes)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether each is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_bits(model: Model, grams: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each packed gram after the bytes before it, by language."""
    at, there = _found(model.keys[-1], grams)
    out = model.bits[-1][at]
    left = np.flatnonzero(~there)
    out[left] = 0
    for k in range(ORDER, 0, -1):  # what no language has seen escapes to the context one byte shorter
        g = grams[left]
        at, there = _found(model.contexts[k - 1], g >> np.uint32(8))
        out[left[there]] += model.escapes[k - 1][at[there]]
        grams = grams & np.uint32((1 << 8 * k) - 1)
        g = grams[left]
        if k == 1:
            out[left] += model.root[g]
            break
        at, there = _found(model.keys[k - 2], g)
        out[left[there]] += model.bits[k - 2][at[there]]
        left = left[~there]
    return np.minimum(out, np.float32(MAX_BITS), out=out)


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Bits of each whole text by language, one row for each text; nothing for an empty text."""
    out = np.zeros((len(texts), len(model.languages)))

    def score(rows: list[int], pieces: list[bytes]) -> None:
        s = np.frombuffer(b" " * ORDER + b"".join(pieces), dtype=np.uint8).astype(np.uint32)
        grams = s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]
        starts = np.cumsum([0, *map(len, pieces[:-1])])
        ends = np.stack([starts, starts + ORDER], axis=1).ravel()  # the context before a text, then the text
        bits = np.add.reduceat(gram_bits(model, grams), ends, axis=0, dtype=np.float64)[1::2]
        np.add.at(out, rows, bits)

    rows, pieces, used = [], [], 0
    for i, text in enumerate(texts):
        b = _bytes(text)
        for j in range(0, len(b) - ORDER, BLOCK):  # blocks of a long text overlap by the context
            rows.append(i)
            pieces.append(b[j : j + BLOCK + ORDER])
            used += len(pieces[-1])
            if used >= BLOCK:
                score(rows, pieces)
                rows, pieces, used = [], [], 0
    if rows:
        score(rows, pieces)
    return out


@dataclass(frozen=True)
class Trained:
    """Counts ``lang, gram, n`` (stored) of all languages, and the blocks in which the languages are scored."""

    counts: DataFrame
    alphabet: np.ndarray
    blocks: list[list[str]]

    def model(self, block: int) -> Model:
        mine = self.blocks[block]
        number = F.array_position(F.lit(mine), F.col("lang")).cast("int") - 1
        rows = self.counts.where(F.col("lang").isin(mine)).select(number.alias("lang"), "gram", "n").toPandas()
        return fit(rows.assign(lang=pd.Categorical.from_codes(rows["lang"], mine).astype(object)), self.alphabet)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, entries: int = BLOCK_ENTRIES, languages: int = BLOCK_LANGUAGES) -> Trained:
    """What the rows of ``docs`` tell that have a language, a text and aren't held out.

    About ``rows`` texts of each language are seen, chosen by a hash of the id, whole. All languages and all that is counted in
    these texts are kept. A block has at most ``languages`` languages and ``entries`` entries; a language beyond that is alone.
    """
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    totals = stored(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("_share")))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.col("_share") * (1 << 30)
    sampled = labelled.where(F.col("text").isNotNull()).join(small(totals), "lang").where(chosen)
    counts = stored(gram_counts(sampled))
    last = [r.b for r in counts.select(F.col("gram").bitwiseAND(F.lit(255)).alias("b")).distinct().collect()]
    blocks: list[list[str]] = []
    keys = 0
    for lang, n in sorted(map(tuple, counts.groupBy("lang").count().collect())):
        if not blocks or len(blocks[-1]) == languages or (keys + n) * (len(blocks[-1]) + 1) > entries:
            blocks.append([])
            keys = 0
        blocks[-1].append(lang)
        keys += n
    return Trained(counts, np.unique([32, *last]), blocks)


def _scores(model: Model, series: pd.Series) -> pd.DataFrame:
    """Of each text the best language, its bits, the sum of 2 ** -(bits above those) over languages, and the text's bytes; -1 bytes
    if it is null or has no letter."""
    texts = [t if isinstance(t, str) and any(map(str.isalpha, t)) else "" for t in series]
    bits = code_lengths(model, texts)
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(texts)), best]
    weight = np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
    n = [len(t.encode("utf-8", "replace")) or -1 for t in texts]
    return pd.DataFrame({"bits": least, "lang": [model.languages[b] for b in best], "weight": weight, "n": np.array(n, dtype=np.int64)})


def identify(docs: DataFrame, trained: Trained, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` of every whole text.

    ``score`` is the posterior of the predicted language given equal priors; ties go to the first language by code point. A text
    that is null or has no letter is ``und`` with score 0, as is every text if there are no languages. Equal texts, and repeated rows, get
    equal results; texts of any length are scored whole. Other columns are kept but those named as an output; an empty table gives an
    empty table.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    found, row, all_, sum_of = (fresh(x, docs) for x in ("_p", "_row", "_all", "_weight"))

    def scores(block: int) -> tuple[Column, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(trained.model(block))

        @F.pandas_udf("bits double, lang string, weight double, n long")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from giving_back(lambda parts: (_scores(shared.value, x) for x in parts))(batches)

        return predict(text), shared

    def named(df: DataFrame, bits: Column, lang: Column, weight: Column, n: Column) -> DataFrame:
        outputs = F.when(n > 0, lang).otherwise("und"), F.when(n > 0, 1 / weight).otherwise(0.0), F.when(n > 0, bits / n).otherwise(0.0)
        return df.select(*kept, *[c.alias(x) for c, x in zip(outputs, ("lang_pred", "score", "bits_per_byte"), strict=True)])

    if not trained.blocks:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    if len(trained.blocks) == 1:
        return named(docs.select(*kept, scores(0)[0].alias(found)), *[F.col(f"{found}.{x}") for x in ("bits", "lang", "weight", "n")])
    rows = stored(docs.select(*kept, *[c for c in (text,) if c not in kept]).withColumn(row, F.monotonically_increasing_id()))
    parts = []
    for block in range(len(trained.blocks)):
        predict, shared = scores(block)
        parts.append(stored(rows.select(row, predict.alias(found))))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy(row).agg(F.collect_list(found).alias(all_)).withColumn(found, F.array_min(all_))
    weight = F.aggregate(all_, F.lit(0.0), lambda sum_, x: sum_ + x["weight"] * F.pow(F.lit(2.0), -F.least(x["bits"] - F.col(f"{found}.bits"), F.lit(1000.0))))
    best = every.select(row, found, weight.alias(sum_of))
    return named(rows.join(best, row), F.col(f"{found}.bits"), F.col(f"{found}.lang"), F.col(sum_of), F.col(f"{found}.n"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: ``doc_id, held_out, lang_pred, score``; learned from rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "lang", "text")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
