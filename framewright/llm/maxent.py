"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Every word is a path through classes of classes: a class has at most 16 members of about equal mass, each a word or a class, and
the probability of a word is the product of one softmax for each class on its path. Words beyond the most frequent ones are one
member, ``rest``, inside which a word has its add-a-half share. A softmax has the log mass of its members as bias and adds a row of 16
weights for each feature: the last word, the last two and three (n-grams) and the word before the last (a skip). Rows are found
by hashing feature and class into one table of fixed size.

Training passes once over all training texts. Tasks start from the broadcast weights, take gradient steps (with Adagrad by row)
over minibatches of sparse rows, and emit their changes as integers, whose sums don't depend on order; a row's new weights are the
mean over the tasks that touched it. A first slice of the texts sets the weights that the others start from. Words become numbers once, in a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import BROADCAST_BYTES, discard, small, stored
from framewright.llm.wordhash import mix
from framewright.llm.wordlists import as_strings, kinds, split_words

#: Words in the classes, and bytes of one at most; bytes of the words that tasks look up. Rarer words are joined.
HEAD_WORDS, WORD_BYTES, LOOKUP_BYTES = 1 << 16, 64, BROADCAST_BYTES
WIDTH = 16
#: Rows of weights (a power of two), tokens of a minibatch, step size.
ROW_BITS, STEP_TOKENS, RATE = 18, 4096, 0.3
#: Of this many slices of the training texts one is the first round, the others the second; tokens of a training task, about.
SLICES, TASK_TOKENS = 8, 8_000_000
#: Rows that travel together, and the unit of a change.
BLOCK_ROWS, UNIT = 1 << 10, 2.0**-20
#: Bytes of text that a task splits into words at once, and tokens that it scores or learns from at once, about.
BLOCK, PART_TOKENS = 4 << 20, 1 << 17
#: Scores are cut here, which no sum of exponentials passes; rows as one value each.
HIGHEST, ONES, ROW = np.float32(80), np.ones(WIDTH, dtype=np.float32), np.dtype((np.void, 4 * WIDTH))
#: Words before a text.
BEFORE = 3
KIND = kinds(b" \t\n\x0b\x0c\r")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def held_out(doc_id: Column) -> Column:
    """True for the rows that the model doesn't learn from: crc32 of the id as text leaves 1 by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


@dataclass
class Classes:
    """The tree: ``bias`` by class and member (-1e9 where there is none), and the path of word w in ``node``, ``member`` from ``first[w]`` to ``first[w + 1]``."""

    bias: np.ndarray
    first: np.ndarray
    node: np.ndarray
    member: np.ndarray


def class_tree(mass: np.ndarray) -> Classes:
    """Classes of at most ``WIDTH`` members of about equal mass, from words in order of mass."""
    order = np.argsort(-mass, kind="stable")
    total = np.concatenate([[0.0], np.cumsum(mass[order])])
    paths: list[list[tuple[int, int]]] = [[] for _ in mass]
    bias = []
    todo = [(0, len(mass), [])]
    while todo:
        a, b, path = todo.pop()
        if b - a == 1 and path:
            paths[order[a]] = path
            continue
        number, cuts = len(bias), list(range(a, b)) if b - a <= WIDTH else [a]
        for k in range(WIDTH - 1 if b - a > WIDTH else 0):
            if cuts[-1] >= b - 1:
                break
            want = total[cuts[-1]] + (total[b] - total[cuts[-1]]) / (WIDTH - k)
            cut = int(np.searchsorted(total[: b + 1], want, side="right")) - 1
            cuts.append(min(max(cut, cuts[-1] + 1), b - 1))
        cuts.append(b)
        row = np.full(WIDTH, -1e9)
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            row[k] = np.log(total[y] - total[x])
            todo.append((x, y, [*path, (number, k)]))
        bias.append(row - row.max())
    first = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    flat = np.array([x for p in paths for x in p], dtype=np.int64).reshape(-1, 2)
    return Classes(np.array(bias, dtype=np.float32), first, flat[:, 0], flat[:, 1])


@dataclass
class Model:
    """Counts of the training tokens and, after training, the weights. ``words``: those in the classes, by number; ``rest`` and ``end`` follow."""

    words: pa.Array
    lookup: pa.Array
    lookup_counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    classes: Classes
    rest_tokens: int
    rest_words: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << ROW_BITS, WIDTH), dtype=np.float32))

    @property
    def rest(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1

    def base(self, count):
        """log10 of the add-a-half share of a token among all."""
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        start, lengths = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths)
        while start < batch.num_rows:
            used = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, used + max(0, BLOCK - size), side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(upto[stop - 1] - used)
            start = stop
            if size >= BLOCK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _texts(table: pa.Table, column: str) -> pa.Array:
    x = table.column(column)
    return pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` (stored) over the training texts; the null word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, 0):
            found = split_words(_texts(table, "text"), KIND)
            words = pa.concat_arrays([as_strings(found.words), pa.nulls(1, pa.string())])
            counts = np.append(np.bincount(found.codes, minlength=len(found.words)), table.num_rows)
            yield pa.RecordBatch.from_arrays([words, pa.array(counts.astype(np.int64))], ["word", "c"])

    texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    return stored(texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))


def prepare(counts: DataFrame) -> Model:
    """Classes and look-up table of the most frequent words that fit; what reaches the driver is bounded by ``LOOKUP_BYTES``."""
    words = counts.where("word IS NOT NULL")
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)).alias("ends")).first()
    short = words.where((F.octet_length("word") <= WORD_BYTES) & (F.col("c") > 1))
    tier = F.floor(F.log2(F.col("c").cast("double")) * 8)
    room, least = LOOKUP_BYTES, None
    for r in short.groupBy(tier.alias("tier")).agg(F.min("c").alias("c"), F.sum(F.octet_length("word") + 24).alias("bytes")).orderBy(F.desc("tier")).collect():  # some hundreds
        room -= r["bytes"]
        if room < 0:
            break
        least = r["c"]
    table = short.where(F.col("c") >= least if least else F.lit(False)).select("word", "c").toArrow()
    table = table.sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
    lookup, c = _texts(table, "word"), table.column("c").to_numpy()
    head = min(HEAD_WORDS, len(lookup))
    ends = int(seen["ends"])
    rest_tokens, rest_words = int(seen["n"]) - ends - int(c[:head].sum()), int(seen["v"]) - (ends > 0) - head
    mass = np.concatenate([c[:head], [rest_tokens + 0.5, max(ends, 0.5)]]).astype(np.float64)
    return Model(lookup.slice(0, head), lookup, c, int(seen["n"]), int(seen["v"]), ends, class_tree(mass), rest_tokens, rest_words)


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


def looked_up(words: pa.Array, hashes: np.ndarray, lookup: pa.Array, rank: np.ndarray) -> np.ndarray:
    """The rank of each word in ``lookup``, which is in order of its ``hashes``; -1 for a word that isn't there, or is second under its hash."""
    if not len(hashes):
        return np.full(len(words), -1)
    h = word_hashes(words)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    same = np.flatnonzero(hashes[at] == h)
    out = np.full(len(words), -1)
    equal = pc.equal(lookup.take(pa.array(at[same])).cast(pa.large_binary()), words.take(pa.array(same)))
    same = same[equal.to_numpy(zero_copy_only=False)]
    out[same] = rank[at[same]]
    return out


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n, known, base, rest, ids, others`` of each row: words and end mark, how many of them are known, log10 shares of known
    words, log10 shares within ``rest``, the text's word numbers, and the words that had no place in the look-up table, with their counts."""
    hashes = word_hashes(model.lookup)
    order = np.argsort(hashes, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], model.lookup.take(pa.array(order)), order.astype(np.int32), model.lookup_counts))
    head, rest, tokens, distinct, ends = len(model.words), model.rest, model.tokens, model.distinct, model.ends
    rest_all = model.rest_tokens + 0.5 * (model.rest_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lookup, rank, counts = shared.value
        share = np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))
        in_rest = np.where(np.arange(len(counts)) < head, 0.0, np.log10((counts + 0.5) / rest_all))
        end_share = np.log10((ends + 0.5) / (tokens + 0.5 * (distinct + 1)))
        for table in _blocks(batches, 2):
            n_rows = table.num_rows
            found = split_words(_texts(table, "text"), KIND)
            at = looked_up(found.words, hashes, lookup, rank)[found.codes]
            known = at >= 0  # the others' counts come by a join
            per = np.bincount(found.text, minlength=n_rows)
            base = np.bincount(found.text[known], weights=share[at[known]], minlength=n_rows) + end_share
            inner = np.bincount(found.text[known], weights=in_rest[at[known]], minlength=n_rows)
            ids = np.where(known & (at < head), at, rest).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            other = found.text[~known] * np.int64(max(1, len(found.words))) + found.codes[~known]
            other, times = np.unique(other, return_counts=True)
            doc, word = np.divmod(other, max(1, len(found.words)))
            cuts = np.searchsorted(doc, np.arange(n_rows + 1)).astype(np.int32)
            others = pa.StructArray.from_arrays([as_strings(found.words.take(pa.array(word))), pa.array(times.astype(np.int64))], ["word", "times"])
            n_known = np.bincount(found.text[known], minlength=n_rows) + (ends > 0)
            out = [table.column("doc_id"), table.column("held_out"), pa.array(per + 1), pa.array(n_known), pa.array(base.astype(np.float64)), pa.array(inner.astype(np.float64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.ListArray.from_arrays(pa.array(cuts), others)]
            for batch in pa.Table.from_arrays(out, ["doc_id", "held_out", "n", "known", "base", "rest", "ids", "others"]).combine_chunks().to_batches(max_chunksize=2048):
                yield batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = stored(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n long, known long, base double, rest double, ids array<int>, others array<struct<word:string,times:long>>").withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    return out


class Scorer:
    """Decisions, features and gradient steps of streams of word numbers; ``weights`` change as it learns."""

    def __init__(self, classes: Classes, weights: np.ndarray, end: int) -> None:
        self.classes, self.weights, self.end, self.before = classes, weights, end, end + 1
        self.shift = np.uint64(64 - int(len(weights)).bit_length() + 1)
        self.word = mix(np.arange(1, end + 3, dtype=np.uint64))
        self.class_ = mix(np.arange(len(classes.bias), dtype=np.uint64) + np.uint64(1 << 40))
        self.squares: np.ndarray | None = None

    def stream(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts one after the other, each between ``BEFORE`` marks and its end; and where its tokens are."""
        sizes = lengths + BEFORE + 1
        last = np.cumsum(sizes) - 1
        out = np.full(int(sizes.sum()), self.before, dtype=np.int64)
        inside = np.ones(len(out), dtype=bool)
        starts = last - lengths - BEFORE
        for k in range(BEFORE):
            inside[starts + k] = False
        inside[last] = False
        out[inside] = ids
        out[last] = self.end
        inside[last] = True
        return out, np.flatnonzero(inside)

    def decisions(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For tokens at ``at``: which of them each decision is of, its class, the member taken, and its rows by feature."""
        c, w = self.classes, s[at]
        depth = c.first[w + 1] - c.first[w]
        token = np.repeat(np.arange(len(at)), depth)
        step = np.arange(len(token)) - np.repeat(np.cumsum(depth) - depth, depth) + np.repeat(c.first[w], depth)
        node, member = c.node[step], c.member[step]
        one, two, three = self.word[s[at - 1]], self.word[s[at - 2]], self.word[s[at - 3]]
        pair = (one * ODD[0] + two) * ODD[1]
        features = np.stack([one * ODD[3], two * ODD[2] + ODD[0], pair, (pair + three) * ODD[2]])
        rows = ((features[:, token] ^ self.class_[node]) * ODD[0]) >> self.shift
        return token, node, member, rows.astype(np.int64)

    def scores(self, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of the members of each decision's class, whose exponentials are in proportion to their probabilities."""
        z = self.classes.bias.take(node, axis=0)
        for r in rows:
            z += self.weights.take(r, axis=0)
        return np.minimum(z, HIGHEST, out=z)

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        s, at = self.stream(ids, lengths)
        out = np.zeros(len(at))
        for i in range(0, len(at), STEP_TOKENS):
            token, node, member, rows = self.decisions(s, at[i : i + STEP_TOKENS])
            z = self.scores(node, rows)
            log = z[np.arange(len(z)), member] - np.log(np.exp(z) @ ONES)
            out[i : i + STEP_TOKENS] = np.bincount(token, weights=log, minlength=len(at[i : i + STEP_TOKENS]))
        return np.add.reduceat(out, np.cumsum(lengths + 1) - lengths - 1) / np.log(10) if len(lengths) else out

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """One gradient step for each minibatch: a row moves by its summed gradient over the root of its summed squares."""
        if self.squares is None:
            self.squares = np.ones(len(self.weights), dtype=np.float32)
        s, at = self.stream(ids, lengths)
        for i in range(0, len(at), STEP_TOKENS):
            _, node, member, rows = self.decisions(s, at[i : i + STEP_TOKENS])
            g = np.exp(self.scores(node, rows))
            g /= (g @ ONES)[:, None]
            g[np.arange(len(g)), member] -= 1
            touched, total = summed(rows, g)
            self.squares[touched] += np.einsum("ij,ij->i", total, total) / WIDTH
            total *= (RATE / np.sqrt(self.squares[touched]))[:, None]
            whole = self.weights.view(ROW).reshape(-1)
            whole[touched] = (self.weights.take(touched, axis=0) - total).view(ROW).reshape(-1)


def summed(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``rows`` (by feature and decision), and the sums of the decisions' gradients over their places."""
    flat = rows.reshape(-1).astype(np.uint64)
    bits = np.uint64(int(len(flat)).bit_length())
    ranked = np.sort(flat << bits | np.arange(len(flat), dtype=np.uint64))
    of = (ranked & np.uint64((1 << int(bits)) - 1)).astype(np.int64) % len(g)
    ranked >>= bits
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    heads = np.flatnonzero(new)
    total = g.take(of[heads], axis=0)
    more = np.flatnonzero(~new)  # the others are added to the first
    if len(more):
        place = np.cumsum(new)[more] - 1
        again = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        total[place[again]] += np.add.reduceat(np.ascontiguousarray(g.take(of[more], axis=0).T), again, axis=1).T
    return ranked[heads].astype(np.int64), total


def _lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and lengths of the rows, about ``PART_TOKENS`` tokens at once."""
    x = batch.column(column)
    ids, lengths = x.flatten().to_numpy(), x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        used = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, used + PART_TOKENS, side="right")))
        yield ids[used : upto[stop - 1]], lengths[start:stop]
        start = stop


def _round(encoded: DataFrame, model: Model, tokens: int) -> None:
    """Passes once over the rows, in tasks of about ``TASK_TOKENS``, and moves the model's weights by the mean change."""
    context = encoded.sparkSession.sparkContext
    shared = context.broadcast((model.classes, model.weights, model.end))
    n_rows = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights, end = shared.value
        scorer = Scorer(classes, weights.copy(), end)
        for batch in batches:
            for part in _lists(batch, 0):
                scorer.learn(*part)
        if scorer.squares is None:
            return
        change = np.rint((scorer.weights - weights) / UNIT).astype(np.int32)
        moved = (change != 0).any(axis=1)
        for a in range(0, n_rows, BLOCK_ROWS):
            rows = np.flatnonzero(moved[a : a + BLOCK_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK_ROWS], pa.int32()), pa.array([rows.astype(np.int16).tobytes()], pa.binary()), pa.array([change[a + rows].tobytes()], pa.binary())], ["block", "rows", "change"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, rows, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, times = sums.setdefault(block, (np.zeros((BLOCK_ROWS, WIDTH), dtype=np.int64), np.zeros(BLOCK_ROWS, dtype=np.int64)))
                at = np.frombuffer(rows, dtype=np.int16)
                total[at] += np.frombuffer(change, dtype=np.int32).reshape(-1, WIDTH)
                times[at] += 1
        for block, (total, times) in sums.items():
            mean = (total * UNIT / np.maximum(times, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "mean"])

    changes = encoded.select("ids").coalesce(max(1, -(-tokens // TASK_TOKENS))).mapInArrow(run, "block int, rows binary, change binary")
    for r in changes.repartition("block").mapInArrow(merge, "block int, mean binary").toArrow().to_pylist():  # as large as the model
        mean = np.frombuffer(r["mean"], dtype=np.float32).reshape(BLOCK_ROWS, WIDTH)
        at = r["block"] * BLOCK_ROWS
        model.weights[at : at + BLOCK_ROWS] += mean[: n_rows - at]
    shared.destroy()


def train(encoded: DataFrame, model: Model) -> None:
    """All training rows of ``encoded`` once, in two rounds."""
    slice_ = F.pmod(F.xxhash64("row"), F.lit(SLICES))
    learn = encoded.where("NOT held_out")
    n = learn.groupBy((slice_ == 0).alias("first")).agg(F.sum("n").alias("n")).collect()
    tokens = {r["first"]: r["n"] for r in n}
    for first in (True, False):
        if tokens.get(first):
            _round(learn.where((slice_ == 0) == first), model, tokens[first])


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``; it learns from those not held out.

    Words are lower-cased in A-Z; the end of a text is a token. A null or empty text is its end alone; repeated rows each count
    and each get a row; a null id counts as the empty text. Other columns are left out, whatever their names. Without
    training rows every word has the share of an unknown one. An empty table gives an empty table.
    """
    counts = count_words(docs)
    model = prepare(counts)
    encoded = encode(docs, model)
    train(encoded, model)

    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.classes, model.weights, model.end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([scorer.score(*part) for part in _lists(batch, 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "model"])

    scored = stored(encoded.select("row", "ids").mapInArrow(run, "row long, model double"))
    shared.destroy()

    # words without a place in the look-up table: their counts come by a join
    others = encoded.select("row", F.inline("others")).join(small(counts.where("word IS NOT NULL")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))

    def log_share(of, distinct):
        return F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(of + 0.5 * (distinct + 1)))

    sums = [F.sum(log_share(model.tokens, model.distinct)).alias("more_base"), F.sum(log_share(model.rest_tokens, model.rest_words)).alias("more_rest"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("more_known")]
    more = others.groupBy("row").agg(*sums)
    whole = encoded.select("row", "doc_id", "held_out", "n", "known", "base", "rest").join(scored, "row").join(more, "row", "left").fillna(0, ["more_base", "more_rest", "more_known"])
    out = whole.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"), (F.col("model") + F.col("rest") + F.col("more_rest")).alias("score"),
    )
    out = stored(out)
    discard(counts, encoded, scored)
    return out


def op12_maxent_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
