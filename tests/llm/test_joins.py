"""N-gram join, substring removal and components against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from edge import edge_docs, edge_rows, lower, words
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import ngram_join
from framewright.llm.components import components
from framewright.llm.ngram_join import bands, ngram_sets, op6_ngram_jaccard_join, similar_documents, tile_keys
from framewright.llm.substring_dedup import op7_substring_dedup, remove_repeats
from framewright.llm.wordhash import Spans, TextWords


def brute_components(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def removed(rows, window=50):
    low = {}
    for d, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[j : j + window])
                low[k] = min(low.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if d is not None and low[tuple(w[j : j + window])] < d:
                keep[j : j + window] = [False] * window
        out.append((d, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep) if y).encode()).hexdigest()))
    return sorted(out, key=repr)


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op6_matches_brute_force(spark, sf):
    assert rows_of(op6_ngram_jaccard_join(spark, sf)) == brute_components(documents(spark, sf))


def test_op6_edges(spark):
    got = similar_documents(edge_docs(spark, ["v", "n", "key"]))
    assert rows_of(got) == brute_components([r[:2] for r in edge_rows()])
    assert similar_documents(edge_docs(spark).limit(0)).count() == 0


def test_op6_texts_that_only_rows_without_id_hold(spark):
    w = [f"n{i}" for i in range(200)]
    changed = lambda k: " ".join(x + "!" if i < k else x for i, x in enumerate(w))
    rows = [(1, changed(0)), (None, changed(12)), (2, changed(24)), (3, "quite another text of six words"), (None, "a b c d e f g h"), (None, "a b c d e f g h")]
    assert brute_components(rows)[:2] == [(1, 197, 1), (2, 197, 1)] and brute_components([r for r in rows if r[0]])[1] == (2, 197, 2)
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(got) == brute_components(rows)


def test_op6_near_copies_that_link_only_among_themselves(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for p in rng.choice(150, rng.integers(0, 12), replace=False):
            w[p] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    assert rows_of(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_components(rows)


def test_op6_long_texts_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_BYTES", 20_000)
    rng, rows = np.random.default_rng(3), []
    for g in range(2):
        base = rng.integers(0, 10**9, 12_000)
        for i in range(12):
            w, k = base.copy(), rng.integers(0, 400)
            w[rng.choice(len(w), k, replace=False)] = rng.integers(0, 10**9, k)
            rows.append((100 * g + i, " ".join(map(str, w))))
    assert rows_of(similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute_components(rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_sets_share_a_tile(n, gone, new, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n + new, dtype=np.uint64))
    s, t = np.sort(a[: len(a) - min(new, len(a) - 1)]), np.sort(a[min(gone, len(a) - 1) :])
    k = len(np.intersect1d(s, t))
    if 100 * k >= 85 * (len(s) + len(t) - k) and not np.array_equal(s, t):
        plan = bands(85)
        bottoms = np.array([b.bottom for b in plan])
        assert set(tile_keys(s, len(s), plan, bottoms, 85).tolist()) & set(tile_keys(t, len(t), plan, bottoms, 85).tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n é", max_size=12), max_size=6))
def test_word_hashes_follow_words(texts):
    found = TextWords(texts, False)
    flat, h = [w for t in texts for w in words(t)], found.h
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist())) == len({*zip(flat, found.codes.tolist())})
    assert [found.spelled(a, b).decode() for a, b in zip(found.first[:-1], found.first[1:])] == [" ".join(words(t)) for t in texts]
    sets = ngram_sets(found, 2)
    for t, (n, s) in zip(texts, sets, strict=True):
        w = words(t)
        assert n == len(s) == (len({*zip(w, w[1:])}) if len(w) > 1 else len(w))


#: Of each pair both words had one hash under an invertible mix of eight bytes after eight.
ONCE_COLLIDED = [("passwordabcdefgh", "*q~6kYk~.MK|mTH("), ("passwordabcdefgh", "b]h)ab@dare<t>cz")]


@pytest.mark.parametrize("a, b", ONCE_COLLIDED)
def test_words_that_once_shared_a_hash(spark, a, b):
    from pyspark.sql import functions as F

    head = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*head, a])), (2, " ".join([*head, b])), (3, a), (4, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(similar_documents(docs)) == brute_components(rows)
    got = remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(got) == removed(rows) and {r.n_removed for r in got.collect()} == {0}


@pytest.mark.parametrize("bits", [8, 0])
def test_hashes_of_few_bits_change_no_result(spark, sf, monkeypatch, bits):
    """Nearly every word shares its hash with others."""
    from pyspark.sql import functions as F

    from framewright.llm import substring_dedup

    class Few(TextWords):
        def __init__(self, texts, lower):
            super().__init__(texts, lower)
            self.h = self.h & np.uint64((1 << bits) - 1)

    monkeypatch.setattr(ngram_join, "TextWords", Few)
    monkeypatch.setattr(substring_dedup, "TextWords", Few)
    rng = np.random.default_rng(bits)
    base = [f"b{i}" for i in range(90)]
    rows = documents(spark, sf)[:: 2 if bits else 4]
    for i in range(60):
        w = list(base)
        for k in rng.choice(90, rng.integers(0, 6), replace=False):
            w[k] = f"e{rng.integers(50)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000, "a b c d a b c d"), (20_001, "b c d a b c d a"), (20_002, "a b c d a b c d a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(similar_documents(docs)) == brute_components(rows)
    got = remove_repeats(docs)
    assert rows_of(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == removed(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_op7_matches_brute_force(spark, sf):
    assert rows_of(op7_substring_dedup(spark, sf)) == removed(documents(spark, sf))


def test_op7_edges(spark):
    from pyspark.sql import functions as F

    docs = edge_docs(spark, ["v", "path", "n_words"])
    got = remove_repeats(docs)
    assert sorted(got.columns) == sorted({*docs.columns, "n_removed", "kept_text"})
    assert rows_of(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == removed([r[:2] for r in edge_rows()])
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_op7_branching_passages(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [[f"q{k}_{i}" for i in range(rng.integers(40, 130))] for k in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.integers(1, 4)):
            p = pool[rng.integers(6)]
            a = int(rng.integers(0, 30))
            parts += [f"u{d}_{i}" for i in range(rng.integers(0, 9))] + p[a : a + int(rng.integers(30, 130))]
        rows.append((d, " ".join(parts)))
    from pyspark.sql import functions as F

    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == removed(rows)


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_op7_words_in_a_pattern_that_defeats_linear_hashes(spark):
    from pyspark.sql import functions as F

    bits = thue_morse(2048)
    text = lambda flip: " ".join(x for i, b in enumerate(bits) for x in ("ab"[b ^ flip], f"u{i}"))
    rows = [(1, text(0)), (2, text(1)), (3, text(0))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == removed(rows)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, 0, 4096]


def test_op6_words_in_a_pattern_that_defeats_linear_hashes(spark):
    word = lambda flip, n: "".join("ab"[b ^ flip] for b in thue_morse(n))
    rows = [(1, word(0, 2048)), (2, word(1, 2048)), (3, word(0, 1024)), (4, word(1, 1024)), (5, word(0, 2048))]
    assert rows_of(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_components(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def test_names_that_different_texts_share_are_told_apart(spark, sf, monkeypatch):
    """First names of a few bits, so that many texts share one: results stay the same."""
    from pyspark.sql import functions as F

    from framewright.llm import ngram_join, substring_dedup, wordhash

    whole = wordhash.names
    few = lambda x: (whole(x)[0] % 64 + 1, whole(x)[1]) if len(x) else (0, 0)
    monkeypatch.setattr(ngram_join, "names", few)
    monkeypatch.setattr(substring_dedup, "names", few)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert rows_of(similar_documents(docs)) == brute_components(documents(spark, sf))
    got = remove_repeats(docs)
    assert rows_of(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == removed(documents(spark, sf))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=90), st.integers(1, 90))
def test_span_hashes_follow_values(values, n):
    n = min(n, len(values))
    starts = np.arange(len(values) - n + 1)
    h = Spans(np.array(values, dtype=np.uint64)).of(starts, n)
    spans = [tuple(values[i : i + n]) for i in starts]
    assert len({*zip(spans, h.tolist())}) == len(set(spans)) == len(set(h.tolist()))
