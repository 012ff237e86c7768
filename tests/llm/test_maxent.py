"""op12: plain counts for the base, a plain walk of the classes for the model, and what it gains on texts that it hasn't seen."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import edge_docs, edge_rows, lower, words
from pyspark.sql import functions as F

from framewright.llm import maxent


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def plain_base(rows):
    """``[(held_out, n_tokens, n_known, N, base)]`` of ``(doc_id, text)`` rows."""
    tokens = [[*words(lower(t)), None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n = sum(c.values())
    return [(held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in ws)) for (i, _), ws in zip(rows, tokens)]


def checked(spark, rows, docs):
    want = sorted((str(i), *b[:4], round(b[4], 6)) for (i, _), b in zip(rows, plain_base(rows)))
    got = maxent.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    return got


def test_edge_rows(spark, monkeypatch):
    rows = [r[:2] for r in edge_rows()]
    checked(spark, rows, edge_docs(spark, ["row", "word", "n"]))
    monkeypatch.setattr(maxent, "LOOKUP_BYTES", 200)  # nearly all words come by the join
    monkeypatch.setattr(maxent, "BLOCK", 300)
    got = checked(spark, rows, edge_docs(spark, ["row", "word", "n"]))
    same = [r.score for r in got if r.doc_id in (10, 11)]
    assert abs(same[0] - same[1]) < 1e-6
    assert maxent.score_documents(edge_docs(spark).limit(0)).count() == 0
    only = spark.createDataFrame([(i, "nothing to learn from") for i in range(40) if held(i)], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score) for r in maxent.score_documents(only).collect()} == {(0, 0, 0.0)}


def plain_score(model, text):
    """log10 probability of a text, word by word and class by class."""
    number = {w.decode(): i for i, w in enumerate(model.words.cast("binary").to_pylist())}
    count = dict(zip(model.lookup.to_pylist(), model.lookup_counts.tolist()))
    total, ids = 0.0, [model.end + 1] * 3
    hashes = maxent.mix(np.arange(1, model.end + 3, dtype=np.uint64))
    classes = maxent.mix(np.arange(len(model.classes.bias), dtype=np.uint64) + np.uint64(1 << 40))
    odd, high = [int(x) for x in maxent.ODD], 1 << 64
    for w in [*words(lower(text)), None]:
        i = model.end if w is None else number.get(w, model.rest)
        if i == model.rest:
            total += math.log10((count.get(w, 0) + 0.5) / (model.rest_tokens + 0.5 * (model.rest_words + 1)))
        one, two, three = (int(hashes[x]) for x in ids[::-1])
        pair = (one * odd[0] + two) * odd[1] % high
        features = [one * odd[3], two * odd[2] + odd[0], pair, (pair + three) * odd[2]]
        for step in range(model.classes.first[i], model.classes.first[i + 1]):
            node = int(model.classes.node[step])
            z = model.classes.bias[node].astype(np.float64)
            for f in features:
                z = z + model.weights[(((f % high) ^ int(classes[node])) * odd[0] % high) >> (64 - maxent.ROW_BITS)]
            total += math.log10(np.exp(z[model.classes.member[step]]) / np.exp(z).sum())
        ids = [*ids[1:], i]
    return total


@pytest.fixture(scope="module")
def trained(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = maxent.prepare(maxent.count_words(docs))
    maxent.train(maxent.encode(docs, model), model)
    return model


def test_scores_are_those_of_a_plain_walk(spark, sf, trained):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = maxent.encode(docs, trained).select("doc_id", "ids", "rest", F.size("others").alias("others")).where("size(ids) < 300").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    scorer = maxent.Scorer(trained.classes, trained.weights, trained.end)
    lengths = np.array([len(r.ids) for r in encoded])
    got = scorer.score(np.array([x for r in encoded for x in r.ids]), lengths) + np.array([r.rest for r in encoded])
    some = [k for k, r in enumerate(encoded) if not r.others][:25]
    assert len(some) > 10 and np.abs(trained.weights).max() > 0.1
    for k in some:
        assert abs(got[k] - plain_score(trained, texts[encoded[k].doc_id])) < 1e-3 * max(1, abs(got[k]))


def test_probabilities_of_all_next_words_sum_to_one(trained):
    scorer = maxent.Scorer(trained.classes, trained.weights, trained.end)
    rng = np.random.default_rng(1)
    n = trained.end + 1
    for _ in range(3):
        before = rng.integers(0, n, 3)
        s = np.concatenate([np.concatenate([before, [w]]) for w in range(n)])
        token, node, member, rows = scorer.decisions(s, np.arange(3, len(s), 4))
        p = np.exp(scorer.scores(node, rows).astype(np.float64))
        p = p[np.arange(len(p)), member] / p.sum(axis=1)
        assert abs(np.exp(np.bincount(token, weights=np.log(p))).sum() - 1) < 1e-3


def test_gains_on_unseen_texts(spark):
    got = maxent.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got.s - got.b) / got.n > 0.03  # log10 a token


def test_sums_of_sparse_rows():
    rng = np.random.default_rng(4)
    for n, most in ((1, 3), (50, 4), (700, 300), (700, 10**6)):
        rows, g = rng.integers(0, most, (4, n)), rng.random((n, maxent.WIDTH)).astype(np.float32)
        touched, total = maxent.summed(rows, g)
        assert touched.tolist() == sorted(set(rows.reshape(-1).tolist()))
        for t, x in zip(touched[:40], total):
            assert np.allclose(x, sum((rows[f] == t) @ g for f in range(4)), atol=1e-4)


def test_classes_hold_every_word_once():
    for n, seed in ((2, 0), (17, 1), (300, 2), (5000, 3)):
        mass = np.sort(1 / np.random.default_rng(seed).random(n))[::-1]
        c = maxent.class_tree(mass)
        paths = [tuple(zip(c.node[a:b].tolist(), c.member[a:b].tolist())) for a, b in zip(c.first[:-1], c.first[1:])]
        assert len(set(paths)) == n and min(map(len, paths)) >= 1
        p = np.exp(c.bias.astype(np.float64))
        p /= p.sum(axis=1, keepdims=True)
        share = np.array([np.prod([p[x] for x in path]) for path in paths])
        assert np.allclose(share, mass / mass.sum(), rtol=1e-3)
