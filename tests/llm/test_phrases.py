"""op11 against a plain count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import edge_docs, edge_rows, lower
from pyspark.sql import functions as F

from framewright.llm import phrases


def plain(docs, least, best):
    n, f = Counter(), Counter()
    for t, lang in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, w[i : i + m]] = max(a, around[lang, w[i : i + m]])
    out = {}
    for (lang, w), a in candidates.items():
        if 100 * around[lang, w] < 80 * a:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)}


def mined(docs, least, best):
    got = phrases.score_cuts(*phrases.frequent_phrases(docs, least=least), best=best).collect()
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}


@pytest.mark.parametrize("bits", [None, 1 << 10])
def test_matches_plain_counts(spark, monkeypatch, bits):
    """Also with a bitmap in which nearly every bit is set, and blocks that hold a text or two."""
    if bits:
        monkeypatch.setattr(phrases, "MAX_BITS", bits)
        monkeypatch.setattr(phrases, "BLOCK", 200)
    rng = random.Random(11)
    vocabulary = ["The", "the", "of", "new", "york", "é", "漢字", "x", "\x1f", "c"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " - "]) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    rows = [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts] + [("New York city is new york city", "en")] * 40 + [(None, "en"), ("", None), (" . ", "fr"), ("a b " * 3000, "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).withColumn("phrase", F.lit("clash")).withColumn("f", F.lit(0))
    want = plain(rows, 5, 60)
    assert mined(docs, 5, 60) == want and len(want) > 200


def test_edge_rows(spark):
    rows = [(r[1], r[2]) for r in edge_rows()]
    assert mined(edge_docs(spark, ["words", "lang_", "a"]), 2, 50) == plain(rows, 2, 50)
    assert mined(edge_docs(spark).limit(0), 2, 50) == {}
    assert mined(edge_docs(spark), 10**6, 50) == {}


def test_codes_that_pass_62_bits():
    rng = np.random.default_rng(0)
    most = 1 << 30
    columns = [rng.choice([0, 1, most - 1], 500) for _ in range(4)]
    values, n = phrases.counted(columns, most)
    assert dict(zip(zip(*(c.tolist() for c in values)), n.tolist())) == Counter(zip(*(c.tolist() for c in columns)))


def test_filter_holds_back_phrases_of_rare_words():
    texts = pa.array(["a b c d. a b x"])
    bitmap = np.zeros(1 << 12, dtype=np.uint8)
    for w in (b"a", b"b", b"c"):
        both = np.concatenate(phrases._probes(phrases.phrase_hashes(phrases.word_hashes([w], "en")[None, :]), 8 * len(bitmap)))
        np.bitwise_or.at(bitmap, both >> np.uint64(3), (1 << (both & np.uint64(7))).astype(np.uint8))
    found, n = phrases.count_block(texts, "en", 2, bitmap)
    assert dict(zip(found.to_pylist(), n.tolist())) == {b"a b": 2, b"b c": 1}
