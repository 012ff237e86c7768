"""The pipeline's stages on edge rows and as a whole."""

from collections import defaultdict

import corpus_pipeline
from edge import edge_docs, edge_rows
from pyspark.sql import functions as F

from test_joins import brute_components

from framewright.llm.common import stored


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.count()
    assert seen["language_id"] >= 0.97 * 200 and seen["near_duplicates"] < seen["language_id"] and seen["secrets"] == seen["near_duplicates"]
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{12}")).count() == 0
    out = corpus_pipeline.packing(spark, docs, sf).collect()
    used = defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_edge_rows(spark, sf):
    docs = stored(edge_docs(spark))
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and 11 not in ids and 7 in ids and 10 in ids and {1, 2, 3, None} <= set(ids)
    assert corpus_pipeline.secrets(spark, docs, sf).count() == len(edge_rows())
    assert corpus_pipeline.mix(spark, docs, sf).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def plain_near_duplicates(rows):
    """One row of each group at 5 words and 80/100, the smallest id first; rows without words all stay."""
    named = [(i, r[1]) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted(((order[i][0], order[i][1]) for i, n, c in brute_components(named, 5, 80) if n == 0 or i == c), key=repr)


def test_near_duplicates_match_brute_force(spark, sf):
    w = [f"n{i}" for i in range(100)]
    near, other, third = " ".join(w), " ".join(x.upper() + "z" for x in w), " ".join(x[::-1] for x in w)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r[:2] for r in edge_rows()]
    rows += [(9001, near), (9002, near + " tail"), (9002, other), (9002, other), (9001, near), (9003, third), (None, third + " x"), (None, "alone without id here"), (None, "alone without id here"), (9004, ""), (9004, "")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars"))
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert kept == plain_near_duplicates(rows)
    assert kept.count((9002, other)) == 1 and kept.count((9001, near)) == 1 and kept.count((9004, "")) == 2 and (None, third + " x") not in kept


CLASHES = ["_row", "_first", "_gone", "_n", "_p", "_weak", "_linked", "base_spans", "all_spans", "_size", "_copy", "copy", "size", "taken", "target", "_key", "_plan", "_salt", "_rank", "sequence_id", "doc", "lang_pred", "score", "_d", "_k", "v", "w", "n", "key", "few", "component_id"]


def test_stages_bear_clashing_columns(spark, sf):
    """Every stage gives the same rows with columns that are named like its own."""
    docs = stored(edge_docs(spark))
    odd = stored(edge_docs(spark, CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        plain, more = stage(spark, docs, sf), stage(spark, odd, sf)
        if name == "packing":
            assert more.columns == plain.columns and more.count() == plain.count()
            continue
        assert more.columns == odd.columns
        assert sorted(map(repr, more.select(docs.columns).collect())) == sorted(map(repr, plain.collect()))
        assert {r[c] for r in more.collect() for c in CLASHES} <= {"clash"}


def test_run_is_its_stages(spark, sf):
    """The whole of ``run``: pieces of what is left, gapless, cut only beyond a sequence, and the ids of the tokenizer."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    from framewright.llm.packing import tokenizer_path

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
    tok, want = Tokenizer.from_file(tokenizer_path()), defaultdict(int)
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[r.doc_id, p // 4096, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for s in places.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096
