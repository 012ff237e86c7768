"""op13 against a plain simulation of every order, row by row."""

import itertools
import re
from collections import Counter

from edge import edge_docs, edge_rows, words
from pyspark.sql import functions as F

from framewright.llm import filter_audit


def plain(docs, labels):
    """``{(part, order, step): counts}`` of ``(doc_id, text, lang)`` rows, filter by filter."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    lowest = {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    fails = []
    for i, t, lang in docs:
        text, w = t or "", words(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and lowest[text] < i}
        fails.append((lang or "", i, {x for x, bad in f.items() if bad}))
    out, by_filter = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed, kept = [x for x in left if f in x[2]], [x for x in left if f not in x[2]]
                out[part, order, step] = [len(kept), len(removed), sum(f in x[2] for x in gone), sum(x[2] == {f} for x in left + gone), sum(x[1] in good for x in removed), sum(x[1] in toxic for x in removed)]
                by_filter[part, f] += len(removed)
                left, gone = kept, gone + removed
    return {k: [*v, by_filter[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_orders_of_edge_rows(spark):
    docs = edge_rows() + [(30 + k, f"CAPS {'A$' * k} word " * (1 + 40 * (k % 3)), ["en", None, ""][k % 3], None, 0) for k in range(12)]
    docs += [(9, docs[6][1], "fr", None, 0), (9, docs[6][1], "fr", None, 0), (None, docs[6][1], "fr", None, 0), (None, docs[6][1], "fr", None, 0)] + [(i, docs[6][1], "xx", None, 0) for i in range(100, 160)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 160, 3)] + [(9, 1, 1), (9, 0, 0), (None, 1, 1), (31, None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(0))
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.order_outcomes(filter_audit.failure_counts(frame, marks)).collect()}
    want = plain([d[:3] for d in docs], labels)
    assert got == want and len(got) == 600 * len({k[0] for k in want})


def test_empty_tables(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.order_outcomes(filter_audit.failure_counts(docs.limit(0), labels)).count() == 0
    counts = filter_audit.failure_counts(docs, labels).agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("toxic").alias("t")).first()
    assert tuple(counts) == (docs.count(), 0, 0)
