"""Audit of a chain of document filters in every order at once.

Each document's failures are one bit mask. For each part of the corpus, three histograms over the 32 masks - all documents, those
of good quality, toxic ones - are stacked as the rows of an incidence matrix. What any order of the filters keeps, removes, finds
removed already or removes alone is linear in such a row, so one product with integer matrices of 32 by 600 (120 orders of five
steps) gives every outcome. Only the masks need a pass over the texts; their histograms are partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.common import WORD

#: The filters by letter; the bit of a mask is the letter's place.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def outcome_matrices() -> dict[str, np.ndarray]:
    """``kept, removed, redundant, unique, shapley``: integers by mask and by column, which is five times the order's place plus the step."""
    mask = np.arange(MASKS)[:, None]
    letters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    own = 1 << letters  # by order and step
    before = np.cumsum(own, axis=1) - own
    own, before = own.reshape(-1), before.reshape(-1)
    fails, gone = (mask & own) > 0, (mask & before) > 0
    removed = (fails & ~gone).astype(np.int64)
    same = (own[:, None] == own[None, :]).astype(np.int64)
    return {
        "kept": ((mask & (before | own)) == 0).astype(np.int64),
        "removed": removed,
        "redundant": (fails & gone).astype(np.int64),
        "unique": np.broadcast_to(mask == own, fails.shape).astype(np.int64),
        "shapley": removed @ same,
    }


def text_failures(text: Column, words: Column) -> Column:
    """The mask of the four filters that judge a text by itself; ``words`` are those of ``text``."""
    n, capitals = F.size(words), F.regexp_count(text, F.lit("[A-Z]"))
    failed = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)).cast("bigint") < DISTINCT_PERCENT * n.cast("bigint"), 100 * capitals.cast("bigint") > CAPITALS_PERCENT * F.length(text).cast("bigint"), F.regexp_like(text, F.lit(SYMBOLS))]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part (null: empty string) and failures, and how many of them ``labels`` calls good and toxic.

    A text repeats if an equal one (by SHA-256) has a smaller ``doc_id``. Rows of one id aren't smaller than each other; a row without id is
    neither smaller than another nor a repeat, and has no label. A null text is an empty one. A document is good or toxic if any of its labels
    says 1. Copies are counted by id and text before they meet, so a group of any size is a few rows. Other columns are left out,
    whatever their names; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    slim = slim.select("doc_id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    slim = slim.select("doc_id", "part", F.sha2("text", 256).alias("digest"), text_failures(F.col("text"), F.col("words")).alias("mask"))
    slim = slim.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))])
    rows = slim.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])

    none = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), none.alias("none"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("first"))
    groups = groups.withColumn("least", F.min("low").over(W.partitionBy("digest")))  # a text has one row for each part and label at most
    passed = F.col("none") + F.when(F.col("low") == F.col("least"), F.col("first")).otherwise(0)
    repeat = F.col("mask") + (1 << FILTERS.index("E"))
    both = groups.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", passed.alias("n")), F.struct(repeat.alias("mask"), (F.col("n") - passed).alias("n")))))
    return both.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def order_outcomes(counts: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the seven counts of each part in ``counts(part, mask, n, good, toxic)``: 600 rows a part."""
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # 32 at most
    matrices = outcome_matrices()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = len(FILTERS)
        order = pa.array(np.repeat(np.array(ORDERS, dtype=object), steps))
        step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            stacked = np.zeros((3, batch.num_rows, MASKS), dtype=np.int64)
            lists = batch.column(1)
            at, values = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
            for k, name in enumerate(("n", "good", "toxic")):
                stacked[k, at, values.field("mask").to_numpy()] = values.field(name).to_numpy()
            every, good, toxic = stacked
            out = {
                "kept": every @ matrices["kept"],
                "removed": every @ matrices["removed"],
                "redundant": every @ matrices["redundant"],
                "unique_fails": every @ matrices["unique"],
                "good_lost": good @ matrices["removed"],
                "toxic_lost": toxic @ matrices["removed"],
                "shapley": every @ matrices["shapley"],
            }
            for i in range(batch.num_rows):
                part = batch.column(0).take(pa.array(np.full(len(order), i)))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(out[c][i]) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all of ``documents`` in their 120 orders, by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return order_outcomes(failure_counts(docs, labels))


OP13_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS MATERIALIZED (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(string_split('ABCDE', '')) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step:step] AS own, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) t(step) WHERE length(filter_order) = 5),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS bad, translate(fails, earlier, '') <> fails AS gone, fails = own AS alone FROM h, s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
             coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
