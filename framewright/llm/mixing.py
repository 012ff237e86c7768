"""Mixing sources to target weights.

Each row gets a hash-random key. Within a source, keys are cut into equal ranges whose sizes are summed (one row for each
source and range); a running sum over those finds the range that holds the source's cut, and only that range is sorted to
find the cut's key. Rows then decide by themselves whether they are in, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.llm.common import fresh, small, stored, word_count

#: Hexadecimal digits of the key that name its range: 4096 ranges for each source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets of ``source, source_size`` rows: shares by repeating ``weights`` in code point order (null last), at most
    ``cap`` times a source's size, the excess shared again by weight among the others.

    Sorted by cap over weight, the capped sources come first, so running sums give the level in closed form. These sums run over one
    small row for each source, in one task.
    """
    order = F.coalesce(F.encode("source", "UTF-8"), F.lit(b"")).alias("_o")  # bytes of UTF-8 sort by code point
    ranked = sizes.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").isNull(), order)) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", "_i", weight.cast("bigint").alias("_w"), (F.col("source_size") * cap).alias("_cap"))
    by_fill = W.orderBy((F.col("_cap") / F.col("_w")), "_i")
    everything = W.partitionBy()
    filled = caps.select(
        "*",
        F.sum("source_size").over(everything).alias("_total"),
        F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
        F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing)).alias("_weights"),
    )
    level = (F.col("_total") - F.col("_below")).cast("double") / F.col("_weights")
    capped = level * F.col("_w") >= F.col("_cap")
    leveled = filled.select("*", level.alias("_level"), capped.alias("_capped"))
    first_free = F.min_by(F.when(~F.col("_capped"), F.col("_level")), F.when(~F.col("_capped"), F.col("_below"))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), first_free * F.col("_w")))
    return leveled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, size: str = "size", weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``taken``: how many of a row's words the mix takes, repeats counted.

    A source's budget is its target rounded down. It takes whole epochs of the source while they fit; the rest goes to the
    rows with the smallest random keys, and the row at the cut gives only what is missing, so each source takes exactly
    its budget. ``taken`` is at most ``cap`` times the size. Rows that share ``doc_id`` share a key; at the cut they give in
    proportion to their sizes, rounded down. Null sources are one source; a row of size 0 or null takes 0; an empty table
    gives an empty table. Columns of ``docs`` are kept; ``source_size``, ``target`` and ``taken`` are replaced.
    """
    docs = docs.drop("source_size", "target", "taken")
    key, of = fresh("_key", docs), fresh("_plan", docs)
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.concat(F.md5(F.concat(F.lit(seed), F.lit(":"), id_text)), F.lit(":"), id_text))
    slim = stored(keyed.select("source", F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"), F.col(key).alias("_key")))
    ranges = stored(slim.groupBy("source", F.left("_key", F.lit(RANGE_DIGITS)).alias("_range")).agg(F.sum("_size").alias("_sum")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, cap)
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("bigint")).otherwise(0)
    left = budget - F.col("_epochs") * F.col("source_size")
    targets = stored(targets.withColumn("_epochs", epochs).withColumn("_left", left))

    before = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranged = ranges.withColumn("_before", before).join(targets.select(F.col("source").alias("_s"), "_left"), F.col("source").eqNullSafe(F.col("_s")))
    cuts = stored(ranged.where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_sum"))).select("_s", "_range", "_before", "_left"))
    in_cut = slim.where(F.col("_size") > 0).join(small(cuts), F.col("source").eqNullSafe(F.col("_s")) & (F.left("_key", F.lit(RANGE_DIGITS)) == F.col("_range")))
    tied = in_cut.groupBy("_s", "_key", "_before", "_left").agg(F.sum("_size").alias("_tied"))
    running = F.col("_before") + F.sum("_tied").over(W.partitionBy("_s").orderBy("_key").rowsBetween(W.unboundedPreceding, 0)) - F.col("_tied")
    at = tied.withColumn("_at", running).where((F.col("_at") <= F.col("_left")) & (F.col("_left") < F.col("_at") + F.col("_tied")))
    at = at.select("_s", F.col("_key").alias("_cut"), (F.col("_left") - F.col("_at")).alias("_rest"), "_tied")
    plan = stored(targets.withColumnRenamed("source", "_t").join(at, F.col("_t").eqNullSafe(F.col("_s")), "left").drop("_s"))

    planned = keyed.join(small(plan.select(F.struct("*").alias(of))), F.col("source").eqNullSafe(F.col(f"{of}._t")))
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    at_cut = F.floor(F.col(f"{of}._rest") * n / F.col(f"{of}._tied")).cast("bigint")
    extra = F.when(F.col(key) < F.col(f"{of}._cut"), n).when(F.col(key) == F.col(f"{of}._cut"), at_cut).otherwise(0)
    return planned.select(*docs.columns, f"{of}.source_size", f"{of}.target", (n * F.col(f"{of}._epochs") + extra).alias("taken"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix over all of ``documents`` by words: ``doc_id, size, source_size, target, taken``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1 AS i FROM s),
c AS (SELECT *, i % 3 + 1 AS w, source_size * 3 AS cap FROM r),
f AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c),
l AS (SELECT *, CAST(total - below AS DOUBLE) / CAST(ws AS DOUBLE) AS level FROM f),
z AS (SELECT *, min(CASE WHEN level * w < cap THEN below END) OVER () AS free FROM l),
y AS (SELECT *, (SELECT min(level) FROM z WHERE below = free AND level * w < cap) AS final FROM z),
t AS (SELECT source, source_size, CASE WHEN level * w >= cap THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), final * w) END AS target FROM y),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS lft,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * epochs + least(size, greatest(0, lft - before)) AS BIGINT) AS taken FROM p
"""
