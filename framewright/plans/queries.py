"""The registered queries over the test tables, each with the DuckDB SQL that must give the same rows.

The tables stand in for sequences: ``embeddings`` by label for hidden states, ``events`` by user and ``lineitem`` by order
for frames, ``documents`` for transcripts and sample counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import l2_normalize, noise_profile_length, preview, seconds_label, unicode_strip, zero_vector
from framewright.operators import chunk_plan, first_token, frame_plan, keep_decoded, mean_pool, sample_frames, weighted_mean_pool
from framewright.operators.pooling import chunk_sums
from framewright.plans import audio, video
from framewright.session import read_table


def _long(df: DataFrame, key: str, vec: Column, places: int = 6) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("dim", "x")).select(key, "dim", (F.round(F.col("x").cast("double"), places) + F.lit(0.0)).alias("value"))  # no negative zero


def mean_pool_query(spark: SparkSession, d: str) -> DataFrame:
    hidden = read_table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    return _long(mean_pool(hidden, ["label"]), "label", F.col("vec"))


def weighted_mean_pool_l2(spark: SparkSession, d: str) -> DataFrame:
    hidden = read_table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("chunk"), F.col("embedding").alias("vec"))
    pooled = weighted_mean_pool(chunk_sums(hidden, ["label"], "chunk"), ["label"])
    return _long(pooled, "label", l2_normalize(F.col("vec")))


def l2_normalize_query(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    scaled = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)).alias("v"))
    return _long(scaled, "vec_id", l2_normalize(F.col("v")), 5)


def first_token_l2(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3.0))
    return _long(first_token(e, ["label"], "vec_id", "v"), "label", l2_normalize(F.col("vec")), 5)


def _event_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))


def frame_sample_16(spark: SparkSession, d: str) -> DataFrame:
    return frame_plan(_event_counts(spark, d), "user_id", "n", 16)


def frame_sample_16_pad(spark: SparkSession, d: str) -> DataFrame:
    counts = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return frame_plan(counts, "l_orderkey", "n", 16)


def frame_sample_odd(spark: SparkSession, d: str) -> DataFrame:
    return frame_plan(_event_counts(spark, d), "user_id", "n", 9)


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return sample_frames(read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], 16)


def frame_gather_query(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).select("user_id", "slot", "frame_idx", "event_id")


def decode_filter_pad_last(spark: SparkSession, d: str) -> DataFrame:
    gathered = _sampled(spark, d).withColumn("ok", F.col("event_type") != "error")
    return keep_decoded(gathered, "user_id", "event_id", "ok", 16).select("user_id", F.posexplode("frames").alias("slot", "event_id"))


def _chunks(spark: SparkSession, d: str, overlap: int) -> DataFrame:
    return chunk_plan(read_table(spark, d, "documents"), "doc_id", "n_chars", 500, overlap)


def noise_profile_len(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", noise_profile_length(F.col("n_chars")).alias("n_profile"))


def transcript_preview(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


def transcript_strip(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("\t"), F.col("text"), F.lit(" "))
    return read_table(spark, d, "documents").select("doc_id", unicode_strip(padded).alias("text"))


def zero_fallback(spark: SparkSession, d: str) -> DataFrame:
    """All 384 values of every document; only labelled ones have a transcript, the others get zeros."""
    labels = read_table(spark, d, "labels").select("doc_id").distinct().withColumn("heard", F.lit(True))
    lengths = read_table(spark, d, "documents").select("doc_id", F.length(unicode_strip(F.col("text"))).alias("n"))  # once a text, which isn't shuffled
    docs = lengths.join(labels, "doc_id", "left").select("doc_id", F.when(F.col("heard"), F.col("n")).otherwise(0).alias("n"))
    encoded = F.transform(F.sequence(F.lit(1), F.lit(384)), lambda i: (F.col("n") + i).cast("double"))
    return _long(docs.select("doc_id", F.when(F.col("n") == 0, zero_vector(384)).otherwise(l2_normalize(encoded)).alias("v")), "doc_id", F.col("v"), 5)


def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frames that each pool saw: by user over events, whatever their number."""
    frames = read_table(spark, d, "events").select("user_id", F.array(F.col("value")).alias("vec"))
    return mean_pool(frames, ["user_id"]).select("user_id", F.col("n_frames").cast("bigint").alias("n_frames"))


def zero_frame_guard(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tracks whose returned lines are time steps: one without any has no vector and says so."""
    back = (F.col("l_returnflag") == "R").cast("bigint")
    states = read_table(spark, d, "lineitem").select("l_orderkey", F.array(F.col("l_quantity") * back).alias("sum_vec"), back.alias("n_frames"))
    pooled = weighted_mean_pool(states, ["l_orderkey"])
    status = F.when(F.col("n_frames") > 0, "ok").otherwise("no_frames")
    return pooled.select("l_orderkey", "n_frames", F.round(F.col("vec")[0], 6).alias("value"), status.alias("status"))


def seconds_label_query(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", seconds_label(F.col("n_chars")).alias("seconds"))


QUERIES = {
    "mean_pool": mean_pool_query,
    "weighted_mean_pool_l2": weighted_mean_pool_l2,
    "l2_normalize": l2_normalize_query,
    "first_token_l2": first_token_l2,
    "frame_sample_16": frame_sample_16,
    "frame_sample_16_pad": frame_sample_16_pad,
    "frame_sample_odd": frame_sample_odd,
    "frame_gather": frame_gather_query,
    "decode_filter_pad_last": decode_filter_pad_last,
    "chunk_plan": lambda spark, d: _chunks(spark, d, 0),
    "chunk_plan_overlap": lambda spark, d: _chunks(spark, d, 100),
    "noise_profile_len": noise_profile_len,
    "transcript_preview": transcript_preview,
    "transcript_strip": transcript_strip,
    "zero_fallback": zero_fallback,
    "frame_counts": frame_counts,
    "zero_frame_guard": zero_frame_guard,
    "seconds_label": seconds_label_query,
    **audio.QUERIES,
    **video.QUERIES,
}


def _frames_sql(key: str, table: str, w: int) -> str:
    spread = f"CASE WHEN i = {w - 1} THEN n - 1 ELSE CAST(round_even(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / {w - 1}.0::DOUBLE), 0) AS BIGINT) END"
    return f"""
      SELECT {key}, CAST(i AS INTEGER) AS slot, CAST(CASE WHEN n <= {w} THEN least(i, n - 1) ELSE {spread} END AS BIGINT) AS frame_idx
      FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY 1) CROSS JOIN range({w}) t(i)"""


_LONG = "SELECT {key}, CAST(i - 1 AS INTEGER) AS dim, round(CAST(v[i] AS DOUBLE), {places}) + 0.0::DOUBLE AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM u)"
_UNIT = "list_transform(v, lambda x: CAST(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12) AS FLOAT))"
_POOL = "SELECT label, i AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL"
_EVENT_FRAMES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id, event_type FROM events"
_GATHER = f"SELECT p.user_id, p.slot, p.frame_idx, f.event_id, f.event_type FROM ({_frames_sql('user_id', 'events', 16)}) p JOIN ({_EVENT_FRAMES}) f USING (user_id, frame_idx)"


def _chunks_sql(overlap: int) -> str:
    hop = 500 - overlap
    last = f"CASE WHEN n_chars <= 500 THEN 0 ELSE CAST(ceil((n_chars - 500) / {hop}.0) AS BIGINT) END"
    return f"""
      SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, i * {hop} AS "start", least(n_chars, i * {hop} + 500) AS "end"
      FROM (SELECT doc_id, n_chars, unnest(range(0, {last} + 1)) AS i FROM documents WHERE n_chars > 0)"""


ORACLES = {
    "mean_pool": f"SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(m, 6) AS value FROM ({_POOL})",
    "weighted_mean_pool_l2": f"""
      WITH p AS ({_POOL}), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM p GROUP BY 1)
      SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(CAST(CAST(m / greatest(norm, 1e-12) AS FLOAT) AS DOUBLE), 6) AS value FROM p JOIN n USING (label)""",
    "l2_normalize": f"""
      WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 5)) AS v FROM embeddings),
      u AS (SELECT vec_id, {_UNIT} AS v FROM s) {_LONG.format(key="vec_id", places=5)}""",
    "first_token_l2": f"""
      WITH s AS (SELECT label, arg_min(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3.0::DOUBLE), vec_id) AS v FROM embeddings GROUP BY 1),
      u AS (SELECT label, {_UNIT} AS v FROM s) {_LONG.format(key="label", places=5)}""",
    "frame_sample_16": _frames_sql("user_id", "events", 16),
    "frame_sample_16_pad": _frames_sql("l_orderkey", "lineitem", 16),
    "frame_sample_odd": _frames_sql("user_id", "events", 9),
    "frame_gather": f"SELECT user_id, slot, frame_idx, event_id FROM ({_GATHER})",
    "decode_filter_pad_last": f"""
      WITH g AS (SELECT user_id, list(event_id ORDER BY slot) AS v FROM ({_GATHER}) WHERE event_type <> 'error' GROUP BY 1)
      SELECT user_id, CAST(i AS INTEGER) AS slot, v[least(i + 1, len(v))] AS event_id FROM g CROSS JOIN range(16) t(i)""",
    "chunk_plan": _chunks_sql(0),
    "chunk_plan_overlap": _chunks_sql(100),
    "noise_profile_len": "SELECT doc_id, greatest(CAST(1 AS BIGINT), least(CAST(8000 AS BIGINT), n_chars)) AS n_profile FROM documents",
    "transcript_preview": "SELECT doc_id, left(text, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS preview FROM documents",
    "transcript_strip": "SELECT doc_id, trim(chr(9) || text || chr(160), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) AS text FROM documents",
    "zero_fallback": f"""
      WITH t AS (SELECT doc_id, length(text) AS n, doc_id IN (SELECT doc_id FROM labels) AND text <> '' AS heard FROM documents),
      s AS (SELECT doc_id, list_transform(range(1, 385), lambda i: CAST(n + i AS DOUBLE)) AS v FROM t WHERE heard),
      u AS (SELECT doc_id, {_UNIT} AS v FROM s UNION ALL SELECT doc_id, list_transform(range(1, 385), lambda i: 0::FLOAT) FROM t WHERE heard IS NOT TRUE)
      {_LONG.format(key="doc_id", places=5)}""",
    "frame_counts": "SELECT user_id, count(value) AS n_frames FROM events GROUP BY 1",
    "zero_frame_guard": """
      SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_frames, round(sum(l_quantity) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R'), 6) AS value,
             CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'ok' ELSE 'no_frames' END AS status
      FROM lineitem GROUP BY 1""",
    "seconds_label": "SELECT doc_id, printf('%.2f', n_chars / 16000.0::DOUBLE) AS seconds FROM documents",
    **audio.ORACLES,
    **video.ORACLES,
}
