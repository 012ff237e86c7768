"""Registered queries of the audio operators, with their DuckDB SQL. Texts stand in for tracks: each character is a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.audio import BETA, ZEROS, mel_patches, resample, spectral_gate
from framewright.session import read_table, shared_folder
from framewright.sources.npy import register_npy
from framewright.sources.wave import wave_blocks, wave_headers, write_waves

#: Samples of a block, so few that most tracks have several; rates of the resampling query; settings of the gate.
BLOCK, RATE_IN, RATE_OUT = 300, 12000, 16000
GATE = {"rate": 1000, "profile": 64, "n_fft": 16, "hop": 4, "deviations": 0.5, "reduction": 0.9, "smooth_hz": 130.0, "smooth_ms": 9.0}


def _tracks(texts: DataFrame, keys: list[str], of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keys, start, total, samples`` of each row's ``text`` as one block: ``of`` makes samples of its code points. Null texts are empty."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = [of(_codes(t)).astype(np.float32) for t in part.column(len(keys)).to_pylist()]
                n = np.array([len(v) for v in x], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                samples = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(np.zeros_like(n)), pa.array(n), samples], [*keys, "start", "total", "samples"])

    return texts.select(*keys, "text").mapInArrow(run, f"{types}, start long, total long, samples array<float>")


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _wide(codes: np.ndarray) -> np.ndarray:
    return (codes * 257 % 65536 - 32768) / 32768


def _narrow(codes: np.ndarray) -> np.ndarray:
    return (codes % 128 - 64) / 64


def _total(values: Column, start: Column) -> Column:
    zero = F.lit(start).cast("bigint") if isinstance(start, int) else start
    return F.aggregate(values, zero, lambda a, x: a + x)


def wave_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a 16-bit file, written by tasks, whose headers and byte ranges are read again; sums of each block of 4096 samples."""
    files = write_waves(read_table(spark, d, "documents"), shared_folder(spark), "doc_id", "text", 8000, lambda x: _wide(_codes(x.as_py())))
    blocks = wave_blocks(wave_headers(files), 4096)
    whole = F.transform("samples", lambda x: (x.cast("double") * 32768).cast("bigint"))
    placed = F.transform("samples", lambda x, i: (x.cast("double") * 32768).cast("bigint") * (i % 1000))
    doc = F.regexp_extract("path", r"([^/]+)\.wav$", 1).cast("bigint").alias("doc_id")
    return blocks.select(doc, "block", "start", F.size("samples").cast("bigint").alias("n"), "rate", _total(whole, 0).alias("sum_x"), _total(placed, 0).alias("sum_ix"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(read_table(spark, d, "conversations"), ["conv_id", "turn"], _narrow)


def _moments(blocks: DataFrame) -> DataFrame:
    """By track the number of samples, and means of the samples, their squares and their products with 0, 1, 2, 3, 4, 5, 6, 0, ... less 3."""
    x = F.transform("samples", lambda v: v.cast("double"))
    placed = F.transform("samples", lambda v, i: v.cast("double") * ((F.col("start") + i) % 7 - 3))
    sums = blocks.select("conv_id", "turn", F.size("samples").cast("bigint").alias("n"), _total(x, F.lit(0.0)).alias("a"), _total(F.transform(x, lambda v: v * v), F.lit(0.0)).alias("b"), _total(placed, F.lit(0.0)).alias("c"))
    totals = sums.groupBy("conv_id", "turn").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in "abc"])
    return totals.select("conv_id", "turn", "n", *[(F.round(F.col(c) / F.col("n"), 5) + F.lit(0.0)).alias(f"mean_{c}") for c in "abc"])


def resample_16k(spark: SparkSession, d: str) -> DataFrame:
    """Every turn from 12 to 16 kHz."""
    return _moments(resample(_turns(spark, d), ["conv_id", "turn"], RATE_IN, RATE_OUT, BLOCK))


def spectral_gate_query(spark: SparkSession, d: str) -> DataFrame:
    """Every turn without what its first 64 samples hold."""
    return _moments(spectral_gate(_turns(spark, d), ["conv_id", "turn"], block=BLOCK, **GATE))


def log_mel(spark: SparkSession, d: str) -> DataFrame:
    """Every document as patches: how many values, their extent and mean."""
    blocks = _tracks(read_table(spark, d, "documents"), ["doc_id"], _narrow)
    mean = _total(F.transform("mel", lambda v: v.cast("double")), F.lit(0.0)) / F.size("mel")
    return mel_patches(blocks, ["doc_id"]).select("doc_id", "patch", F.size("mel").alias("n"), F.array_min("mel").alias("least"), F.array_max("mel").alias("most"), mean.alias("mean"))


def npy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as a ``.npy`` file, committed and read back."""
    folder = shared_folder(register_npy(spark))
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vec"))
    vectors.write.format("npy").mode("append").save(folder)
    back = spark.read.format("npy").load(folder)
    return back.select(F.col("name").cast("bigint").alias("vec_id"), F.posexplode("values").alias("dim", "value"))


QUERIES = {"npy_round_trip": npy_round_trip, "wave_samples": wave_samples, "resample_16k": resample_16k, "spectral_gate": spectral_gate_query, "log_mel": log_mel}

_TURNS = """
  s AS MATERIALIZED (SELECT conv_id, turn, i - 1 AS i, (unicode(c) % 128 - 64) / 64.0::DOUBLE AS x
    FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s).')) AS c, unnest(range(1, length(text) + 1)) AS i FROM conversations)),
  n AS MATERIALIZED (SELECT conv_id, turn, count(*) AS n FROM s GROUP BY ALL)"""
_MOMENTS = """
  SELECT conv_id, turn, count(*) AS n, round(avg(y), 5) + 0.0::DOUBLE AS mean_a, round(avg(y * y), 5) + 0.0::DOUBLE AS mean_b, round(avg(y * (i % 7 - 3)), 5) + 0.0::DOUBLE AS mean_c
  FROM (SELECT conv_id, turn, i, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y FROM y) GROUP BY ALL"""
_DB = "20 * log10(sqrt(re * re + im * im) + 1e-10)"


def _spectra(frames: str, samples: str) -> str:
    """Transforms of frames ``(conv_id, turn, f)`` of 16 windowed samples each, by bin."""
    angle = "2 * pi() * b * (i - ((f + 1) * 4 - 16)) / 16"
    return f"""SELECT conv_id, turn, f, b, sum(x * h * cos({angle})) AS re, -sum(x * h * sin({angle})) AS im
      FROM (SELECT p.conv_id, p.turn, p.f, v.i, v.x, 0.5 - 0.5 * cos(2 * pi() * (v.i - ((p.f + 1) * 4 - 16)) / 16) AS h
            FROM {frames} p JOIN {samples} v ON p.conv_id = v.conv_id AND p.turn = v.turn AND v.i >= (p.f + 1) * 4 - 16 AND v.i < (p.f + 1) * 4) CROSS JOIN range(9) t(b) GROUP BY ALL"""


ORACLES = {
    "npy_round_trip": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "wave_samples": """
      SELECT doc_id, CAST(i // 4096 AS INTEGER) AS block, i // 4096 * 4096 AS start, count(*) AS n, CAST(8000 AS INTEGER) AS rate, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(x * (i % 4096 % 1000)) AS BIGINT) AS sum_ix
      FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) * 257 % 65536 - 32768)) AS x, unnest(range(0, length(text))) AS i FROM documents) GROUP BY ALL""",
    "resample_16k": f"""
      WITH {_TURNS},
      d AS (SELECT p, t, t - {ZEROS - 1} - p / 4.0::DOUBLE AS d FROM range(4) a(p), range({2 * ZEROS}) b(t)),
      w AS (SELECT p, t, CASE WHEN abs(d) > {ZEROS} THEN 0 ELSE CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) END
                   * list_sum(list_transform(range(0, 60), lambda k: pow(pow({BETA} * sqrt(1 - pow(d / {ZEROS}, 2)) / 2, k) / gamma(k + 1), 2))) END AS w FROM d),
      h AS MATERIALIZED (SELECT p, t, w / sum(w) OVER (PARTITION BY p) AS w FROM w),
      o AS (SELECT conv_id, turn, unnest(range(0, CAST(ceil(n * 4 / 3.0) AS BIGINT))) AS j FROM n),
      r AS MATERIALIZED (SELECT o.conv_id, o.turn, o.j, h.w, o.j * 3 // 4 + h.t - {ZEROS - 1} AS i FROM o JOIN h ON h.p = o.j * 3 % 4),
      y AS (SELECT r.conv_id, r.turn, r.j AS i, sum(s.x * r.w) AS y FROM r JOIN s USING (conv_id, turn, i) GROUP BY ALL)
      {_MOMENTS}""",
    "spectral_gate": f"""
      WITH {_TURNS},
      c AS (SELECT * FROM s WHERE i < 64),
      pf AS (SELECT conv_id, turn, unnest(range(0, (least(n, 64) + 15) // 4)) AS f FROM n),
      qf AS (SELECT conv_id, turn, unnest(range(0, (n + 15) // 4)) AS f FROM n),
      q AS ({_spectra("pf", "c")}),
      l AS (SELECT conv_id, turn, b, avg({_DB}) + 0.5 * stddev_pop({_DB}) AS l FROM q GROUP BY ALL),
      z AS MATERIALIZED ({_spectra("qf", "s")}),
      m AS MATERIALIZED (SELECT z.conv_id, z.turn, f, b FROM z JOIN l USING (conv_id, turn, b) WHERE {_DB} > l),
      g AS (SELECT conv_id, turn, f + df AS f, b + db AS b, sum((3 - abs(df)) / 9.0::DOUBLE * (3 - abs(db)) / 9.0::DOUBLE) AS g FROM m, range(-2, 3) t1(df), range(-2, 3) t2(db) GROUP BY ALL),
      k AS (SELECT z.conv_id, z.turn, z.f, z.b, re * (1 - 0.9 * (1 - coalesce(g, 0))) AS re, im * (1 - 0.9 * (1 - coalesce(g, 0))) AS im FROM z LEFT JOIN g USING (conv_id, turn, f, b)),
      r AS (SELECT conv_id, turn, (f + 1) * 4 - 16 + j AS i,
                   sum(CASE WHEN b IN (0, 8) THEN re * cos(2 * pi() * b * j / 16) ELSE 2 * (re * cos(2 * pi() * b * j / 16) - im * sin(2 * pi() * b * j / 16)) END / 16 * (0.5 - 0.5 * cos(2 * pi() * j / 16))) AS y
            FROM k, range(16) t(j) GROUP BY ALL),
      y AS (SELECT r.conv_id, r.turn, r.i, r.y / 1.5 AS y FROM r JOIN n USING (conv_id, turn) WHERE r.i >= 0 AND r.i < n.n)
      {_MOMENTS}""",
}
