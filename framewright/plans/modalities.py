"""From media rows to embedding rows, one plan for each modality.

Decoding and inference are one Arrow-batched pass over paths and index plans, so neither frames nor waveforms cross the
Python boundary. Rows that fail carry ``status`` and ``error``; ``strict=True`` raises instead. A transcript is encoded
only where it isn't empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.functions import frame_indices, l2_normalize, noise_profile_length, unicode_strip, zero_vector
from framewright.operators.audio import quantize, reblock, resample, spectral_gate
from framewright.operators.pooling import weighted_mean_pool
from framewright.sources.backends import Backend
from framewright.sources.wave import wave_blocks, wave_headers

#: Rows of vectors that leave a Python task at once; sample rates of one collection at most.
OUT_ROWS, MOST_RATES = 64, 64
EMBEDDING = "video_id string, modality string, dim int, vec array<float>, status string, error string"


@dataclass(frozen=True)
class AudioConfig:
    """Audio constants. ``min_chunk`` is the shortest chunk that yields a time step; shorter tails are skipped."""

    rate: int = 16000
    chunk_sec: float = 20.0
    overlap_sec: float = 0.0
    profile_sec: float = 0.5
    min_chunk: int = 400


@dataclass(frozen=True)
class VideoConfig:
    n_frames: int = 16


@dataclass(frozen=True)
class TextConfig:
    dim: int = 384


def _each(media: DataFrame, backend: Backend, work: Callable[[pd.Series], dict], schema: str, strict: bool) -> DataFrame:
    """``work`` on each row of ``media`` by a backend that each task opens once; columns that it leaves out are null."""
    columns = StructType.fromDDL(schema).names

    def one(row: pd.Series) -> dict:
        try:
            out = {"status": "ok", "error": None} | work(row)
        except Exception as e:
            if strict:
                raise
            out = {"status": "error", "error": f"{type(e).__name__}: {e}"}
        return dict.fromkeys(columns) | {"video_id": row.video_id} | out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for pdf in batches:
            rows = map(one, pdf.itertuples(index=False))
            while part := list(islice(rows, OUT_ROWS)):
                yield pd.DataFrame(part, columns=columns)

    return media.mapInPandas(run, schema)


def _embedding(df: DataFrame, modality: str, vec: Column) -> DataFrame:
    out = df.select("video_id", F.lit(modality).alias("modality"), vec.cast("array<float>").alias("vec"), "status", "error")
    return out.select("video_id", "modality", F.size("vec").alias("dim"), "vec", "status", "error").withColumn("dim", F.when(F.col("vec").isNotNull(), F.col("dim")))


def video_embeddings(media: DataFrame, backend: Backend, config: VideoConfig = VideoConfig(), strict: bool = False) -> DataFrame:
    """First-token embedding of ``n_frames`` evenly spread frames, L2-normalised.

    Frame counts come first, so the index plan is a JVM expression and only planned frames are read.
    """

    def count(row: pd.Series) -> dict:
        n = backend.frame_count(row.path)
        if n <= 0:
            raise RuntimeError("Cannot read frame count")
        return {"path": row.path, "n_total": n}

    def encode(row: pd.Series) -> dict:
        if row.status != "ok":
            return {"status": row.status, "error": row.error}
        read = (backend.read_frame(row.path, int(i)) for i in row.idx)
        frames = [x for x in read if x is not None]
        if not frames:
            raise RuntimeError("No frames decoded")
        frames = (frames + frames[-1:] * config.n_frames)[: config.n_frames]
        hidden = np.asarray(backend.encode_frames(frames), dtype=np.float64)
        if hidden.ndim != 2:
            raise ValueError(f"expected hidden states by token and dimension, got shape {hidden.shape}")
        return {"token": hidden[0].tolist()}

    counts = _each(media.select("video_id", "path"), backend, count, "video_id string, path string, n_total long, status string, error string", strict)
    plan = counts.withColumn("idx", frame_indices(F.coalesce("n_total", F.lit(0)), config.n_frames))
    hidden = _each(plan.select("video_id", "path", "idx", "status", "error"), backend, encode, "video_id string, token array<double>, status string, error string", strict)
    return _embedding(hidden, "video", l2_normalize(F.col("token")))


def _audio_pass(media: DataFrame, backend: Backend, config: AudioConfig, strict: bool) -> DataFrame:
    """One decode for all three audio modalities: transcript, window embeddings and per-chunk partial sums of each file."""
    chunk, overlap = int(config.chunk_sec * config.rate), int(config.overlap_sec * config.rate)
    hop = max(1, chunk - overlap)

    def run(row: pd.Series) -> dict:
        wave = np.asarray(backend.decode_audio(row.path), dtype=np.float32)
        n, out = len(wave), {"n_samples": len(wave), "speech": [], "short_tail": 0}
        if n:
            profile = wave[: max(1, min(int(config.profile_sec * config.rate), n))]
            out["text"] = backend.transcribe(np.asarray(backend.denoise(wave, profile), dtype=np.float32))
            windows = np.asarray(backend.encode_background(wave), dtype=np.float64)
            out["background"] = windows.mean(axis=0).tolist() if len(windows) else None
        start = 0
        while start < n:
            end = min(n, start + chunk)
            if end - start < config.min_chunk:
                out["short_tail"] += 1
            else:
                hidden = np.asarray(backend.encode_speech(wave[start:end]), dtype=np.float64)
                out["speech"].append({"sum_vec": hidden.sum(axis=0).tolist(), "n_frames": len(hidden)})
            if end == n:
                break
            start += hop
        return out

    schema = "video_id string, n_samples long, text string, background array<double>, speech array<struct<sum_vec:array<double>,n_frames:bigint>>, short_tail int, status string, error string"
    return _each(media.select("video_id", "path"), backend, run, schema, strict)


def load_audio(files: DataFrame, rate: int = 16000) -> DataFrame:
    """``path, start, total, samples`` of the readable WAVE files in ``files(path, length)``: mono, at this rate, as 16-bit integers hold them.

    Files are read by byte ranges, each of its rate by itself; the rates of a collection are few, and more than ``MOST_RATES`` raise.
    """
    headers = wave_headers(files)
    rates = [r["rate"] for r in headers.where("rate IS NOT NULL").select("rate").distinct().limit(MOST_RATES + 1).collect()]
    if len(rates) > MOST_RATES:
        raise ValueError(f"more than {MOST_RATES} sample rates")
    parts = [resample(wave_blocks(headers.where(F.col("rate") == r)), ["path"], r, rate) for r in sorted(rates)]
    whole = reduce(DataFrame.unionByName, parts) if parts else resample(wave_blocks(headers), ["path"], rate, rate)
    return quantize(whole)


def clean_audio(files: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """``load_audio`` without stationary noise, whose profile is the first ``profile_sec`` seconds of each file."""
    return spectral_gate(load_audio(files, config.rate), ["path"], config.rate, int(config.profile_sec * config.rate))


def speech_chunks(audio: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """``path, chunk_id, start, total, samples``: the chunks that a speech model takes, from ``load_audio`` rows. A tail shorter than ``min_chunk`` is left out."""
    chunk = int(config.chunk_sec * config.rate)
    hop = max(1, chunk - int(config.overlap_sec * config.rate))
    cut = reblock(audio, ["path"], hop, 0, chunk - hop)
    cut = cut.where((F.col("k") == 0) | ((F.col("k") - 1) * hop + chunk < F.col("total")))  # none begins once a chunk has reached the end
    return cut.where(F.size("samples") >= config.min_chunk).select("path", F.col("k").cast("int").alias("chunk_id"), F.col("first").alias("start"), "total", "samples")


def audio_embeddings(media: DataFrame, backend: Backend, audio: AudioConfig = AudioConfig(), text: TextConfig = TextConfig(), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(embeddings, transcripts)`` of the text, speech and background modalities from one decode of each file.

    The decoded pass is checkpointed, so the three branches share it; without a checkpoint folder this raises rather than decode each
    file again for each branch. A text that its encoder fails on gets a status of its own. Speech is the frame-weighted mean over chunks, L2-normalised; background is the plain mean and is not normalised; an empty transcript
    gets zeros without a call to the encoder.
    """
    context = media.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not (folder := context.getConf().get("spark.checkpoint.dir")):
            raise RuntimeError("set a checkpoint folder that all executors share: one decode serves three modalities")
        context.setCheckpointDir(folder)
    one = _audio_pass(media, backend, audio, strict).checkpoint()

    transcripts = one.select("video_id", unicode_strip(F.col("text")).alias("text"), "status", "error")

    def vectors(texts: list[str]) -> list[list[float]]:
        return [np.asarray(v, dtype=np.float64).tolist() for v in backend.encode_text(texts)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for pdf in batches:
            try:
                found = [(v, "ok", None) for v in vectors(pdf["text"].tolist())]
            except Exception:
                if strict:
                    raise
                found = []
                for t in pdf["text"]:  # one by one, to tell which fail
                    try:
                        found.append((vectors([t])[0], "ok", None))
                    except Exception as e:
                        found.append((None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"video_id": pdf["video_id"].tolist()} | dict(zip(("enc", "status", "error"), map(list, zip(*found, strict=True)), strict=True)) if found else {c: [] for c in ("video_id", "enc", "status", "error")})

    spoken = transcripts.where((F.col("text") != "") & (F.col("status") == "ok")).mapInPandas(encode, "video_id string, enc array<double>, status string, error string")
    blank = transcripts.where((F.col("text") == "") | (F.col("status") != "ok"))
    texts = _embedding(spoken, "text", l2_normalize(F.col("enc"))).unionByName(_embedding(blank, "text", F.when(F.col("status") == "ok", zero_vector(text.dim))))

    background = one.withColumn("status", F.when((F.col("status") == "ok") & F.col("background").isNull(), "no_windows").otherwise(F.col("status")))
    pooled = weighted_mean_pool(one.select("video_id", F.inline("speech")), ["video_id"])
    heard = one.select("video_id", "status", "error").join(pooled, "video_id", "left")
    heard = heard.withColumn("status", F.when((F.col("status") == "ok") & F.col("vec").isNull(), "no_frames").otherwise(F.col("status")))
    if strict:
        heard = heard.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.lit("the speech model returned no time steps")).cast("array<double>")).otherwise(F.col("vec")))
    out = texts.unionByName(_embedding(background, "background", F.col("background"))).unionByName(_embedding(heard, "speech", l2_normalize(F.col("vec"))))
    return out, transcripts.select("video_id", "text")


def embed_media(media: DataFrame, backend: Backend, strict: bool = False) -> DataFrame:
    """All four modalities of each file: ``video_id, modality, dim, vec, status, error``."""
    return audio_embeddings(media, backend, strict=strict)[0].unionByName(video_embeddings(media, backend, strict=strict))


def profile_lengths(counts: DataFrame, n: str) -> DataFrame:
    """``counts`` with the noise-profile length of each row."""
    return counts.withColumn("n_profile", noise_profile_length(F.col(n)))


def observed(embeddings: DataFrame, into: Observation) -> DataFrame:
    """``embeddings`` as they are; ``into`` gets the counts of rows by outcome and the vectors' extent as the rows pass by, without a pass
    of its own."""
    ok = F.col("status") == "ok"
    return embeddings.observe(into, F.count("*").alias("rows"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.min("dim").alias("least_dim"), F.max("dim").alias("most_dim"))
