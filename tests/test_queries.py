"""Every registered query of the reference's operators against DuckDB."""

import pytest
from oracle import compare

from framewright.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, name):
    assert compare(spark, QUERIES[name], ORACLES[name], sf) > 0


def test_zero_fallback_strips_a_text_once(spark, tmp_path):
    """Not for each of the 384 values, of which a copy of the stripping in a lambda is a sign."""
    rows = [(1, "heard"), (2, " \t\u3000"), (3, None), (4, ""), (5, "unlabelled"), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["zero_fallback"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    norm = sum((5 + i) ** 2 for i in range(1, 385)) ** 0.5
    values = {(r.doc_id, r.dim): r.value for r in got.collect()}
    assert len(values) == 6 * 384
    assert all(abs(v - ((6 + dim) / norm if doc == 1 else 0)) < 1e-5 for (doc, dim), v in values.items())


def test_log_mel_matches_a_plain_version(spark, sf):
    """Every document, frame by frame."""
    import numpy as np

    edges = np.linspace(1127 * np.log(1 + 125 / 700), 1127 * np.log(1 + 7500 / 700), 66)
    mel = 1127 * np.log(1 + np.arange(257) * 16000 / 512 / 700)[:, None]
    weights = np.maximum(0, np.minimum((mel - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - mel) / (edges[2:] - edges[1:-1])))
    weights[0] = 0
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        x = (np.array([ord(c) for c in r.text]) % 128 - 64) / 64
        n = 1 + max(0, -(-(len(x) - 15600) // 7680))
        x = np.concatenate([x, np.zeros(7680 * n + 15600)])
        for p in range(n):
            m = np.array([np.log(np.abs(np.fft.rfft(x[p * 7680 + f * 160 :][:400] * window, n=512)) @ weights + 0.001) for f in range(96)])
            want[r.doc_id, p] = (m.min(), m.max(), m.mean())
    got = {(r.doc_id, r.patch): r for r in QUERIES["log_mel"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.n == 96 * 64 and np.allclose((r.least, r.most, r["mean"]), want[k], atol=1e-4)
