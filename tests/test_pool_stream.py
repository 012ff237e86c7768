"""Chunk sums as a stream, shuffled and repeated, against the batch operator."""

import random
import time

import pytest

from framewright.operators.pooling import weighted_mean_pool
from framewright.streaming.pooling import pool_stream

SCHEMA = "video_id string, chunk_id int, n_chunks int, sum_vec array<double>, n_frames long"


def chunks():
    rng = random.Random(8)
    rows = []
    for v in range(25):
        n = rng.randrange(1, 20)
        rows += [(f"v{v}", c, n, [float(rng.randrange(-50, 50)) for _ in range(6)], 0 if v == 3 else rng.randrange(1, 9)) for c in range(n)]
    return rows


def run(spark, tmp_path, batches, **kw):
    source = tmp_path / "in"
    source.mkdir()
    stream = pool_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), **kw)
    got = []
    for rows in batches:  # with this kind of timeout a query looks for timeouts for ever, so each start is stopped once its rows are through
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
        until = time.monotonic() + 60
        while sum(p.numInputRows for p in query.recentProgress) < len(rows) and time.monotonic() < until and query.isActive:
            time.sleep(0.2)
        assert query.exception() is None
        query.stop()
    return got


def test_equal_to_batch_whatever_the_order(spark, tmp_path):
    rows = chunks()
    sent = rows + random.Random(1).sample(rows, 60) + [("v1", -1, 3, [1.0], 1), ("v1", 99, 3, [1.0], 1), ("v2", 0, 5, None, 1), (None, 0, 1, [1.0], 1)]
    random.Random(2).shuffle(sent)
    late = [r for r in sent if r[0] == "v7"][:1]  # its last chunk comes alone, in a third start of the query
    first = [r for r in sent if r[:2] != late[0][:2]]
    got = run(spark, tmp_path, [first[:100], first[100:], late])
    want = {r.video_id: r for r in weighted_mean_pool(spark.createDataFrame(rows, SCHEMA), ["video_id"]).collect()}
    done = {}
    for r in got:
        assert r.video_id not in done or r.video_id not in want
        done.setdefault(r.video_id, r)
    assert done.keys() == want.keys()
    for k, r in done.items():
        assert r.n_frames == want[k].n_frames and r.status == ("no_frames" if k == "v3" else "ok")
        assert r.vec is None if k == "v3" else r.vec == pytest.approx(want[k].vec, abs=1e-12)


def test_files_that_stay_incomplete_go_out(spark, tmp_path):
    got = run(spark, tmp_path, [[("a", 0, 2, [2.0, 4.0], 2)], [("b", 0, 1, [3.0], 1)], [("c", 0, 1, [3.0], 1)]], patience_ms=1)
    rows = {r.video_id: r for r in got}
    assert rows["a"].status == "incomplete" and rows["a"].vec == [1.0, 2.0] and rows["a"].n_chunks == 1 and rows["b"].status == "ok"
