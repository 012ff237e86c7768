"""Python tasks pass on bounded parts, and each thing is opened and made once."""

import numpy as np
import pyarrow as pa

from framewright.parts import in_parts, lists
from framewright.plans.queries import QUERIES
from framewright.sources import mp4


def test_parts_are_neither_rows_nor_everything():
    def made(part):
        return pa.RecordBatch.from_arrays([pa.array([x for (x,) in part])], ["x"])

    small = list(in_parts(((8, (i,)) for i in range(2000)), made))
    assert [b.num_rows for b in small] == [512, 512, 512, 464]
    large = list(in_parts(((1 << 19, (i,)) for i in range(5)), made))
    assert [b.num_rows for b in large] == [2, 2, 1] and list(in_parts([], made)) == []
    assert [x for b in large for x in b.column(0).to_pylist()] == list(range(5))


def test_lists_keep_nulls_and_empty_ones():
    kind = pa.list_(pa.int64())
    assert lists([np.array([1, 2]), None, np.zeros(0, dtype=np.int64)], kind).to_pylist() == [[1, 2], None, []]
    assert lists([None], kind).to_pylist() == [None] and lists([], kind).to_pylist() == []


def test_frames_of_a_file_are_read_by_one_task(spark, tmp_path):
    """Not by one for each slot, which would open it as often."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    for i in range(8):
        (tmp_path / f"{i}.mp4").write_bytes(mp4.mp4_bytes([bytes([k]) * 9 for k in range(40)], [k % 7 == 0 for k in range(40)]))
    files = spark.createDataFrame([(str(p), p.stat().st_size) for p in tmp_path.glob("*.mp4")], "path string, length long")
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = mp4.read_packets(mp4.planned_packets(mp4.mp4_index(files), 40)).selectExpr("path", "slot", "packets", "spark_partition_id() AS task").collect()
    finally:
        spark.conf.set(key, before)
    assert len(rows) == 8 * 40 and all(r.packets[-1] == bytes([r.slot]) * 9 and len(r.packets) == r.slot % 7 + 1 for r in rows)
    assert len({(r.path, r.slot // 16): r.task for r in rows}) == len({(r.path, r.slot // 16, r.task) for r in rows}) == 8 * 3


def test_tracks_are_written_where_they_are_made(spark, sf):
    """No table of samples goes through the JVM: one pass writes, one reads headers, one reads blocks."""
    assert QUERIES["wave_samples"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
