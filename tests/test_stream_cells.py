"""A replayed stream of candidates settles every cell as the batch does, and tells late rows apart."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import matching
from tessera.streaming import cells

SCHEMA = "image_id string, class string, det_idx long, score double, gt_idx long, iou double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, PROVIDER)
    yield spark
    spark.conf.unset(key)


def test_replayed_stream_is_the_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    rows = []
    for image in range(6):
        for k in "ab":
            pairs = {(d, g) for d in range(rng.randrange(0, 7)) for g in range(5) if rng.random() < 0.6}
            score = {d: rng.choice([0.3, 0.5, 0.9]) for d in range(7)}
            rows += [(f"i{image}", k, d, score[d], g, rng.choice([0.5, 0.6, 0.8])) for d, g in sorted(pairs)]
    table = spark.createDataFrame(rows, SCHEMA)
    sent = [tuple(r) for r in cells.with_ends(table).collect()]
    rng.shuffle(sent)
    sent += [("i0", "a", False, 0, 99, 0.99, 0, 0.9), ("i1", "b", False, 0, 98, 0.99, 0, 0.9)]
    kinds = "image_id string, class string, last boolean, n long, det_idx long, score double, gt_idx long, iou double"
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(src))
    for at in range(0, len(sent), len(sent) // 3 + 1):  # three batches, the late rows in the last
        spark.createDataFrame(sent[at : at + len(sent) // 3 + 1], kinds).coalesce(1).write.mode("append").parquet(str(src))
        run = cells.greedy_cells(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    match, late = cells.split_output(spark.read.parquet(str(out)))
    want = {tuple(r) for r in matching.greedy(table).select("image_id", "class", "det_idx", "gt_idx", "iou").collect()}
    got = [tuple(r) for r in match.select("image_id", "class", "det_idx", "gt_idx", "iou").collect()]
    closed_early = {tuple(r)[:2] for r in late.collect()}
    assert len(got) == len(set(got))
    fresh = {x for x in want if x[:2] not in {("i0", "a"), ("i1", "b")}}
    assert {x for x in got if x[:2] not in {("i0", "a"), ("i1", "b")}} == fresh
    # a straggler is late if its cell was settled before, and else belongs to it
    for cell, det in ((("i0", "a"), 99), (("i1", "b"), 98)):
        if cell in closed_early:
            assert {x for x in got if x[:2] == cell} == {x for x in want if x[:2] == cell} and late.where(F.col("det_idx") == det).count() == 1
