"""Truth groups of a stream equal those of the batch, in whatever order hits arrive."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cloudloom.operators.windows import truth_groups
from cloudloom.streaming.groups import PROVIDER, group_stream, write_groups

SCHEMA = "ev int, hit_id long, ts timestamp, e double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def hits(seed, n=120):
    rng = random.Random(seed)
    out, at = [], 0.0
    for k in range(n):
        at += rng.choice([0.0, 0.5, 2.999999, 3.0, 3.000001, 7.0])
        out.append((k % 2, k, START + timedelta(seconds=at), 1.0))
    return out


def streamed(spark, tmp_path, files):
    source, path, mark = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = write_groups(spark, group_stream(stream, ["ev"], 3.0, "400 seconds"), path, mark)
        query.awaitTermination()
    return spark.read.parquet(path), query


@pytest.mark.parametrize("seed", range(2))
def test_equals_batch_in_any_order(spark, tmp_path, seed):
    rows = hits(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    far = [(9, 10_000, START + timedelta(days=2), 1.0)]  # a later hit of another event moves the watermark on
    got, _ = streamed(spark, tmp_path, [shuffled[:50], shuffled[50:51], shuffled[51:], far])
    batch = truth_groups(spark.createDataFrame(rows, SCHEMA).withColumn("t", F.unix_micros("ts")), ["ev"], "t", 3_000_000)
    want = sorted((r.ev, r.hit_id, r.g) for r in batch.collect())
    assert sorted((r.ev, r.hit_id, r.g) for r in got.collect()) == want
    assert spark.conf.get(PROVIDER) != "" and "RocksDB" not in spark.conf.get(PROVIDER)


def test_late_hits_are_counted_and_left_out(spark, tmp_path):
    late = [(0, 5000, START, 1.0)]
    far = [(9, 10_000, START + timedelta(days=2), 1.0)]
    got, last = streamed(spark, tmp_path, [hits(3, 20), far, late])
    assert 5000 not in {r.hit_id for r in got.collect()}
    assert sum(op["numRowsDroppedByWatermark"] for p in last.recentProgress for op in p["stateOperators"]) == 1
