"""Incremental and streaming runs give the batch results."""

import os
import tempfile

from pyspark.sql import functions as F

from relweave.streaming.incremental import noisy_variant, process_pending, stream_noise

ROWS = [("doc", i, f"Sentence one of {i}. Second one here. Third, with 12 items. Fourth.") for i in range(12)]
SCHEMA = "src string, id long, text string"


def test_process_pending_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="relweave-test-")
    entries = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("id", "entry_id")
    stage = lambda df: df.select("entry_id", F.length("text").alias("n"))
    path = os.path.join(d, "results")
    process_pending(spark, entries.filter("entry_id < 5"), path, stage)
    process_pending(spark, entries, path, stage)
    process_pending(spark, entries, path, stage)
    got = sorted(r.entry_id for r in spark.read.parquet(path).collect())
    assert got == list(range(12))


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="relweave-test-")
    src = os.path.join(d, "in")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(src)
    q = stream_noise(spark, src, SCHEMA, os.path.join(d, "out"), os.path.join(d, "ckpt"), "type4_structural", "L2")
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    exp = sorted(tuple(r) for r in noisy_variant(spark.createDataFrame(ROWS, SCHEMA), "type4_structural", "L2").collect())
    assert got == exp
