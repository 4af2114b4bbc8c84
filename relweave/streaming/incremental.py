"""Incremental and streaming runs of the stateless stages.

The reference resumes a long run by skipping entries already done (A8, A9,
C12, I11). Here that is an anti-join on processed keys followed by an append
to the results table, so a rerun after a failure never redoes or duplicates
finished work. The same column expressions also run under Structured
Streaming: sentence split and noise are per-row, so a stream of new entries
needs no state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions import noise as N
from relweave.functions.text import join_sentences, materialize, split_sentences
from relweave.operators.extract import pending


def process_pending(spark: SparkSession, entries: DataFrame, results_path: str,
                    stage: Callable[[DataFrame], DataFrame], key: str = "entry_id") -> DataFrame:
    """Run ``stage`` on the entries whose key is not yet in ``results_path``
    and append its output there. Returns the processed batch."""
    # Only a folder that isn't there means that nothing is done; any error in reading
    # what is there must stop the job, or finished work would be appended again.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(results_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.parquet(results_path).select(key) if there else entries.select(key).limit(0)
    todo = pending(entries, done, key)
    out = stage(todo)
    out.write.mode("append").parquet(results_path)
    return out


def _files(spark: SparkSession, path: str):
    """(file system, path) on the cluster's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _commit(spark: SparkSession, out: DataFrame, results_path: str, name: str) -> bool:
    """Writes a batch aside and renames its folder into the results, which is one step:
    readers see all of it or nothing. False if a batch of that name is there already."""
    fs, final = _files(spark, f"{results_path}/batch={name}")
    if fs.exists(final):
        return False
    aside = f"{results_path}/_writing-{name}-{uuid.uuid4().hex}"
    out.write.parquet(aside)
    if not fs.rename(_files(spark, aside)[1], final):
        raise RuntimeError(f"batch {name} could not be put in place")
    return True


def read_filled(spark: SparkSession, results_path: str) -> DataFrame | None:
    """All committed batches, or None where there is none yet."""
    fs, path = _files(spark, results_path)
    if not fs.exists(path) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    return spark.read.option("basePath", results_path).parquet(f"{results_path}/batch=*").drop("batch")


def fill_in_batches(spark: SparkSession, entries: DataFrame, results_path: str, stage: Callable[[DataFrame], DataFrame],
                    key: str = "entry_id", batches: int = 16) -> int:
    """Runs a costly ``stage`` over the entries that have no result yet, batch by batch
    (A8, A9, I11); returns how many batches were committed. A run that ends between two
    batches loses only the one it was at: the committed ones are results, and the next run takes
    up the rest. Batches are dealt by the key's hash from one reading of the entries."""
    done = read_filled(spark, results_path)
    todo = pending(entries, done, key) if done is not None else entries
    run = uuid.uuid4().hex
    spool = f"{results_path}/_todo-{run}"
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    todo.withColumn("_b", part).repartition("_b").write.partitionBy("_b").parquet(spool)
    n = 0
    try:
        for i in range(batches):
            fs, path = _files(spark, f"{spool}/_b={i}")
            if fs.exists(path):
                n += _commit(spark, stage(spark.read.schema(entries.schema).parquet(f"{spool}/_b={i}")), results_path, f"{run}-{i}")
    finally:
        fs, path = _files(spark, spool)
        fs.delete(path, True)  # this run's own list of pending entries
    return n


def commit_stream_batch(results_path: str, stage: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is replayed after a failure is recognised by its number."""
    def run(batch: DataFrame, number: int) -> None:
        _commit(batch.sparkSession, stage(batch), results_path, f"stream-{number}")
    return run


def stream_fill(spark: SparkSession, source_dir: str, schema, results_path: str, checkpoint_dir: str, stage: Callable[[DataFrame], DataFrame]):
    """New entry files in ``source_dir`` go through ``stage`` as they come, exactly once."""
    s = spark.readStream.schema(schema).parquet(source_dir)
    return s.writeStream.foreachBatch(commit_stream_batch(results_path, stage)).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def noisy_variant(df: DataFrame, kind: str, level: str, src: str = "src", tid: str = "id",
                  text: str = "text") -> DataFrame:
    """One noise variant as plain per-row expressions (usable on a stream)."""
    t = materialize(df, [src, tid], sents=split_sentences(text))
    t = materialize(t, [src, tid, "sents"], hs=N.sentence_hashes(F.col("sents"), F.col(src), F.col(tid)))
    t = materialize(t, [src, tid, "sents"], picked=N.picked_flags(F.col("hs"), N.LEVELS[level]))
    noisy = N.apply_noise(kind, F.col("sents"), F.col("picked"), F.col(src), F.col(tid))
    return t.select(src, tid, F.lit(f"{kind}_{level}").alias("variant"), join_sentences(noisy).alias("text"))


def stream_noise(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                 kind: str = "type2_missing", level: str = "L2"):
    """Structured Streaming: new entry files in ``source_dir`` are noised and
    written to ``sink_dir``; progress is kept in ``checkpoint_dir`` (a shared
    folder on a cluster) so a restarted query resumes exactly once."""
    s = spark.readStream.schema(schema).parquet(source_dir)
    out = noisy_variant(s, kind, level)
    return (out.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).outputMode("append").start())
