"""From raw documents to token ids: five stages, each one operator over all that
the stage before kept.

Every stage reads ``documents`` rows and returns rows of the same columns, the
last one the ids. A stage's result is written as Parquet and read again by the
next, so a stage can be run again alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import bpe, decontam, linededup, quality, queries, simhash
from relweave.llm.common import read
from relweave.session import ensure_checkpoint_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field doesn't reject."""
    return quality.keep_good(docs, queries.quality_field(spark, sf_dir, docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of a smaller id holds; a document
    that loses all it had goes. ``n_chars`` follows the text."""
    out = linededup.dedup_rows(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first by id (nulls last), then by the
    other columns. Groups are of rows, so rows that share an id or have none and
    aren't near copies all stay."""
    return simhash.first_rows(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of them and of the decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.token_digests(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe_encoding", token_ids),
]

#: No stage but the line dedup can be put as SQL (a fitted field, 64-bit hashes, edit
#: distance, merges); tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what lies between them is written to the
    shared checkpoint folder. A stage's rows are removed once the next stage's are
    written whole; those that the result reads stay."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
