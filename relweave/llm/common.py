"""Helpers shared by the operators: input selection, text slicing, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.session import ensure_checkpoint_dir

#: Text bytes worked on at a time inside a task; bounds the Python memory of a
#: task whatever the number of rows Spark hands over in one Arrow batch.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Python workers on this machine find the package wherever the session was
    # started; on a cluster it is shipped with --py-files.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only these two columns enter an operator, so
    extra columns cannot clash with the operator's own names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))


def whole_components(v: Column, scale: int, limit: Column | float) -> tuple[Column, Column]:
    """(usable, components): ``floor(scale * x)`` of every component, x as double.
    Usable are vectors without null or non-finite components whose multiples stay
    below ``limit``, so that sums of products fit into a long."""
    x = v.cast("array<double>")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e * float(scale)) < limit), F.lit(False)))
    return F.coalesce(v.isNotNull() & fine, F.lit(False)), F.transform(x, lambda e: F.floor(e * float(scale)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds about ``most`` bytes of
    ``column`` (a longer single row stays whole)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64) + 64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(start, end - start)
            start = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+length[i]-1 for every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def publish(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes ``data`` into the shared checkpoint folder with the cluster's own
    file system and hands it to every executor; returns the name to give to
    ``SparkFiles.get`` in a task. For models of bounded size."""
    sc = spark.sparkContext
    full = f"{name}-{uuid.uuid4().hex}.bin"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{full}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i:i + (1 << 20)]))
    finally:
        out.close()
    sc.addFile(str(fs.makeQualified(path).toString()))
    return full


def publish_files(rows: DataFrame, column: str, name: str) -> tuple[str, ...]:
    """Tasks write the binary ``column`` to a folder of the shared checkpoint folder,
    each value followed by a line end, one file for each partition; the files are
    handed to every executor. Returns the names to give to ``SparkFiles.get``."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    folder = f"{ensure_checkpoint_dir(spark)}/{name}"
    rows.select(F.col(column).cast("string").alias("value")).write.option("compression", "none").text(folder)
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(path):
        file = status.getPath()
        if file.getName().startswith("part-") and status.getLen():
            sc.addFile(str(fs.makeQualified(file).toString()))
            out.append(file.getName())
    return tuple(sorted(out))
