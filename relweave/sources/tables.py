"""Readers for the parquet test tables and the reference's JSON/CSV formats."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.sources.entries import RANGE_BYTES, read_records

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]


# Entry JSON layout (A1): ground-truth pairs are two-element arrays on disk.
ENTRY_JSON_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("ground_truth_entities", T.ArrayType(T.StringType())),
    T.StructField("ground_truth_key_value",
                  T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.StringType())))),
    T.StructField("domain", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("predicted_schema", T.StringType()),
    T.StructField("output", T.StringType()),
])


def read_entries(spark: SparkSession, path: str, n: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entry files (JSON arrays) with an explicit ``entry_id``: the position over (file
    name, place in file), from 0. With ``n`` exactly n entries are returned
    (the reference's n+1 is fixed, Q1). A file is read by as many tasks as it has
    ranges of ``range_bytes``.
    """
    df = read_records(spark, path, n, range_bytes).select("entry_id", F.from_json("json", ENTRY_JSON_SCHEMA).alias("e")).select("entry_id", "e.*")
    kv = F.transform_values("ground_truth_key_value", lambda k, a: F.transform(a, lambda p: F.struct(F.get(p, 0).alias("id"), F.get(p, 1).alias("value"))))
    return df.withColumn("ground_truth_key_value", kv)


def _csv_files(spark: SparkSession, root: str, suffix: str, skip_folders: tuple[str, ...]) -> list[tuple[str, str]]:
    """(relative path, path) of the files below ``root`` whose name ends with
    ``suffix``, by the cluster's file system; skipped folders aren't entered."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    found, todo = [], [top]
    while todo:
        for st in fs.listStatus(todo.pop()):
            name = st.getPath().getName()
            if st.isDirectory():
                if name not in skip_folders:
                    todo.append(st.getPath())
            elif name.endswith(suffix):
                full = fs.makeQualified(st.getPath()).toString()
                found.append((full[len(base):], full))
    return sorted(found)


def read_csv_folder(spark: SparkSession, root: str, suffix: str = "data.csv",
                    skip_folders: tuple[str, ...] = (), at_once: int = 8) -> dict[str, DataFrame]:
    """Recursive CSV ingest (A3): one frame per file, each with its own header,
    under the file's relative path without extension, folders joined by ``_``.
    Files that can't be read as CSV to their end are left out one by one: the one job of a file, which
    infers its types, reads all of it. ``at_once`` such jobs run side by side."""
    def frame(full):
        try:
            return spark.read.option("header", True).option("inferSchema", True).csv(full)
        except (AnalysisException, Py4JJavaError, PySparkException):
            return None

    files = _csv_files(spark, root, suffix, skip_folders)
    with ThreadPoolExecutor(at_once) as pool:
        frames = pool.map(frame, [full for _, full in files])
    return {rel.rsplit(".", 1)[0].replace("/", "_"): df for (rel, _), df in zip(files, frames) if df is not None and df.columns}


def find_json(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """Recursive find of JSON files with an exact name (A5)."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    if schema is not None:
        r = r.schema(schema)
    return r.option("multiLine", True).json(root)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink without index."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink."""
    df.write.mode(mode).json(path)


def to_json_text(df: DataFrame, col: str = "json") -> DataFrame:
    """Nested record to JSON text; unknown types become strings."""
    return df.select(F.to_json(F.struct("*")).alias(col))


def export_tables_csv(spark: SparkSession, database: str, out_root: str) -> list[str]:
    """Every table of a catalog database to one CSV folder each (A4)."""
    written = []
    for t in spark.catalog.listTables(database):
        path = f"{out_root.rstrip('/')}/{t.name}"
        write_csv(spark.table(f"{database}.{t.name}"), path)
        written.append(path)
    return written
