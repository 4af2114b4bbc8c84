"""Large JSON files of entries, read by byte ranges (A1, A2).

A file is cut at fixed offsets, so a cut may fall anywhere, even inside a string.
A first pass notes for every range what it does to a reader's state under either
assumption, inside a string or outside: quotes that open or close, the change of
depth, and records begun at each depth. Added up along a file these give each range its state, and
how many records come before it. In a second pass every range reads the records that begin in
it, the last one beyond its end. So files of any size are read by many tasks, and
entries are numbered without a sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.session import share_package

RANGE_BYTES = 32 << 20
_QUOTE, _BACKSLASH, _BRACE = 34, 92, 123
_STEP = np.zeros(256, np.int64)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1


def _open(path: str):
    """A file by the URI that Spark names it with."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    fs, where = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(where)


def _read(f, start: int, size: int) -> np.ndarray:
    return np.frombuffer(f.read_at(size, start), np.uint8)


def _escaped_before(f, start: int) -> bool:
    """Whether an odd run of backslashes ends right before ``start``."""
    run = 0
    while start > run and _read(f, start - run - 1, 1)[0] == _BACKSLASH:
        run += 1
    return run % 2 == 1


def scan(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(whether each byte is outside strings, depth before each byte relative to the
    start, whether the end is inside a string). Backslashes occur in strings only, so which quotes are
    escaped doesn't depend on the state."""
    n = len(data)
    at = np.arange(n)
    plain = np.maximum.accumulate(np.where(data != _BACKSLASH, at, -1))
    before = np.concatenate([[-1], plain[:-1]])  # last byte before that isn't a backslash
    run = at - 1 - before + np.where((before < 0) & escaped, 1, 0)
    toggles = (data == _QUOTE) & (run % 2 == 0)
    turned = np.cumsum(toggles)
    outside = ((turned - toggles) % 2 == 0) ^ inside
    step = np.where(outside, _STEP[data], 0)
    return outside, np.cumsum(step) - step, bool((turned[-1] % 2 == 1) ^ inside) if n else inside


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, i, start, length): the ranges of all files, by name only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    return files.select("file", F.posexplode(starts).alias("i", "start"), "bytes").withColumn("length", F.least(F.lit(size).cast("long"), F.col("bytes") - F.col("start")))


def _effects(batches):
    """What each range does to a reader that comes to it outside a string, or inside."""
    for b in batches:
        rows = []
        for file, i, start, length in zip(*(b.column(c).to_pylist() for c in ("file", "i", "start", "length"))):
            with _open(file) as f:
                data = _read(f, start, length)
                escaped = _escaped_before(f, start)
            text = data[~np.isin(data, [32, 9, 10, 13])][:1] if not start else data[:0]
            out, inn = (scan(data, x, escaped) for x in (False, True))
            per = []
            for outside, depth, _ in (out, inn):
                begun = depth[outside & (data == _BRACE)]
                levels, counts = np.unique(begun, return_counts=True)
                per.append((int(np.where(outside, _STEP[data], 0).sum()), dict(zip(levels.tolist(), counts.tolist()))))
            rows.append((file, i, start, length, int(out[2]), per[0][0], per[1][0], list(per[0][1].items()), list(per[1][1].items()), int(len(text) == 1 and text[0] == 91)))
        if rows:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.map_(pa.int64(), pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "i", "start", "length", "turn", "d0", "d1", "b0", "b1", "array"])


def _records(batches):
    """The records that begin in each range, whole."""
    for b in batches:
        for file, start, length, inside, depth, first, base in zip(*(b.column(c).to_pylist() for c in ("file", "start", "length", "inside", "depth", "before", "base"))):
            with _open(file) as f:
                data, total = _read(f, start, length), f.size()
                escaped = _escaped_before(f, start)
                outside, level, _ = scan(data, bool(inside), escaped)
                begins = np.flatnonzero(outside & (data == _BRACE) & (level + depth == base))
                if not len(begins):
                    continue
                more = 1 << 16
                while True:  # until the last record has closed
                    ends = np.flatnonzero(outside & (data == 125) & (level + depth == base + 1))
                    if (len(ends) and ends[-1] > begins[-1]) or start + len(data) >= total:
                        break
                    data = np.concatenate([data, _read(f, start + len(data), more)])
                    outside, level, _ = scan(data, bool(inside), escaped)
                    more *= 2
            ends = ends[np.searchsorted(ends, begins)[np.searchsorted(ends, begins) < len(ends)]]
            raw = data.tobytes()
            texts = [raw[a:z + 1].decode("utf-8", "replace") for a, z in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["entry_id", "json"])


def read_records(spark: SparkSession, path: str, n: int | None = None, range_bytes: int = RANGE_BYTES, range_tasks: int = 64) -> DataFrame:
    """(entry_id, json): the records of JSON files -- arrays of objects, or objects one
    after the other -- numbered from 0 by file name and place. With ``n`` exactly the first n (fewer if
    there are fewer): ranges are looked at in growing groups until they hold as many, and none after them is read.

    Files are opened in tasks by their URI. Text is UTF-8; a record that the file's end cuts off is left out.
    """
    share_package(spark)
    ranges = _ranges(spark, path, range_bytes)
    schema = "file string, i int, start long, length long, turn int, d0 long, d1 long, b0 map<long,long>, b1 map<long,long>, array int"

    def placed(some: DataFrame) -> DataFrame:
        e = some.repartition(range_tasks, "file", "i").mapInArrow(_effects, schema)
        along = Window.partitionBy("file").orderBy("i")
        past = along.rowsBetween(Window.unboundedPreceding, -1)
        e = e.withColumn("base", F.max("array").over(Window.partitionBy("file"))).withColumn("inside", F.coalesce(F.sum("turn").over(past), F.lit(0)) % 2)
        pick = lambda a, b: F.when(F.col("inside") == 0, F.col(a)).otherwise(F.col(b))
        e = e.withColumn("depth", F.coalesce(F.sum(pick("d0", "d1")).over(past), F.lit(0)))
        e = e.withColumn("records", F.coalesce(F.element_at(pick("b0", "b1"), F.col("base") - F.col("depth")), F.lit(0)))
        per = e.groupBy("file").agg(F.sum("records").alias("of")).withColumn("lead", F.coalesce(F.sum("of").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return (e.join(per, "file").withColumn("before", F.col("lead") + F.coalesce(F.sum("records").over(past), F.lit(0)))
                .select("file", "i", "start", "length", "inside", "depth", "base", "records", "before"))

    if n is None:
        found = placed(ranges)
    else:
        order, take = Window.orderBy("file", "i"), range_tasks
        numbered = ranges.withColumn("place", F.row_number().over(order))  # names of ranges, no contents
        total = numbered.count()
        while True:
            found = placed(numbered.where(F.col("place") <= take).drop("place"))
            if take >= total or (found.agg(F.sum("records")).first()[0] or 0) >= n:
                break
            take *= 4
        found = found.where(F.col("before") < n)
    out = found.where("records > 0").repartition(range_tasks, "file", "i").mapInArrow(_records, "entry_id long, json string")
    return out if n is None else out.where(F.col("entry_id") < n)
