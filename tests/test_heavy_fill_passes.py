"""Heavy-key joins, batched fills, extraction passes and dependency search."""

import itertools
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relweave.operators.dependencies import minimal_dependencies
from relweave.operators.extract import bind_passes, extract_passes
from relweave.operators.heavy import heavy_join, heavy_keys
from relweave.operators.joins import merge_nullsafe
from relweave.streaming.incremental import commit_stream_batch, fill_in_batches, read_filled, stream_fill


def brute_join(left, right, how):
    out = []
    for k, a in left:
        hits = [b for j, b in right if j == k]
        out += [(k, a, b) for b in hits] or ([(k, a, None)] if how in ("left", "full") else [])
    keys = {k for k, _ in left}
    return out + ([(k, None, b) for k, b in right if k not in keys] if how in ("right", "full") else [])


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_heavy_join_equals_plain_join(spark, how):
    rng = random.Random(4)
    keys = [1] * 50 + [None] * 30 + [7] * 30 + list(range(2, 7))
    left = [(rng.choice(keys), f"a{i}") for i in range(300)] + [(1, "twin"), (1, "twin")]
    right = [(rng.choice([1, None, 2, 3, 99, 88, 88]), f"b{i}") for i in range(40)] + [(88, f"c{i}") for i in range(60)]
    l, r = spark.createDataFrame(left, "k int, a string").repartition(3), spark.createDataFrame(right, "k int, b string").repartition(2)
    want = Counter(brute_join(left, right, how))
    for least in (5, 40, 10_000):  # many heavy keys, some, none
        assert Counter(map(tuple, heavy_join(l, r, ["k"], how, parts=1000, least=least).collect())) == want
    assert heavy_keys(l, r, ["k"], 1000, 10_000) is None
    assert heavy_join(l.where("false"), r, ["k"], how, parts=1000, least=5).count() == (len(right) if how in ("right", "full") else 0)
    if how == "full":
        merged = merge_nullsafe(l, r.withColumnRenamed("k", "j"), "k", "j", "outer", heavy=True)
        assert merged.columns == ["k", "a", "b"] and Counter(map(tuple, merged.collect())) == want


def test_no_task_has_a_heavy_key_for_itself(spark):
    """Half of all rows on one key, a fifth without a key."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).when(F.col("id") % 5 == 1, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("a"))
    right = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("b"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(before, ("false", "-1", "16")):
            spark.conf.set(c, v)
        out = heavy_join(rows, right, ["k"], "full", parts=40, least=100)
        per = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(per) <= 3 * statistics.median(per)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_fill_goes_on_after_a_failure(spark, tmp_path):
    entries = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "entry_id long, text string").repartition(3)
    path, seen = str(tmp_path / "results"), []

    def stage(df):
        seen.append(df.count())
        if len(seen) == 4:
            raise RuntimeError("ends between two batches")
        return df.withColumn("out", F.upper("text"))

    assert read_filled(spark, path) is None
    with pytest.raises(RuntimeError):
        fill_in_batches(spark, entries, path, stage, batches=8)
    half = read_filled(spark, path)
    assert half.count() == sum(seen[:3]) and half.columns == ["entry_id", "text", "out"]
    assert fill_in_batches(spark, entries, path, stage, batches=8) == 5
    rows = read_filled(spark, path).collect()
    assert sorted(r.entry_id for r in rows) == list(range(200)) and all(r.out == r.text.upper() for r in rows)
    assert fill_in_batches(spark, entries, path, stage) == 0
    assert not [p.name for p in (tmp_path / "results").iterdir() if p.name.startswith("_todo")]
    fill_in_batches(spark, spark.createDataFrame([(5, "t5"), (900, "new")], "entry_id long, text string"), path, stage)
    assert sorted(r.entry_id for r in read_filled(spark, path).collect()) == [*range(200), 900]


def test_replayed_stream_batches_are_recognised(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "entry_id long, text string")
    one.write.parquet(source)
    stage = lambda df: df.withColumn("n", F.length("text"))
    stream_fill(spark, source, one.schema, path, str(tmp_path / "ck"), stage).awaitTermination()
    commit_stream_batch(path, stage)(one, 0)  # the same batch once more
    spark.createDataFrame([(3, "cc")], one.schema).write.mode("append").parquet(source)
    stream_fill(spark, source, one.schema, path, str(tmp_path / "ck"), stage).awaitTermination()
    assert sorted(map(tuple, read_filled(spark, path).collect())) == [(1, "a", 1), (2, "b", 1), (3, "cc", 2)]


def test_later_passes_add_what_the_first_can_not_find(spark):
    df = spark.createDataFrame([(1, "a is 1, B NAME: x, the c equals 3 and d was 4, nothing.\nz is 1 is 2."), (2, ""), (3, None)], "entry_id long, text string")
    got = [tuple(r) for r in extract_passes(df).orderBy("entry_id", "line_pos", "pass", "attr").collect()]
    assert got == [(1, 0, 1, "a", "1"), (1, 0, 2, "B NAME", "x"), (1, 0, 3, "c", "3"), (1, 0, 3, "d", "4"), (1, 1, 1, "z", "1 is 2")]
    cat = spark.createDataFrame([("m", "t", "A"), ("m", "t", "b_name")], "domain string, table_name string, column_name string")
    facts = extract_passes(df).withColumn("domain", F.lit("m"))
    names = [F.lower("attr"), F.regexp_replace(F.lower("attr"), " ", "_")]
    assert {(r.column_name, r.bound_pass) for r in bind_passes(facts, cat, names).collect()} == {("A", 1), ("b_name", 2)}


def brute_dependencies(rows, columns, most):
    out = []
    for a in range(len(columns)):
        held = []
        for k in range(most + 1):
            for x in itertools.combinations([c for c in range(len(columns)) if c != a], k):
                if any(set(y) <= set(x) for y in held):
                    continue
                if len({tuple(r[c] for c in x) for r in rows}) == len({(*(r[c] for c in x), r[a]) for r in rows}):
                    held.append(x)
        out += [(tuple(columns[c] for c in x), columns[a]) for x in held]
    return sorted(out)


def test_dependencies_equal_brute_force(spark):
    rng = random.Random(8)
    for n in (1, 12, 60):
        rows = [(x := rng.randrange(4), rng.choice([None, 1, 2]), x % 2, rng.randrange(3), 5, i) for i in range(n)]
        rows += rows[:2]
        columns = ["a", "b", "c", "d", "e", "f.g"]
        df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, `f.g` int")
        for most in (1, 2, 3):
            assert minimal_dependencies(df, columns, most) == brute_dependencies(rows, columns, most)
    assert minimal_dependencies(df.where("false"), columns) == []
