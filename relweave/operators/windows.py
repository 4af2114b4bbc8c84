"""Ordered positions without single-task windows.

``row_number() over (partition by g order by k)`` sends a whole group to one
task; when one group may hold a third of all rows that task is the job. These
helpers compute the same numbers from a range-partitioned sort: each range
partition numbers its own slice, and per-(group, partition) offsets -- a table
of at most ``#groups + #partitions`` rows -- shift the local numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.session import cut_lineage


def rank_in_group(df: DataFrame, group: list[str] | str | None, order: list[str],
                  out: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group by ``order`` (which must
    be a total order). ``group=None`` numbers the whole table (E1)."""
    groups = [] if group is None else ([group] if isinstance(group, str) else list(group))
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = groups + list(order)
    r = (df.repartitionByRange(n, *keys)
         .sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    # Pin partition ids and in-partition ids: recomputation after an executor
    # loss must see exactly the same numbering.
    r = cut_lineage(r)
    counts = r.groupBy(*groups, "_pid").agg(F.count(F.lit(1)).alias("_c"),
                                           F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    j = r.join(offs, groups + ["_pid"]) if groups else r.join(offs, ["_pid"])
    return j.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint")) \
        .drop("_pid", "_mid", "_m0", "_off")
