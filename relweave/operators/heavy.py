"""Joins whose keys may be heavy.

Keys that hold more than a given share of a side's rows are found by a count, of
which there are few by definition. They are joined by themselves: the rows of
either side are dealt to chunks, and each chunk of one side meets each of the
other. All other keys take a plain join. Null keys match null keys and are
treated like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.operators.joins import union_results

#: A key is heavy above this share of a side's rows, and above this many rows.
PARTS, LEAST = 100, 20_000


def heavy_keys(left: DataFrame, right: DataFrame, on: list[str], parts: int = PARTS, least: int = LEAST) -> DataFrame | None:
    """(on..., _h, _l, _r, _sl, _sr): the heavy keys, numbered, with the rows and chunks of
    either side; None if there is none. Less than ``2 * parts`` rows, which the driver holds."""
    rows = union_results([left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")), right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))])
    counts = rows.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    big = {"_l": max(least, left.count() // parts), "_r": max(least, right.count() // parts)}
    found = counts.where((F.col("_l") > big["_l"]) | (F.col("_r") > big["_r"])).collect()
    if not found:
        return None
    spark = left.sparkSession
    chunks = lambda n, most: max(1, -(-n // most))
    data = [(*[r[c] for c in on], i, r["_l"], r["_r"], chunks(r["_l"], big["_l"]), chunks(r["_r"], big["_r"])) for i, r in enumerate(found)]
    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on)
    return spark.createDataFrame(data, f"{kinds}, _h int, _l long, _r long, _sl long, _sr long")


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """Equi-join (inner, left, right, full) on ``on``, null keys matching null keys, with
    one column for each key; other column names must differ. Every row and match comes
    as often as in a plain join."""
    lcols, rcols = [c for c in left.columns if c not in on], [c for c in right.columns if c not in on]

    def plain(a, b, kind):
        b2 = b.select(*[F.col(c).alias(f"_right_{c}") for c in on], *rcols)
        j = a.join(b2, reduce(lambda x, y: x & y, [a[c].eqNullSafe(b2[f"_right_{c}"]) for c in on]), kind)
        return j.select(*[F.coalesce(a[c], b2[f"_right_{c}"]).alias(c) for c in on], *lcols, *rcols)

    heavy = heavy_keys(left, right, on, parts, least)
    if heavy is None:
        return plain(left, right, how)

    def marked(side):
        h = heavy.select(*[F.col(c).alias(f"_key_{c}") for c in on], "_h", "_l", "_r", "_sl", "_sr")
        return side.join(F.broadcast(h), reduce(lambda x, y: x & y, [side[c].eqNullSafe(h[f"_key_{c}"]) for c in on]), "left").drop(*[f"_key_{c}" for c in on])

    a, b = marked(left), marked(right)
    out = [plain(a.where("_h is null").select(*left.columns), b.where("_h is null").select(*right.columns), how)]
    own = F.monotonically_increasing_id()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = a.where("_h is not null and _r > 0").withColumn("_i", F.pmod(own, F.col("_sl"))).withColumn("_j", every("_sr")).select(*left.columns, "_h", "_i", "_j")
    y = b.where("_h is not null and _l > 0").withColumn("_j", F.pmod(own, F.col("_sr"))).withColumn("_i", every("_sl")).select(*rcols, "_h", "_i", "_j")
    out.append(x.join(y, ["_h", "_i", "_j"]).select(*on, *lcols, *rcols))
    if how in ("left", "full", "outer"):
        out.append(a.where("_h is not null and _r = 0").select(*on, *lcols))
    if how in ("right", "full", "outer"):
        out.append(b.where("_h is not null and _l = 0").select(*on, *rcols))
    return union_results(out).select(*on, *lcols, *rcols)
