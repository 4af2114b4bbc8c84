"""Centroid clustering in integers, with Spark's own expressions only.

Components are floored multiples, so every distance and every sum is exact and
doesn't depend on the order of rows. A vector meets the centroids as literal
arrays: ``zip_with`` and ``aggregate`` give the squared distance to each, and
``array_min`` of (distance, number) pairs the nearest, ties to the smaller
number. A round's new centroids are plain column sums grouped by cluster, added up
before the shuffle; what comes to the driver is one row per centroid.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import whole_components
from relweave.session import cut_lineage

#: Centroids and rounds of the registered query.
CENTROIDS, ROUNDS = 40, 5


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v, square): the vectors that take part, in whole components."""
    v = F.col(vector_col)
    # a squared distance is below dims * (2 * limit)^2 <= 2^62
    usable, whole = whole_components(v, scale, float(int((2.0 ** 60 / dims) ** 0.5)))
    return df.where((F.size(v) == dims) & usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).withColumn("square", _dot(F.col("v"), F.col("v")))


def _literal(centroids: list[list[int]]) -> Column:
    """The centroids and their squared lengths; Spark folds this into one literal."""
    one = lambda c: F.struct(F.lit(sum(x * x for x in c)).cast("long").alias("square"), F.split(F.lit(",".join(map(str, c))), ",").cast("array<long>").alias("c"))
    return F.array(*map(one, centroids))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda total, p: total + p)


def nearest_centroid(v: Column, square: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ``square`` is the vector's
    product with itself, and |v-c|^2 = |v|^2 + |c|^2 - 2vc is exact in integers."""
    return F.array_min(F.transform(_literal(centroids), lambda c, i: F.struct((square + c["square"] - F.lit(2) * _dot(v, c["c"])).alias("distance"), i.alias("cluster"))))


def first_centroids(rows: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The ``k`` vectors of the smallest hashes of ``salt:id``; equal hashes (a
    repeated id, null ids, which come last) by their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k)
    return [list(r.v) for r in top.orderBy(F.col("key").asc_nulls_last(), "v").collect()]


def new_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of every cluster; an empty one stays."""
    dims = len(centroids[0])
    sums = (rows.select("v", nearest_centroid(F.col("v"), F.col("square"), centroids)["cluster"].alias("cluster"))
            .groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[d]).alias(f"s{d}") for d in range(dims))))
    out = list(centroids)
    for r in sums.collect():  # at most one row per centroid
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(dims)]
    return out


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = 64, scale: int = 256, salt: int = 2,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), final centroids).

    One row for every row that takes part: vectors of exactly ``dims`` components,
    none null or non-finite. Components are ``floor(scale * x)``; a vector with one
    of ``sqrt(2^60 / dims)`` or more (2^27 at 64) takes no part, as its squared
    distance wouldn't fit into a long. Repeated rows are points of their own; a
    null id stays null and is chosen as a first centroid only after all others.
    With fewer rows than ``k`` there are fewer centroids; an empty table gives no
    rows and no centroids. ``inertia`` sums are null where they exceed a long.
    Extra columns are ignored.

    The driver holds the centroids alone (``k`` times ``dims`` numbers). Each round
    is one pass over the table; the last assignment, without its vectors, is
    checkpointed, as its sums and its rows are both read.
    """
    rows = kept_vectors(df, id_col, vector_col, dims, scale)
    centroids = first_centroids(rows, k, salt)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")),
                           F.lit("").alias("centroid_sha256")).where(F.lit(False)), []
    for _ in range(rounds):
        centroids = new_centroids(rows, centroids)
    near = nearest_centroid(F.col("v"), F.col("square"), centroids)
    last = cut_lineage(rows.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"))
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids))
    own = last.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = last.agg(F.try_sum("distance").alias("inertia"))
    # both are bounded by the number of centroids
    sums = own.join(F.broadcast(total), F.lit(True)).withColumn("centroid_sha256", F.get(names, F.col("cluster")))
    return (last.join(F.broadcast(sums), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")), centroids
