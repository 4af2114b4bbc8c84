"""Joins (C1-C12): null-safe merges, FK flattening, integrity checks.

No join here carries a broadcast hint: Catalyst and AQE broadcast a side only
when its measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise plan a sort-merge join, and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_nullsafe(left: DataFrame, right: DataFrame, lk: str, rk: str, how: str = "inner",
                   suffixes: tuple[str, str] = ("_x", "_y"), heavy: bool = False) -> DataFrame:
    """pandas-style merge (C1): right key renamed to the left key, null keys
    match null keys, clashing columns suffixed, one key column (coalesced for
    right/outer joins). ``heavy``: keys, null among them, that hold a large share of the
    rows are counted first and spread over many tasks."""
    lcols = [c for c in left.columns if c != lk]
    rcols = [c for c in right.columns if c != rk]
    clash = set(lcols) & set(rcols)
    l2 = left.select(F.col(lk).alias("_lk"), *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in lcols])
    r2 = right.select(F.col(rk).alias("_rk"), *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in rcols])
    if heavy:
        from relweave.operators.heavy import heavy_join

        return heavy_join(l2.withColumnRenamed("_lk", lk), r2.withColumnRenamed("_rk", lk), [lk], "full" if how.replace("_", "") in ("outer", "fullouter") else how)
    j = l2.join(r2, l2["_lk"].eqNullSafe(r2["_rk"]), how)
    key = F.col("_lk") if how in ("inner", "left", "left_outer") else F.coalesce("_lk", "_rk")
    return j.select(key.alias(lk), *[c for c in j.columns if c not in ("_lk", "_rk")])


def merge_chain(base: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Chained inner merges to one wide table."""
    return reduce(lambda acc, s: merge_nullsafe(acc, s[0], s[1], s[2], "inner"), steps, base)


def flatten(tables: dict[str, DataFrame], edges: list[dict], root: str) -> DataFrame:
    """Join along FK edges in breadth-first order from ``root``.

    ``edges``: dicts with child, child_col, parent, parent_col, how and an
    optional ``alias`` (one table under several roles). An edge is followed from
    the child to its parent, or with ``reverse`` from the parent to its children
    and bridges (LEFT unless ``how`` says otherwise). Output columns are named
    ``<alias>_<column>``."""
    def aliased(name, alias):
        df = tables[name]
        return df.select(*[F.col(c).alias(f"{alias}_{c}") for c in df.columns])

    out = aliased(root, root)
    queue = deque([(root, root)])
    while queue:
        tname, talias = queue.popleft()
        for e in edges:
            near, far = ("parent", "child") if e.get("reverse") else ("child", "parent")
            if e[near] != tname or e.get("from_alias", e[near]) != talias:
                continue
            alias = e.get("alias", e[far])
            p = aliased(e[far], alias)
            out = out.join(p, out[f"{talias}_{e[near + '_col']}"] == p[f"{alias}_{e[far + '_col']}"],
                           e.get("how", "left" if e.get("reverse") else "inner"))
            queue.append((e[far], alias))
    return out


def fk_share(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Matched share of non-null child values in the parent key set.

    Child values are first counted per value (partial aggregation collapses a
    hot value on the map side), parent keys are deduplicated, and only the two
    per-key tables are joined. Share is 1.0 when the child column is empty."""
    cv = (child.select(F.col(child_col).alias("_v")).filter(F.col("_v").isNotNull())
          .groupBy("_v").agg(F.count(F.lit(1)).alias("_n")))
    pv = parent.select(F.col(parent_col).alias("_v")).distinct().withColumn("_hit", F.lit(1))
    j = cv.join(pv, "_v", "left")
    agg = j.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_child"),
                F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("n_matched"))
    return agg.withColumn("share", F.when(F.col("n_child") == 0, F.lit(1.0))
                          .otherwise(F.col("n_matched") / F.col("n_child")))


def fk_shares(tables: dict[str, DataFrame], fks: list[tuple[str, str, str, str]]) -> DataFrame:
    """(fk, n_child, n_matched, share) for many foreign keys (child, column, parent,
    column) at once, as :func:`fk_share`: every child table is read once for all its keys, whose
    values are counted in long form and meet all parents' keys in one join."""
    names = {fk: f"{fk[0]}.{fk[1]}->{fk[2]}.{fk[3]}" for fk in fks}
    counted = []
    for child in dict.fromkeys(fk[0] for fk in fks):
        mine = [fk for fk in fks if fk[0] == child]
        long = F.array(*[F.struct(F.lit(names[fk]).alias("fk"), F.col(fk[1]).alias("v")) for fk in mine])
        counted.append(tables[child].select(F.inline(long)))
    values = union_results(counted).where(F.col("v").isNotNull()).groupBy("fk", "v").agg(F.count(F.lit(1)).alias("n"))
    parents = union_results([tables[p].select(F.lit(names[fk]).alias("fk"), F.col(pc).alias("v")) for fk in fks for p, pc in [fk[2:]]]).distinct().withColumn("hit", F.lit(1))
    got = values.join(parents, ["fk", "v"], "left").groupBy("fk").agg(F.sum("n").alias("n_child"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("n_matched"))
    all_fks = tables[fks[0][0]].sparkSession.createDataFrame([(n,) for n in names.values()], "fk string")
    out = all_fks.join(got, "fk", "left").select("fk", F.coalesce("n_child", F.lit(0)).alias("n_child"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))
    return out.withColumn("share", F.when(F.col("n_child") == 0, F.lit(1.0)).otherwise(F.col("n_matched") / F.col("n_child")))


def union_results(dfs: list[DataFrame]) -> DataFrame:
    """Union of result sets with different columns (C4)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_keys(scores: DataFrame, key: str, method: str, score: str, n_methods: int) -> DataFrame:
    """Keys present in every method and never ``-1``."""
    ok = (scores.groupBy(key).agg(F.count_distinct(method).alias("_m"), F.min(score).alias("_s"))
          .filter((F.col("_m") == n_methods) & (F.col("_s") != -1)).select(key))
    return scores.join(ok, key, "left_semi")
