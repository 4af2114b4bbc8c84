"""Projection, filtering and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop named columns (B1)."""
    return df.drop(*cols)


def drop_pattern_columns(df: DataFrame, contains: tuple[str, ...] = ("id", "_y"),
                         strip: str = "_x", whole_token: bool = False) -> DataFrame:
    """Drop columns whose name contains ``id`` (any case) or ``_y``; then
    remove ``_x`` anywhere in the remaining names (B2). ``whole_token`` only
    matches ``id`` as an underscore-delimited token, so ``video`` stays (Q20)."""
    def hit(name: str) -> bool:
        low = name.lower()
        for c in contains:
            if whole_token and c == "id":
                if re.search(r"(^|_)id($|_)", low):
                    return True
            elif c.lower() in low:
                return True
        return False
    kept = [c for c in df.columns if not hit(c)]
    return df.select(*[F.col(f"`{c}`").alias(c.replace(strip, "")) for c in kept])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map."""
    return df.withColumnsRenamed(mapping)


def drop_null_rows(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Rows with any / all nulls removed."""
    return df.na.drop(how=how, subset=subset)


def column_null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One pass over ``df``: per column the non-null count and row count, and
    the two keep rules of B6 (non-null >= 0.5 n; null share < 0.8)."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_nn_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_nn_{c}").alias("non_null"))
                     for c in cols])
    p = agg.select("_n", F.inline(rows)).withColumnRenamed("_n", "n_rows")
    share = F.when(F.col("n_rows") > 0, 1.0 - F.col("non_null") / F.col("n_rows"))
    return (p.withColumn("null_share", share)
            .withColumn("keep_half", F.col("non_null") >= F.col("n_rows") * 0.5)
            .withColumn("keep_null80", share < 0.8))


def drop_sparse_columns(df: DataFrame, cols: list[str], rule: str = "keep_half") -> DataFrame:
    """Keep only the columns passing the rule (B6). The profile is a one-row
    aggregate, so reading it on the driver is bounded by the column count."""
    prof = column_null_profile(df, cols).select("column_name", rule).collect()
    keep = {r[0] for r in prof if r[1]}
    return df.select(*[c for c in df.columns if c not in cols or c in keep])


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, rows with any / all nulls among ``cols``, and the row counts left
    after ``na.drop('any')`` and ``na.drop('all')`` (B4, B5, B7) in one pass."""
    anyn = F.greatest(*[F.col(c).isNull().cast("int") for c in cols])
    alln = F.least(*[F.col(c).isNull().cast("int") for c in cols])
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(anyn).alias("n_any_null"),
                  F.sum(alln).alias("n_all_null")) \
        .withColumn("n_after_drop_any", F.col("n_rows") - F.col("n_any_null")) \
        .withColumn("n_after_drop_all", F.col("n_rows") - F.col("n_all_null"))


def exclude_values(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Remove whole datasets / domains by name."""
    return df.filter(~F.col(col).isin(values))


def placeholder_filter(df: DataFrame, cols: list[str], words: list[str]) -> DataFrame:
    """Drop rows whose parts are header words; 'none of' (Q14 fixed)."""
    cond = F.lit(True)
    for c, w in zip(cols, words):
        cond = cond & (F.lower(F.col(c)) != w.lower())
    return df.filter(cond)


def keep_mentioned(arr, low_text, name=lambda x: x):
    """Elements whose lower-case ``name`` occurs in the lower-cased text."""
    return F.filter(arr, lambda x: F.instr(low_text, F.lower(name(x))) > 0)
