"""Cleaning queries over orders with md5-chosen missing cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import finalize
from relweave.operators.clean import column_null_profile, drop_null_rows, drop_sparse_columns, null_profile
from relweave.plans.registry import query
from relweave.sources.tables import read_table

# Share of cells made missing per column, in sixteenths (first md5 hex digit < rate).
NULL_RATES = {"o_custkey": 1, "o_orderstatus": 10, "o_totalprice": 2, "o_orderdate": 14, "o_orderpriority": 5}


def hex_digit(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 1), 16, 10).cast("int")


def orders_with_nulls(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", *[
        F.when(hex_digit(F.lit("null"), F.lit(c), k) < r, F.lit(None)).otherwise(F.col(c)).alias(c)
        for c, r in NULL_RATES.items()])


def _sql_hex(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 1))::INTEGER"


ORDERS_NULLED_SQL = "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN {_sql_hex(repr('null'), repr(c), 'CAST(o_orderkey AS VARCHAR)')} < {r} THEN NULL ELSE {c} END AS {c}"
    for c, r in NULL_RATES.items()) + " FROM orders"

_any = " OR ".join(f"{c} IS NULL" for c in NULL_RATES)
_all = " AND ".join(f"{c} IS NULL" for c in NULL_RATES)


@query("null_profile", f"""WITH o AS ({ORDERS_NULLED_SQL})
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN {_any} THEN 1 ELSE 0 END) AS BIGINT) AS n_any_null,
       CAST(sum(CASE WHEN {_all} THEN 1 ELSE 0 END) AS BIGINT) AS n_all_null,
       count(*) - CAST(sum(CASE WHEN {_any} THEN 1 ELSE 0 END) AS BIGINT) AS n_after_drop_any,
       count(*) - CAST(sum(CASE WHEN {_all} THEN 1 ELSE 0 END) AS BIGINT) AS n_after_drop_all
FROM o""")
def null_profile_q(spark, sf):
    return finalize(null_profile(orders_with_nulls(spark, sf), list(NULL_RATES)))


_sparse = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS n_rows,
        round(1.0 - count({c}) / count(*), 6) AS null_share,
        count({c}) >= count(*) * 0.5 AS keep_half,
        1.0 - count({c}) / count(*) < 0.8 AS keep_null80 FROM o""" for c in NULL_RATES)


@query("drop_sparse_columns", f"WITH o AS ({ORDERS_NULLED_SQL}) {_sparse}")
def drop_sparse_columns_q(spark, sf):
    return finalize(column_null_profile(orders_with_nulls(spark, sf), list(NULL_RATES)))


@query("drop_null_rows", f"""WITH o AS ({ORDERS_NULLED_SQL})
SELECT 'any' AS rule, o_orderkey FROM o WHERE NOT ({_any}) UNION ALL SELECT 'all', o_orderkey FROM o WHERE NOT ({_all})""")
def drop_null_rows_q(spark, sf):
    """The rows left after dropping those with any null (B4) and those with nulls
    only (B5)."""
    o = orders_with_nulls(spark, sf)
    parts = [drop_null_rows(o, how, list(NULL_RATES)).select(F.lit(how).alias("rule"), "o_orderkey") for how in ("any", "all")]
    return finalize(parts[0].unionByName(parts[1]))


_KEPT = [c for c, r in NULL_RATES.items() if r <= 8]


@query("keep_dense_columns", f"""WITH o AS ({ORDERS_NULLED_SQL}),
k AS (SELECT {', '.join(f'count({c}) >= count(*) * 0.5 AS keep_{c}' for c in NULL_RATES)} FROM o)
SELECT o_orderkey, {', '.join(_KEPT)} FROM o, k WHERE {' AND '.join(f'keep_{c}' if c in _KEPT else f'NOT keep_{c}' for c in NULL_RATES)}""")
def keep_dense_columns(spark, sf):
    """The table without the columns that are more than half empty."""
    return finalize(drop_sparse_columns(orders_with_nulls(spark, sf), list(NULL_RATES)))
