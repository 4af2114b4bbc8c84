"""Join queries: null-safe merges, merge chains, FK flattening, cell melt,
referential integrity, union of join results (C1-C5, A10, E8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import finalize
from relweave.operators.clean import rename
from relweave.operators.joins import fk_shares, flatten, merge_chain, merge_nullsafe, union_results
from relweave.plans.q_clean import _sql_hex, hex_digit
from relweave.plans.registry import query
from relweave.sources.tables import read_table, tables


def _null_key(df, col, tag, rate, by):
    return df.withColumn(col, F.when(hex_digit(F.lit("nk"), F.lit(tag), F.col(by).cast("string")) < rate,
                                     F.lit(None)).otherwise(F.col(col)))


_CN = f"""SELECT c_custkey, c_name, CASE WHEN {_sql_hex("'nk'", "'c'", 'CAST(c_custkey AS VARCHAR)')} < 3
          THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer"""
_NN = f"""SELECT CASE WHEN {_sql_hex("'nk'", "'n'", 'CAST(n_nationkey AS VARCHAR)')} < 3
          THEN NULL ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM nation"""


@query("merge_keys_nullsafe", f"""SELECT c.c_custkey, c.c_nationkey, c.c_name, n.n_name, n.n_regionkey
FROM ({_CN}) c LEFT JOIN ({_NN}) n ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey""")
def merge_keys_nullsafe(spark, sf):
    """Customers and nations, each with md5-chosen missing keys; a missing key
    matches a missing key, as in pandas (C1)."""
    c, n = tables(spark, sf, "customer", "nation")
    c = _null_key(c.select("c_custkey", "c_name", "c_nationkey"), "c_nationkey", "c", 3, "c_custkey")
    n = _null_key(n.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", "n", 3, "n_nationkey")
    return finalize(merge_nullsafe(c, n, "c_nationkey", "n_nationkey", "left"))


@query("merge_outer_suffix", """SELECT coalesce(c.c_custkey, s.s_suppkey) AS id,
       c.c_name AS name_x, c.c_nationkey AS nationkey_x, c.c_acctbal AS acctbal_x, c.c_mktsegment AS mktsegment,
       s.s_name AS name_y, s.s_nationkey AS nationkey_y, s.s_acctbal AS acctbal_y
FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey IS NOT DISTINCT FROM s.s_suppkey""")
def merge_outer_suffix(spark, sf):
    """Customer and supplier renamed to shared names (B3), full outer merge on
    id: clashing columns get _x/_y, the key is coalesced (C1)."""
    c, s = tables(spark, sf, "customer", "supplier")
    c = rename(c, {"c_custkey": "id", "c_name": "name", "c_nationkey": "nationkey",
                   "c_acctbal": "acctbal", "c_mktsegment": "mktsegment"})
    s = rename(s, {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nationkey", "s_acctbal": "acctbal"})
    return finalize(merge_nullsafe(c, s, "id", "id", "full_outer", heavy=True))


STAR_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "c_name", "c_mktsegment",
             "n_name", "r_name"]


@query("star_merge_chain", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
       l.l_extendedprice, o.o_custkey, o.o_orderstatus, o.o_totalprice,
       CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, c.c_name, c.c_mktsegment, n.n_name, r.r_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def star_merge_chain(spark, sf):
    """Five-table inner merge chain to one wide table (C2). Inner joins are
    associative, so the dimensions are merged first (small, broadcast by AQE
    when their measured size allows) and the two large tables meet once."""
    l, o, c, n, r = tables(spark, sf, "lineitem", "orders", "customer", "nation", "region")
    dims = merge_chain(c.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
                       [(n.select("n_nationkey", "n_name", "n_regionkey"), "c_nationkey", "n_nationkey"),
                        (r.select("r_regionkey", "r_name"), "n_regionkey", "r_regionkey")])
    od = merge_nullsafe(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
                        dims, "o_custkey", "c_custkey")
    out = merge_nullsafe(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                  "l_extendedprice"), od, "l_orderkey", "o_orderkey")
    out = out.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    return finalize(out.select(*STAR_COLS))


STAR_EDGES = [
    dict(child="lineitem", child_col="l_orderkey", parent="orders", parent_col="o_orderkey", how="inner"),
    dict(child="lineitem", child_col="l_partkey", parent="part", parent_col="p_partkey", how="left"),
    dict(child="lineitem", child_col="l_suppkey", parent="supplier", parent_col="s_suppkey", how="left"),
    dict(child="orders", child_col="o_custkey", parent="customer", parent_col="c_custkey", how="inner"),
    dict(child="customer", child_col="c_nationkey", parent="nation", parent_col="n_nationkey", how="left"),
    dict(child="nation", child_col="n_regionkey", parent="region", parent_col="r_regionkey", how="left"),
]
FLAT_COLS = ["lineitem_l_orderkey", "lineitem_l_linenumber", "lineitem_l_quantity", "orders_o_totalprice",
             "orders_o_orderstatus", "part_p_name", "supplier_s_name", "customer_c_name", "nation_n_name",
             "region_r_name"]
_FLAT_SQL = """SELECT l.l_orderkey AS lineitem_l_orderkey, l.l_linenumber AS lineitem_l_linenumber,
       l.l_quantity AS lineitem_l_quantity, o.o_totalprice AS orders_o_totalprice,
       o.o_orderstatus AS orders_o_orderstatus, p.p_name AS part_p_name, s.s_name AS supplier_s_name,
       c.c_name AS customer_c_name, n.n_name AS nation_n_name, r.r_name AS region_r_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _star_tables(spark, sf):
    names = ["lineitem", "orders", "part", "supplier", "customer", "nation", "region"]
    return dict(zip(names, tables(spark, sf, *names)))


@query("flatten_by_fk", _FLAT_SQL)
def flatten_by_fk(spark, sf):
    """Generic FK flatten from the lineitem root, INNER and LEFT edges."""
    return finalize(flatten(_star_tables(spark, sf), STAR_EDGES, "lineitem").select(*FLAT_COLS))


@query("flatten_limit50", _FLAT_SQL + " ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in FLAT_COLS)
       + " LIMIT 50")
def flatten_limit50(spark, sf):
    """The reference's LIMIT 50 on a flatten, made deterministic by ordering on
    every output column (C3, E8); planned as a distributed top-k."""
    f = flatten(_star_tables(spark, sf), STAR_EDGES, "lineitem").select(*FLAT_COLS)
    return finalize(f.orderBy(*[F.col(c).asc_nulls_first() for c in FLAT_COLS]).limit(50))


ROLE_EDGES = [
    dict(child="lineitem", child_col="l_suppkey", parent="supplier", parent_col="s_suppkey", how="inner"),
    dict(child="supplier", child_col="s_nationkey", parent="nation", parent_col="n_nationkey", how="inner",
         alias="supp_nation"),
    dict(child="lineitem", child_col="l_orderkey", parent="orders", parent_col="o_orderkey", how="inner"),
    dict(child="orders", child_col="o_custkey", parent="customer", parent_col="c_custkey", how="inner"),
    dict(child="customer", child_col="c_nationkey", parent="nation", parent_col="n_nationkey", how="inner",
         alias="cust_nation"),
]


@query("flatten_two_roles", """SELECT l.l_orderkey AS lineitem_l_orderkey, l.l_linenumber AS lineitem_l_linenumber,
       s.s_name AS supplier_s_name, sn.n_name AS supp_nation_n_name, c.c_name AS customer_c_name,
       cn.n_name AS cust_nation_n_name, sn.n_nationkey = cn.n_nationkey AS same_nation
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey""")
def flatten_two_roles(spark, sf):
    """nation joined twice, as the supplier's and the customer's."""
    f = flatten(_star_tables(spark, sf), ROLE_EDGES, "lineitem")
    return finalize(f.select("lineitem_l_orderkey", "lineitem_l_linenumber", "supplier_s_name",
                             "supp_nation_n_name", "customer_c_name", "cust_nation_n_name",
                             (F.col("supp_nation_n_nationkey") == F.col("cust_nation_n_nationkey"))
                             .alias("same_nation")))


CHILD_EDGES = [
    {"child": "nation", "child_col": "n_regionkey", "parent": "region", "parent_col": "r_regionkey", "reverse": True},
    {"child": "customer", "child_col": "c_nationkey", "parent": "nation", "parent_col": "n_nationkey", "reverse": True},
    {"child": "orders", "child_col": "o_custkey", "parent": "customer", "parent_col": "c_custkey", "reverse": True},
]


@query("flatten_children", """SELECT r_regionkey, r_name, n_name, c_custkey, o_orderkey, o_totalprice FROM region
LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey""")
def flatten_children(spark, sf):
    """Child tables LEFT-joined from the parent down."""
    t = {n: read_table(spark, sf, n) for n in ("region", "nation", "customer", "orders")}
    f = flatten(t, CHILD_EDGES, "region")
    return finalize(f.select(*[F.col(f"{tb}_{c}").alias(c) for tb, c in (("region", "r_regionkey"), ("region", "r_name"), ("nation", "n_name"),
                                                                        ("customer", "c_custkey"), ("orders", "o_orderkey"), ("orders", "o_totalprice"))]))


MELT = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"),
        ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")]
_MELT_COLS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
              "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
              "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
              "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
              "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
              "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                           "l_returnflag", "l_linestatus", "l_shipdate"]}


def melt(df, table: str, pk: str):
    """All cells of a table as (table_name, row_key, column_name, value) strings,
    nulls dropped (A10). Cast before the unpivot so one scan feeds it."""
    cols = df.columns
    s = df.select(F.lit(table).alias("table_name"), F.col(pk).cast("string").alias("row_key"),
                  *[F.col(c).cast("string").alias(c) for c in cols])
    return (s.unpivot(["table_name", "row_key"], cols, "column_name", "value")
            .filter(F.col("value").isNotNull()))


@query("db_cells_melt", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({pk} AS VARCHAR) AS row_key, '{c}' AS column_name, "
    f"CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL"
    for t, pk in MELT for c in _MELT_COLS[t]))
def db_cells_melt(spark, sf):
    return finalize(union_results([melt(read_table(spark, sf, t), t, pk) for t, pk in MELT]))


FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
       ("nation", "n_regionkey", "region", "r_regionkey")]
BROKEN = ["l_orderkey", "l_partkey", "l_suppkey"]


def broken_lineitem(spark, sf):
    """lineitem with 1/16 of each FK value moved outside every parent key."""
    l = read_table(spark, sf, "lineitem")
    ident = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return l.select(*[F.when(hex_digit(F.lit("ri"), F.lit(c), *ident) < 1, -F.col(c) - 1)
                      .otherwise(F.col(c)).alias(c) for c in BROKEN])


_BROKEN_SQL = "SELECT " + ", ".join(
    f"CASE WHEN {_sql_hex(repr('ri'), repr(c), *[f'CAST({x} AS VARCHAR)' for x in ('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')])} < 1 "
    f"THEN -{c} - 1 ELSE {c} END AS {c}" for c in BROKEN) + " FROM lineitem"


def _ri_sql():
    per = []
    for ct, cc, pt, pc in FKS:
        src = "bl" if ct == "lineitem" else ct
        per.append(f"""SELECT '{ct}.{cc}->{pt}.{pc}' AS fk, count(*) AS n_child,
            count(*) FILTER (WHERE {cc} IN (SELECT {pc} FROM {pt})) AS n_matched
            FROM {src} WHERE {cc} IS NOT NULL""")
    u = " UNION ALL ".join(per)
    return f"""WITH bl AS ({_BROKEN_SQL}),
per AS (SELECT fk, n_child, n_matched, CASE WHEN n_child = 0 THEN 1.0 ELSE n_matched / n_child END AS share
        FROM ({u}) x)
SELECT fk, CAST(n_child AS BIGINT) AS n_child, CAST(n_matched AS BIGINT) AS n_matched, round(share, 6) AS share FROM per
UNION ALL
SELECT 'overall', CAST(sum(n_child) AS BIGINT), CAST(sum(n_matched) AS BIGINT), round(avg(share), 6) FROM per"""


@query("referential_integrity", _ri_sql())
def referential_integrity(spark, sf):
    """Matched share per FK and the mean over FKs (C5, D13), lineitem keys
    broken by md5. The overall row comes from a rollup over the per-FK rows."""
    t = {n: read_table(spark, sf, n) for n in ("orders", "part", "supplier", "customer", "nation", "region")}
    t["lineitem"] = broken_lineitem(spark, sf)
    per = fk_shares(t, FKS)
    r = per.rollup("fk").agg(F.sum("n_child").alias("n_child"), F.sum("n_matched").alias("n_matched"),
                             F.avg("share").alias("share"), F.grouping_id().alias("_g"))
    return finalize(r.select(F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.col("fk")).alias("fk"),
                             "n_child", "n_matched", "share"))


@query("union_join_results", """SELECT 'q1' AS query, o.o_orderkey, o.o_totalprice, c.c_name, NULL::VARCHAR AS n_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL
SELECT 'q2', o.o_orderkey, NULL::DOUBLE, c.c_name, n.n_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def union_join_results(spark, sf):
    """Two join queries with different output columns, unioned by name (C4)."""
    o, c, n = tables(spark, sf, "orders", "customer", "nation")
    q1 = (o.join(c, o.o_custkey == c.c_custkey)
          .select(F.lit("q1").alias("query"), "o_orderkey", "o_totalprice", "c_name"))
    q2 = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
          .select(F.lit("q2").alias("query"), "o_orderkey", "c_name", "n_name"))
    return finalize(union_results([q1, q2]))
