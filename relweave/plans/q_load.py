"""Typed load under key rules with rejects kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from relweave.functions.text import finalize
from relweave.operators.joins import union_results
from relweave.plans.q_clean import _sql_hex, hex_digit
from relweave.plans.registry import query
from relweave.sources.tables import read_table

ENTRY_ROWS = 5
PK = ["l_orderkey", "l_linenumber"]
SEQ = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag",
       "l_linestatus", "l_shipdate"]


def first_wins(df, pk: list[str], seq: list[str], cols: list[str]):
    """Duplicate keys: the first row by ``seq`` wins (I5). A grouped ``min`` of
    a struct -- partial aggregation on the map side, so a hot key is reduced
    before the shuffle -- instead of a window over the whole key group."""
    agg = df.groupBy(*pk).agg(F.min(F.struct(*seq, *[c for c in cols if c not in seq])).alias("_r"),
                              F.count(F.lit(1)).alias("n_dups"))
    return agg.select(*pk, *[F.col("_r")[c].alias(c) for c in cols], "n_dups")


@query("pk_first_wins", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, n_dups FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(SEQ)}) AS rn,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_dups FROM lineitem) x WHERE rn = 1""")
def pk_first_wins(spark, sf):
    l = read_table(spark, sf, "lineitem")
    return finalize(first_wins(l, PK, SEQ, ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]))


NULLED = {"l_quantity": 4, "l_discount": 4, "l_returnflag": 4}
_IDENT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def merge_non_null(df, pk: list[str], seq: list[str], cols: list[str]):
    """Rows with equal key merged: per column the first non-null by ``seq``
    (D1); ``min_by`` with a NULL ordering for NULL cells skips them."""
    order = F.struct(*seq)
    return df.groupBy(*pk).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


@query("pk_merge_non_null", "WITH l AS (SELECT " + ", ".join(SEQ + ["l_orderkey", "l_linenumber"]) + ", " + ", ".join(
    f"CASE WHEN {_sql_hex(repr('nl'), repr(c), *[f'CAST({x} AS VARCHAR)' for x in _IDENT])} < {r} THEN NULL ELSE {c} END AS n_{c}"
    for c, r in NULLED.items()) + f""" FROM lineitem)
SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"first(n_{c} ORDER BY {', '.join(SEQ)}) FILTER (WHERE n_{c} IS NOT NULL) AS {c}" for c in NULLED)
    + " FROM l GROUP BY l_orderkey, l_linenumber")
def pk_merge_non_null(spark, sf):
    l = read_table(spark, sf, "lineitem")
    ident = [F.col(c).cast("string") for c in _IDENT]
    l = l.select(*PK, *SEQ, *[F.when(hex_digit(F.lit("nl"), F.lit(c), *ident) < r, F.lit(None)).otherwise(F.col(c))
                              .alias(f"n_{c}") for c, r in NULLED.items()])
    m = merge_non_null(l, PK, SEQ, [f"n_{c}" for c in NULLED])
    return finalize(m.select(*PK, *[F.col(f"n_{c}").alias(c) for c in NULLED]))


# Catalog of the loaded table: column -> (SQL type, part of the primary key).
ORDERS_CATALOG = [("o_orderkey", "INTEGER", True), ("o_custkey", "INTEGER", False), ("o_totalprice", "REAL", False),
                  ("o_orderdate", "DATE", False), ("o_urgent", "BOOLEAN", False), ("o_orderstatus", "TEXT", False)]
# SQL types and what they load as (B14); any other type loads as text.
SPARK_TYPE = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "DECIMAL": "double", "NUMERIC": "double",
              "DATE": "date"}


def runtime_type(sql_type: str) -> str:
    """Type name without its size, as the type it loads as; ``string`` if unknown."""
    return SPARK_TYPE.get(sql_type.split("(")[0].strip().upper(), "string")


def raw_orders(spark, sf):
    """Orders as extracted text cells, with md5-chosen defects: duplicate,
    non-integer and missing keys; ``#``, ``?``, junk, quoted booleans."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    d = lambda tag: hex_digit(F.lit(tag), k)
    pk = (F.when(d("pk") == 0, (F.col("o_orderkey") - 1).cast("string")).when(d("pk") == 1, F.concat(F.lit("k"), k))
          .when(d("pk") == 2, F.lit(None)).otherwise(k))
    cust = (F.when(d("ck") == 0, "#").when(d("ck") == 1, "?")
            .when(d("ck") == 2, F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
            .otherwise(F.col("o_custkey").cast("string")))
    price = F.when(d("tp") == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit(" USD"))) \
        .otherwise(F.col("o_totalprice").cast("string"))
    date = F.when(d("od") == 0, "unknown").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "True").otherwise("False")
    urg = (F.when(d("ug") == 0, "maybe").when(d("ug") == 1, F.concat(F.lit("'"), urgent, F.lit("'"))).otherwise(urgent))
    return o.select(F.col("o_orderkey").alias("seq"), pk.alias("o_orderkey"), cust.alias("o_custkey"),
                    price.alias("o_totalprice"), date.alias("o_orderdate"), urg.alias("o_urgent"), "o_orderstatus")


def clean_cell(c):
    """Whole-value cleanup: trim, strip outer quotes, ``?`` -> ``#`` -> NULL."""
    t = F.regexp_replace(F.trim(c), r"^['\"]+|['\"]+$", "")
    return F.when(t.isin("#", "?"), F.lit(None)).otherwise(t)


def parse_bool(c):
    """BOOLEAN parsed properly (Q4 fixed): true/false/1/0/yes/no, else NULL."""
    lc = F.lower(c)
    return F.when(lc.isin("true", "1", "yes"), True).when(lc.isin("false", "0", "no"), False)


def typed_load(raw, catalog=ORDERS_CATALOG, seq="seq", keep=()):
    """All rows of ``raw`` with their cells cleaned and typed by ``catalog``, and
    ``reasons``: why a row or a cell is refused. One scan and one join.

    A row is refused when a key column is missing (``pk_null``) or does not fit its
    type (``pk_not_integer``), or when an earlier row by ``seq`` has the same key
    (``duplicate_pk``); the key may have several columns. In a row that loads, a
    cell that does not fit its type becomes NULL with ``cast_failed:<column>``.
    Without key columns no row is refused."""
    pk = [c for c, _, p in catalog if p]
    x = raw.select(seq, *keep, *[clean_cell(F.col(c)).alias(f"raw_{c}") for c, _, _ in catalog])
    for c, t, _ in catalog:
        x = x.withColumn(c, parse_bool(F.col(f"raw_{c}")) if t == "BOOLEAN" else F.col(f"raw_{c}").try_cast(runtime_type(t)))
    refused = F.lit(None).cast("string")
    if pk:
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk])
        # grouped minimum with map-side combine: a hot key is one row per task
        first = x.filter(whole).groupBy(*pk).agg(F.min(seq).alias("_first"))
        x = x.join(first, pk, "left")
        missing = reduce(lambda a, b: a | b, [F.col(f"raw_{c}").isNull() for c in pk])
        refused = F.when(missing, "pk_null").when(~whole, "pk_not_integer").when(F.col(seq) != F.col("_first"), "duplicate_pk")
    failed = F.array_compact(F.array(*[F.when(F.col(f"raw_{c}").isNotNull() & F.col(c).isNull(), F.lit(f"cast_failed:{c}"))
                                       for c, _, p in catalog if not p]))
    x = x.withColumn("refused", refused)
    reasons = F.when(F.col("refused").isNotNull(), F.array("refused")).otherwise(failed)
    return x.select(seq, *keep, *[c for c, _, _ in catalog], "refused", reasons.alias("reasons"))


def load_tables(raw, catalogs: dict, table="table_name", seq="seq"):
    """Rows of several tables in one frame: each table is typed by its own catalog,
    rows of unknown tables are refused (``unknown_table``). Returns {table: frame}
    and the refused rows as (seq, table_name, reason)."""
    out, bad = {}, [raw.filter(~F.col(table).isin(list(catalogs)) | F.col(table).isNull())
                    .select(seq, F.col(table).alias("table_name"), F.lit("unknown_table").alias("reason"))]
    for name, catalog in catalogs.items():
        t = typed_load(raw.filter(F.col(table) == name), catalog, seq)
        out[name] = t.filter(F.col("refused").isNull()).drop("refused", "reasons")
        bad.append(t.select(seq, F.lit(name).alias("table_name"), F.explode("reasons").alias("reason")))
    return out, union_results(bad)


def _raw_sql() -> str:
    d = lambda tag: _sql_hex(repr(tag), "CAST(o_orderkey AS VARCHAR)")
    urgent = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END"
    return f"""SELECT o_orderkey AS seq,
  CASE WHEN {d('pk')} = 0 THEN CAST(o_orderkey - 1 AS VARCHAR) WHEN {d('pk')} = 1 THEN 'k' || CAST(o_orderkey AS VARCHAR)
       WHEN {d('pk')} = 2 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS r_pk,
  CASE WHEN {d('ck')} = 0 THEN '#' WHEN {d('ck')} = 1 THEN '?' WHEN {d('ck')} = 2 THEN 'x' || CAST(o_custkey AS VARCHAR)
       ELSE CAST(o_custkey AS VARCHAR) END AS r_cust,
  CASE WHEN {d('tp')} = 0 THEN CAST(o_totalprice AS VARCHAR) || ' USD' ELSE CAST(o_totalprice AS VARCHAR) END AS r_price,
  CASE WHEN {d('od')} = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS r_date,
  CASE WHEN {d('ug')} = 0 THEN 'maybe' WHEN {d('ug')} = 1 THEN '''' || {urgent} || '''' ELSE {urgent} END AS r_urg, o_orderstatus AS r_status
FROM orders"""


def _clean_sql(c: str) -> str:
    t = f"regexp_replace(trim({c}), '^[''\"]+|[''\"]+$', '', 'g')"
    return f"CASE WHEN {t} IN ('#', '?') THEN NULL ELSE {t} END"


LOAD_SQL = f"""WITH raw AS ({_raw_sql()}),
c AS (SELECT seq, {_clean_sql('r_pk')} AS raw_pk, {_clean_sql('r_cust')} AS raw_cust, {_clean_sql('r_price')} AS raw_price,
             {_clean_sql('r_date')} AS raw_date, {_clean_sql('r_urg')} AS raw_urg, {_clean_sql('r_status')} AS raw_status FROM raw),
t AS (SELECT *, CASE WHEN regexp_matches(raw_pk, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(raw_pk AS BIGINT) END AS pk,
             CASE WHEN regexp_matches(raw_cust, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(raw_cust AS BIGINT) END AS cust,
             TRY_CAST(raw_price AS DOUBLE) AS price, TRY_CAST(raw_date AS DATE) AS dt,
             CASE WHEN lower(raw_urg) IN ('true', '1', 'yes') THEN true
                  WHEN lower(raw_urg) IN ('false', '0', 'no') THEN false END AS urg FROM c),
f AS (SELECT pk, min(seq) AS first FROM t WHERE pk IS NOT NULL GROUP BY pk),
r AS (SELECT t.*, CASE WHEN raw_pk IS NULL THEN 'pk_null' WHEN t.pk IS NULL THEN 'pk_not_integer'
                       WHEN t.seq <> f.first THEN 'duplicate_pk' END AS reason
      FROM t LEFT JOIN f ON f.pk = t.pk),
loaded AS (SELECT * FROM r WHERE reason IS NULL),
rej AS (SELECT seq, reason FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT seq, 'cast_failed:o_custkey' FROM loaded WHERE raw_cust IS NOT NULL AND cust IS NULL
  UNION ALL SELECT seq, 'cast_failed:o_totalprice' FROM loaded WHERE raw_price IS NOT NULL AND price IS NULL
  UNION ALL SELECT seq, 'cast_failed:o_orderdate' FROM loaded WHERE raw_date IS NOT NULL AND dt IS NULL
  UNION ALL SELECT seq, 'cast_failed:o_urgent' FROM loaded WHERE raw_urg IS NOT NULL AND urg IS NULL)"""


@query("typed_load_rejects", LOAD_SQL + " SELECT seq, reason FROM rej")
def typed_load_rejects(spark, sf):
    """Refused rows and cells with the reason."""
    x = typed_load(raw_orders(spark, sf))
    return finalize(x.select("seq", F.explode("reasons").alias("reason")))


@query("typed_load_rows", LOAD_SQL + """
SELECT seq, pk AS o_orderkey, cust AS o_custkey, round(price, 6) AS o_totalprice, strftime(dt, '%Y-%m-%d') AS o_orderdate, urg AS o_urgent, raw_status AS o_orderstatus
FROM loaded""")
def typed_load_rows(spark, sf):
    """The loaded table itself: typed cells of the rows that load."""
    x = typed_load(raw_orders(spark, sf)).filter(F.col("refused").isNull())
    return finalize(x.select("seq", "o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                             "o_urgent", "o_orderstatus"))


LINE_CATALOG = [("l_orderkey", "INTEGER", True), ("l_linenumber", "INTEGER", True), ("l_quantity", "DECIMAL(15,2)", False), ("l_shipmode", "VARCHAR(10)", False)]


@query("typed_load_composite", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_partkey || '|' || l_suppkey || '|' || CAST(l_extendedprice AS VARCHAR)
             || '|' || CAST(l_quantity AS VARCHAR) || '|' || CAST(l_discount AS VARCHAR) || '|' || CAST(l_tax AS VARCHAR) AS seq FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, min(seq) AS first FROM l GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, count(*) AS n_in, count(*) FILTER (WHERE l.seq = f.first) AS n_loaded,
       count(*) FILTER (WHERE l.seq <> f.first) AS n_duplicate
FROM l JOIN f ON f.l_orderkey = l.l_orderkey AND f.l_linenumber = l.l_linenumber GROUP BY l.l_orderkey, l.l_linenumber""")
def typed_load_composite(spark, sf):
    """Rows in, loaded and refused per composite key (Q10): lineitem by order and
    line number, first row by its other cells."""
    l = read_table(spark, sf, "lineitem")
    seq = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")])
    raw = l.select(seq.alias("seq"), *[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")],
                   F.col("l_returnflag").alias("l_shipmode"))
    x = typed_load(raw, LINE_CATALOG)
    return finalize(x.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n_in"), F.count(F.when(F.col("refused").isNull(), 1)).alias("n_loaded"),
        F.count(F.when(F.col("refused") == "duplicate_pk", 1)).alias("n_duplicate")))


@query("load_validity", LOAD_SQL + f""",
e AS (SELECT seq, CAST(floor(seq / {ENTRY_ROWS}) AS BIGINT) AS entry_id FROM raw)
SELECT e.entry_id, count(DISTINCT e.seq) AS n_in, count(DISTINCT l.seq) AS n_loaded,
       count(DISTINCT x.seq) AS n_rejected, count(j.reason) FILTER (WHERE starts_with(j.reason, 'cast_failed')) AS n_cast_failed,
       count(j.reason) = 0 AS valid
FROM e LEFT JOIN loaded l ON l.seq = e.seq LEFT JOIN r x ON x.seq = e.seq AND x.reason IS NOT NULL
LEFT JOIN rej j ON j.seq = e.seq GROUP BY e.entry_id""")
def load_validity(spark, sf):
    """Load validity per entry (I7, D17): rows in, loaded and rejected, failed casts,
    and valid = nothing rejected; an entry is five consecutive rows."""
    x = typed_load(raw_orders(spark, sf)).withColumn("entry_id", F.floor(F.col("seq") / ENTRY_ROWS))
    rejected = F.col("refused").isNotNull()
    return finalize(x.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n_in"), F.count(F.when(~rejected, 1)).alias("n_loaded"), F.count(F.when(rejected, 1)).alias("n_rejected"),
        F.sum(F.when(rejected, 0).otherwise(F.size("reasons"))).alias("n_cast_failed"), (F.sum(F.size("reasons")) == 0).alias("valid")))
