"""Inputs shared by the registered queries, derived from the test tables, and
the matching SQL fragments used by the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators.dataset import batch_entries, entry_truth, render_rows, truth_long
from relweave.sources.tables import tables

# Columns rendered for a customer profile (key c_custkey is not rendered).
CUST_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name", "r_name"]
BATCH = 5
SEED = 42


def customer_profile(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> nation -> region, inner, one row per customer. The two
    dimensions are small; AQE broadcasts them when their measured size is under
    the threshold and falls back to a shuffle join otherwise."""
    c, n, r = tables(spark, sf, "customer", "nation", "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", *CUST_COLS)
            .withColumn("domain", F.lower("c_mktsegment")))


def rendered(spark, sf) -> DataFrame:
    return render_rows(customer_profile(spark, sf), "c_custkey", CUST_COLS)


def entries(spark, sf) -> DataFrame:
    return batch_entries(rendered(spark, sf), "c_custkey", CUST_COLS, BATCH)


def truth(spark, sf) -> DataFrame:
    """(entry_id, attr, row_id, value, c_custkey, col_pos) ground truth."""
    return entry_truth(truth_long(customer_profile(spark, sf), "c_custkey", CUST_COLS),
                       "c_custkey", BATCH)


# ---------------------------------------------------------------- SQL side

def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_render_value(c: str) -> str:
    s = sql_strip(f"CAST({c} AS VARCHAR)")
    return (f"CASE WHEN {c} IS NULL OR lower({s}) = 'nan' THEN NULL "
            f"ELSE lower(regexp_replace({s}, '^''+|''+$', '', 'g')) END")


def sql_sentence(cols: list[str]) -> str:
    parts = ", ".join(f"'{c.lower()} is ' || {sql_render_value(c)}" for c in cols)
    return f"regexp_replace(concat_ws(', ', {parts}) || ', ', '[, ]+$', '') || '.'"


def sql_truth_value(c: str) -> str:
    s = f"lower(CAST({c} AS VARCHAR))"
    return f"CASE WHEN {c} IS NULL OR {s} = 'nan' THEN NULL ELSE {s} END"


PROFILE_SQL = """SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
       n.n_name, r.r_name, lower(c.c_mktsegment) AS domain
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""

_attrs = ", ".join(f"CASE WHEN {sql_render_value(c)} IS NOT NULL THEN '{c}' END" for c in CUST_COLS)

RENDERED_SQL = f"""SELECT *, {sql_sentence(CUST_COLS)} AS sentence,
       CAST(floor(c_custkey / {BATCH}) AS BIGINT) AS entry_id,
       list_filter([{_attrs}], lambda x: x IS NOT NULL) AS attrs
FROM ({PROFILE_SQL}) p"""

ENTRIES_SQL = f"""SELECT entry_id, string_agg(sentence, chr(10) ORDER BY c_custkey) AS text,
       count(*) AS n_rows, arg_min(domain, c_custkey) AS domain,
       array_to_string(list_sort(list_distinct(flatten(list(attrs)))), ',') AS entities,
       CAST(sum(len(attrs)) AS BIGINT) AS n_pairs
FROM ({RENDERED_SQL}) r GROUP BY entry_id"""

_truth_rows = " UNION ALL ".join(
    f"SELECT c_custkey, '{c}' AS attr, {i} AS col_pos, {sql_truth_value(c)} AS value FROM p"
    for i, c in enumerate(CUST_COLS))

TRUTH_SQL = f"""WITH p AS ({PROFILE_SQL}),
tl AS (SELECT * FROM ({_truth_rows}) x WHERE value IS NOT NULL)
SELECT *, CAST(floor(c_custkey / {BATCH}) AS BIGINT) AS entry_id,
       CAST(row_number() OVER (PARTITION BY floor(c_custkey / {BATCH}), attr ORDER BY c_custkey) AS VARCHAR) AS row_id
FROM tl"""

FACTS_SQL = f"""WITH e AS ({ENTRIES_SQL}),
l AS (SELECT e.entry_id, u.line, u.o - 1 AS line_pos
      FROM e, unnest(string_split(e.text, chr(10))) WITH ORDINALITY AS u(line, o)),
i AS (SELECT l.entry_id, l.line_pos, v.item, v.o - 1 AS fact_pos
      FROM l, unnest(string_split(regexp_replace({sql_strip('l.line')}, '\\.$', ''), ', '))
           WITH ORDINALITY AS v(item, o))
SELECT entry_id, CAST(line_pos AS BIGINT) AS line_pos, CAST(fact_pos AS BIGINT) AS fact_pos,
       substr(item, 1, instr(item, ' is ') - 1) AS attr,
       substr(item, instr(item, ' is ') + 4) AS value
FROM i WHERE instr(item, ' is ') > 0"""
