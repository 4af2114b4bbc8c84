"""Schema as data.

The catalog is discovered from the facts extracted from every entry: one
schema per domain, column types from whether *all* values of an attribute
cast, a key column per table and FK columns between tables. md5 of the domain
picks one defect per domain (table without PK, FK to a non-key column, FK to
an unknown table, composite PK), so the checks have something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import finalize
from relweave.operators.extract import rule_extract, table_of
from relweave.plans import common as C
from relweave.plans import q_metrics as M
from relweave.plans.registry import query

TABLE_POS = {"customer": 0, "nation": 1, "region": 2}


def catalog(spark, sf):
    f = rule_extract(C.entries(spark, sf)).join(M.entry_domains(spark, sf), "entry_id")
    a = f.groupBy("domain", "attr").agg(
        F.min("fact_pos").alias("p"),
        F.min(F.col("value").try_cast("bigint").isNotNull().cast("int")).alias("all_int"),
        F.min(F.col("value").try_cast("double").isNotNull().cast("int")).alias("all_num"))
    tbl = F.lit(None).cast("string")
    for p, tn in M.PREFIX_TABLE.items():
        tbl = F.when(F.col("attr").startswith(p), F.lit(tn)).otherwise(tbl)
    k = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("cat|"), F.col("domain"))), 1, 1), 16, 10).cast("int"), F.lit(4))
    none = F.lit(None).cast("string")
    base = a.select("domain", tbl.alias("table_name"), F.struct(
        (F.col("p") + 1).cast("int").alias("col_pos"), F.col("attr").alias("column_name"),
        F.when(F.col("all_int") == 1, "INTEGER").when(F.col("all_num") == 1, "REAL").otherwise("TEXT").alias("sql_type"),
        ((k == 3) & (F.col("attr") == "c_name")).alias("is_pk"), F.lit(False).alias("is_fk"), none.alias("fk_table"), none.alias("fk_column")).alias("c"))
    # a table's columns, its key column before them and its foreign key after the last
    t = base.groupBy("domain", "table_name").agg(F.collect_list("c").alias("cols"), F.max("c.col_pos").alias("last"))
    cust = F.col("table_name") == "customer"

    def column(pos, name, pk, fk, fk_table, fk_column):
        return F.struct(pos.cast("int").alias("col_pos"), name.alias("column_name"), F.lit("INTEGER").alias("sql_type"), pk.alias("is_pk"),
                        F.lit(fk).alias("is_fk"), fk_table.alias("fk_table"), fk_column.alias("fk_column"))

    key = column(F.lit(0), F.concat("table_name", F.lit("_id")), ~((k == 0) & (F.col("table_name") == "region")), False, none, none)
    fk = column(F.col("last") + 1, F.when(cust, "nation_id").otherwise("region_id"), F.lit(False), True,
                F.when(cust, "nation").when(k == 2, "continent").otherwise("region"),
                F.when(cust, F.when(k == 1, "n_name").otherwise("nation_id")).otherwise("region_id"))
    fks = F.when(F.col("table_name").isin("customer", "nation"), F.array(fk)).otherwise(F.array().cast("array<struct<col_pos:int,column_name:string,sql_type:string,is_pk:boolean,is_fk:boolean,fk_table:string,fk_column:string>>"))
    cat = t.select("domain", "table_name", F.inline(F.concat("cols", F.array(key), fks)))
    tp = F.lit(None).cast("int")
    for tn, i in TABLE_POS.items():
        tp = F.when(F.col("table_name") == tn, F.lit(i)).otherwise(tp)
    return cat.withColumn("table_pos", tp)


CAT_COLS = ["domain", "table_pos", "table_name", "col_pos", "column_name", "sql_type", "is_pk", "is_fk",
            "fk_table", "fk_column"]

_TBL = "CASE " + " ".join(f"WHEN starts_with(attr, '{p}') THEN '{t}'" for p, t in M.PREFIX_TABLE.items()) + " END"
_TP = "CASE " + " ".join(f"WHEN table_name = '{t}' THEN {i}" for t, i in TABLE_POS.items()) + " END"
CATALOG_SQL = f"""f AS (SELECT x.*, e.domain FROM ({C.FACTS_SQL}) x JOIN ({M._ENT_SQL}) e ON e.entry_id = x.entry_id),
dk AS (SELECT DISTINCT domain, ('0x' || substr(md5('cat|' || domain), 1, 1))::INTEGER % 4 AS k FROM f),
a AS (SELECT domain, attr, min(fact_pos) AS p,
             min(CASE WHEN regexp_matches(value, '^\\s*[+-]?[0-9]+\\s*$') AND TRY_CAST(value AS BIGINT) IS NOT NULL THEN 1 ELSE 0 END) AS all_int,
             min(CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) AS all_num FROM f GROUP BY ALL),
base AS (SELECT a.domain, {_TBL} AS table_name, CAST(p + 1 AS INTEGER) AS col_pos, attr AS column_name,
                CASE WHEN all_int = 1 THEN 'INTEGER' WHEN all_num = 1 THEN 'REAL' ELSE 'TEXT' END AS sql_type,
                dk.k = 3 AND attr = 'c_name' AS is_pk, false AS is_fk, NULL::VARCHAR AS fk_table, NULL::VARCHAR AS fk_column
         FROM a JOIN dk ON dk.domain = a.domain),
tabs AS (SELECT b.domain, b.table_name, dk.k, max(b.col_pos) AS last FROM base b JOIN dk ON dk.domain = b.domain GROUP BY ALL),
cat0 AS (SELECT * FROM base
  UNION ALL SELECT domain, table_name, 0, table_name || '_id', 'INTEGER', NOT (k = 0 AND table_name = 'region'),
                   false, NULL, NULL FROM tabs
  UNION ALL SELECT domain, table_name, last + 1, CASE WHEN table_name = 'customer' THEN 'nation_id' ELSE 'region_id' END,
                   'INTEGER', false, true,
                   CASE WHEN table_name = 'customer' THEN 'nation' WHEN k = 2 THEN 'continent' ELSE 'region' END,
                   CASE WHEN table_name = 'customer' THEN (CASE WHEN k = 1 THEN 'n_name' ELSE 'nation_id' END)
                        ELSE 'region_id' END
            FROM tabs WHERE table_name IN ('customer', 'nation')),
cat AS (SELECT *, {_TP} AS table_pos FROM cat0)"""


@query("schema_discovery", f"WITH {CATALOG_SQL} SELECT {', '.join(CAT_COLS)} FROM cat")
def schema_discovery(spark, sf):
    """One schema per domain inferred from the extracted facts."""
    return finalize(catalog(spark, sf).select(*CAT_COLS))


def pk_coverage(cat):
    per_t = cat.groupBy("domain", "table_name").agg(F.max(F.col("is_pk").cast("int")).alias("has_pk"))
    return per_t.groupBy("domain").agg((F.avg("has_pk") * 100.0).alias("pk_coverage"))


@query("pk_coverage", f"""WITH {CATALOG_SQL},
t AS (SELECT domain, table_name, max(CASE WHEN is_pk THEN 1 ELSE 0 END) AS has_pk FROM cat GROUP BY ALL)
SELECT domain, round(avg(has_pk) * 100.0, 6) AS pk_coverage FROM t GROUP BY domain""")
def pk_coverage_q(spark, sf):
    """% of tables with a primary-key column, per domain."""
    return finalize(pk_coverage(catalog(spark, sf)))


def fk_validity(cat):
    fk = cat.filter("is_fk").select("domain", "table_name", "column_name", "fk_table", "fk_column")
    pk = cat.filter("is_pk").select("domain", F.col("table_name").alias("fk_table"),
                                    F.col("column_name").alias("fk_column"), F.lit(1).alias("ok")).distinct()
    j = fk.join(pk, ["domain", "fk_table", "fk_column"], "left")
    msg = F.when(F.col("ok").isNull(), F.concat_ws("", "table_name", F.lit("."), "column_name", F.lit(" -> "),
                                                   "fk_table", F.lit("."), "fk_column"))
    return j.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_fk"),
        (F.avg(F.coalesce("ok", F.lit(0)).cast("double")) * 100.0).alias("fk_validity"),
        F.array_join(F.array_sort(F.collect_list(msg)), "; ").alias("bad"))


_FK_SQL = f"""WITH {CATALOG_SQL},
fk AS (SELECT domain, table_name, column_name, fk_table, fk_column FROM cat WHERE is_fk),
pk AS (SELECT DISTINCT domain, table_name, column_name FROM cat WHERE is_pk),
j AS (SELECT fk.*, pk.column_name IS NOT NULL AS ok FROM fk LEFT JOIN pk
      ON pk.domain = fk.domain AND pk.table_name = fk.fk_table AND pk.column_name = fk.fk_column),
fv AS (SELECT domain, count(*) AS n_fk, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100.0 AS fk_validity,
       coalesce(string_agg(CASE WHEN NOT ok THEN table_name || '.' || column_name || ' -> ' || fk_table || '.' || fk_column END,
                           '; ' ORDER BY CASE WHEN NOT ok THEN table_name || '.' || column_name || ' -> ' || fk_table || '.' || fk_column END), '') AS bad
       FROM j GROUP BY domain)"""


@query("fk_validity", _FK_SQL + " SELECT domain, n_fk, round(fk_validity, 6) AS fk_validity, bad FROM fv")
def fk_validity_q(spark, sf):
    """% of FKs whose target is a PK column of the named table, with the bad
    ones listed (C6, D8)."""
    return finalize(fk_validity(catalog(spark, sf)))


@query("superkey", f"""WITH {CATALOG_SQL}
SELECT d.domain, s.superkey FROM (SELECT DISTINCT domain FROM cat) d LEFT JOIN (
  SELECT domain, arg_min(table_name || '.' || column_name, col_pos) AS superkey FROM cat
  WHERE is_pk AND table_pos = 0 GROUP BY domain) s ON s.domain = d.domain""")
def superkey(spark, sf):
    """First PK column of the first table, ``table.column``, else NULL."""
    cat = catalog(spark, sf)
    sk = cat.filter(F.col("is_pk") & (F.col("table_pos") == 0)).groupBy("domain").agg(
        F.min_by(F.concat_ws(".", "table_name", "column_name"), "col_pos").alias("superkey"))
    return finalize(cat.select("domain").distinct().join(sk, "domain", "left"))


@query("column_names", f"""WITH {CATALOG_SQL}
SELECT domain, table_name || '_' || column_name AS name, 'qualified' AS kind FROM cat
UNION ALL SELECT domain, column_name, 'bare' FROM cat""")
def column_names(spark, sf):
    """``table_col`` for every column, then bare names (H7)."""
    cat = catalog(spark, sf)
    return finalize(cat.select("domain", F.concat_ws("_", "table_name", "column_name").alias("name"),
                               F.lit("qualified").alias("kind"))
                    .unionByName(cat.select("domain", F.col("column_name").alias("name"), F.lit("bare").alias("kind"))))


@query("id_columns", f"""WITH {CATALOG_SQL}
SELECT c.domain, arg_min(table_name || '_' || column_name, (table_pos, col_pos)) AS first_col,
       arg_min(table_name || '_' || column_name, (table_pos, col_pos)) FILTER (WHERE suffix(lower(column_name), 'id'))
         AS first_id_col, any_value(r.first_row_col) AS first_row_col
FROM cat c LEFT JOIN (SELECT domain, arg_min({_TBL} || '_' || attr, (entry_id, line_pos, fact_pos)) AS first_row_col FROM f WHERE {_TBL} IS NOT NULL GROUP BY domain) r
  ON r.domain = c.domain GROUP BY c.domain""")
def id_columns(spark, sf):
    """First column of the first table, the first column ending in ``id`` across
    tables, and the first key of the first joined row, all as ``table_col`` (I2)."""
    cat = catalog(spark, sf)
    order = F.struct("table_pos", "col_pos")
    name = F.concat_ws("_", "table_name", "column_name")
    ids = cat.groupBy("domain").agg(
        F.min_by(name, order).alias("first_col"),
        F.min_by(name, F.when(F.lower("column_name").endswith("id"), order)).alias("first_id_col"))
    f = rule_extract(C.entries(spark, sf)).withColumn("t", table_of("attr", M.PREFIX_TABLE)).where(F.col("t").isNotNull()).join(M.entry_domains(spark, sf), "entry_id")
    row = f.groupBy("domain").agg(F.min_by(F.concat_ws("_", "t", "attr"), F.struct("entry_id", "line_pos", "fact_pos")).alias("first_row_col"))
    return finalize(ids.join(row, "domain", "left"))


@query("extraction_instructions", f"""WITH {CATALOG_SQL}
SELECT domain, table_name, 'Extract ' || table_name || ': ' || string_agg(column_name || ': ' || sql_type || CASE WHEN is_pk THEN ' PK' ELSE '' END
       || CASE WHEN is_fk THEN ' FK -> ' || fk_table || '(' || fk_column || ')' ELSE '' END, '; ' ORDER BY col_pos, column_name) AS instruction, count(*) AS n_columns
FROM cat WHERE table_name IS NOT NULL GROUP BY domain, table_name""")
def extraction_instructions(spark, sf):
    """One instruction text per table of a schema (I9): each column's type and its
    role as a key, in column order."""
    cat = catalog(spark, sf).where(F.col("table_name").isNotNull())
    keys = F.concat(F.when(F.col("is_pk"), " PK").otherwise(""), F.when(F.col("is_fk"), F.concat(F.lit(" FK -> "), "fk_table", F.lit("("), "fk_column", F.lit(")"))).otherwise(""))
    one = F.struct("col_pos", "column_name", F.concat("column_name", F.lit(": "), "sql_type", keys).alias("t"))
    g = cat.groupBy("domain", "table_name").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return finalize(g.select("domain", "table_name", F.concat(F.lit("Extract "), "table_name", F.lit(": "), F.array_join(F.col("c.t"), "; ")).alias("instruction"), F.size("c").alias("n_columns")))


@query("schema_score_summary", _FK_SQL + """,
t AS (SELECT domain, table_name, max(CASE WHEN is_pk THEN 1 ELSE 0 END) AS has_pk FROM cat GROUP BY ALL),
pc AS (SELECT domain, avg(has_pk) * 100.0 AS pk_coverage FROM t GROUP BY domain)
SELECT count(*) AS n_domains, round(avg(pc.pk_coverage), 6) AS mean_pk_coverage,
       round(avg(coalesce(fv.fk_validity, 0.0)), 6) AS mean_fk_validity
FROM pc LEFT JOIN fv ON fv.domain = pc.domain""")
def schema_score_summary(spark, sf):
    """Mean of the schema scores over domains, one schema per domain."""
    cat = catalog(spark, sf)
    j = pk_coverage(cat).join(fk_validity(cat), "domain", "left")
    return finalize(j.agg(F.count(F.lit(1)).alias("n_domains"), F.avg("pk_coverage").alias("mean_pk_coverage"),
                          F.avg(F.coalesce("fk_validity", F.lit(0.0))).alias("mean_fk_validity")))


def ddl_text(cat):
    """CREATE TABLE text per domain from the catalog: inline REFERENCES for the
    customer table, a table-level FOREIGN KEY line for the others, IF NOT
    EXISTS on region."""
    inline = F.col("is_fk") & (F.col("table_name") == "customer")
    coldef = F.concat_ws("", F.lit("  "), "column_name", F.lit(" "), "sql_type",
                         F.when(F.col("is_pk"), F.lit(" PRIMARY KEY")).otherwise(F.lit("")),
                         F.when(inline, F.concat(F.lit(" REFERENCES "), "fk_table", F.lit("("), "fk_column", F.lit(")")))
                         .otherwise(F.lit("")))
    tl = F.when(F.col("is_fk") & ~inline, F.concat(F.lit("  FOREIGN KEY ("), "column_name", F.lit(") REFERENCES "),
                                                    "fk_table", F.lit("("), "fk_column", F.lit(")")))
    per_t = cat.groupBy("domain", "table_pos", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("col_pos", coldef.alias("d")))).alias("cols"),
        F.array_sort(F.collect_list(tl)).alias("tls"))
    one_line = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("ddl|"), F.col("domain"))), 1, 1), 16, 10).cast("int"), F.lit(2)) == 0
    parts = F.concat(F.transform("cols", lambda x: x["d"]), F.col("tls"))
    body = F.when(one_line, F.array_join(F.transform(parts, lambda x: F.trim(x)), ", ")).otherwise(F.array_join(parts, ",\n"))
    head = F.when(F.col("table_name") == "region", "CREATE TABLE IF NOT EXISTS ").otherwise("CREATE TABLE ")
    t = per_t.select("domain", "table_pos", F.concat(head, "table_name", F.lit(" (\n"), body, F.lit("\n);")).alias("ddl"))
    return t.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_pos", "ddl"))),
                                                            lambda x: x["ddl"]), "\n\n").alias("ddl"))


# A table's name and, up to the closing bracket before the semicolon, its body.
BLOCK_RE = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)[`\"]?\s*\((.*?)\)\s*;"
# A definition: text in which every comma stands inside brackets.
DEFINITION_RE = r"(?:[^,()]|\([^()]*\))+"
REFERENCE_RE = r"(?is)^\s*[`\"]?(\w+)[`\"]?\s.*\breferences\s+[`\"]?(\w+)[`\"]?\s*\(\s*[`\"]?(\w+)"


def fks_from_ddl(ddl):
    """Inline FK references per column of each CREATE TABLE block (I6): a body is cut
    at the commas outside brackets, so one-line tables and types such as
    DECIMAL(5,2) bind the right column (Q26 fixed); table-level FOREIGN KEY lines
    are left out."""
    b = ddl.select("domain", F.arrays_zip(F.regexp_extract_all("ddl", F.lit(BLOCK_RE), 1).alias("t"),
                                          F.regexp_extract_all("ddl", F.lit(BLOCK_RE), 2).alias("b")).alias("z"))
    parts = b.select("domain", F.inline("z")).select("domain", F.col("t").alias("table_name"),
                                                     F.explode(F.regexp_extract_all("b", F.lit(DEFINITION_RE), 0)).alias("part"))
    m = parts.select("domain", "table_name", *[F.regexp_extract("part", REFERENCE_RE, i).alias(n)
                                               for i, n in ((1, "column_name"), (2, "ref_table"), (3, "ref_column"))])
    return m.filter((F.col("column_name") != "") & (F.upper("column_name") != "FOREIGN"))


_DDL_SQL = f"""WITH {CATALOG_SQL},
cd AS (SELECT domain, table_pos, table_name, col_pos,
  '  ' || column_name || ' ' || sql_type || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END ||
  CASE WHEN is_fk AND table_name = 'customer' THEN ' REFERENCES ' || fk_table || '(' || fk_column || ')' ELSE '' END AS d,
  CASE WHEN is_fk AND table_name <> 'customer' THEN '  FOREIGN KEY (' || column_name || ') REFERENCES ' || fk_table || '(' || fk_column || ')' END AS tl
  FROM cat),
pt AS (SELECT domain, table_pos, table_name,
  CASE WHEN table_name = 'region' THEN 'CREATE TABLE IF NOT EXISTS ' ELSE 'CREATE TABLE ' END || table_name || ' (' || chr(10) ||
  CASE WHEN ('0x' || substr(md5('ddl|' || domain), 1, 1))::INTEGER % 2 = 0
   THEN array_to_string(list_transform(list_concat(list(d ORDER BY col_pos), coalesce(list(tl ORDER BY tl) FILTER (WHERE tl IS NOT NULL), [])), lambda x: trim(x)), ', ')
   ELSE array_to_string(list_concat(list(d ORDER BY col_pos), coalesce(list(tl ORDER BY tl) FILTER (WHERE tl IS NOT NULL), [])), ',' || chr(10)) END
  || chr(10) || ');' AS ddl FROM cd GROUP BY domain, table_pos, table_name),
dd AS (SELECT domain, string_agg(ddl, chr(10) || chr(10) ORDER BY table_pos) AS ddl FROM pt GROUP BY domain),
bl AS (SELECT domain, unnest(regexp_extract_all(ddl, '{BLOCK_RE}', 1)) AS t,
              unnest(regexp_extract_all(ddl, '{BLOCK_RE}', 2)) AS b FROM dd),
ln AS (SELECT domain, t AS table_name, unnest(regexp_extract_all(b, '{DEFINITION_RE}')) AS line FROM bl),
m AS (SELECT domain, table_name, regexp_extract(line, '{REFERENCE_RE}', 1) AS column_name,
             regexp_extract(line, '{REFERENCE_RE}', 2) AS ref_table, regexp_extract(line, '{REFERENCE_RE}', 3) AS ref_column FROM ln)
SELECT * FROM m WHERE column_name <> '' AND upper(column_name) <> 'FOREIGN'"""


@query("fk_from_ddl", _DDL_SQL)
def fk_from_ddl(spark, sf):
    return finalize(fks_from_ddl(ddl_text(catalog(spark, sf))))
