"""Parsers of model-style output, run on text built from the test tables
(G13-G19). Every parser is a chain of built-in regex / JSON expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import finalize
from relweave.plans import common as C
from relweave.plans.q_catalog import CATALOG_SQL, catalog
from relweave.plans.q_clean import _sql_hex, hex_digit
from relweave.plans.registry import query
from relweave.sources.tables import read_table

# ------------------------------------------------------------------ G18

EXTRACT_CATALOG = [("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"),
                   ("orders", "o_orderstatus", "string"), ("orders", "o_totalprice", "double")]


def extract_lines(spark, sf):
    """``extract <table>: "col": v; ...`` lines built from orders, with an
    unknown table, a missing column, an extra column with a second colon, an
    item without colon, a ``?`` value and a leading blank chosen by md5."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    d = lambda tag: hex_digit(F.lit(tag), k)
    line = F.concat(
        F.when(d("lb") == 0, " ").otherwise(""), F.lit("extract "),
        F.when(d("tb") == 0, "unknown_tbl").otherwise("orders"), F.lit(': "o_orderkey": '), k,
        F.lit('; "o_custkey": '), F.col("o_custkey").cast("string"),
        F.lit('; "o_orderstatus": "'), F.when(d("q") == 0, "?").otherwise(F.col("o_orderstatus")), F.lit('"'),
        F.when(d("mc") == 0, "").otherwise(F.concat(F.lit('; "o_totalprice": '), F.col("o_totalprice").cast("string"))),
        F.when(d("ex") == 0, '; "note": 10:30').otherwise(""),
        F.when(d("nc") == 0, '; "age" 30').otherwise(""))
    return o.select(F.col("o_orderkey").alias("line_id"), line.alias("line"))


def parse_extract(lines, cat):
    """G18 with Q2/Q3 fixed: split an item at its first colon, drop only items
    without one, strip outer quotes, whole-value ``?`` -> ``#`` -> NULL; rows
    take every catalog column (missing -> NULL), extra columns and unknown
    tables are dropped; typed with ``try_cast``."""
    x = lines.filter(F.regexp_replace("line", r"^\s+", "").startswith("extract"))
    x = x.select("line_id", F.trim(F.regexp_extract("line", r"^\s*extract\s+([^:]+):", 1)).alias("table_name"),
                 F.regexp_extract("line", r"(?s)^\s*extract\s+[^:]+:(.*)$", 1).alias("body"))
    items = x.select("line_id", "table_name", F.explode(F.split("body", ";")).alias("item")) \
        .filter(F.instr("item", ":") > 0)
    strip_q = lambda c: F.regexp_replace(F.trim(c), r'^"+|"+$', "")
    items = items.select("line_id", "table_name", strip_q(F.substring_index("item", ":", 1)).alias("column_name"),
                         strip_q(F.expr("substring(item, instr(item, ':') + 1)")).alias("v"))
    rows = x.select("line_id", "table_name").join(cat, "table_name")  # catalog-side: every declared column
    j = rows.join(items, ["line_id", "table_name", "column_name"], "left")
    raw = F.when(F.col("v").isNull() | F.col("v").isin("?", "#"), F.lit(None)).otherwise(F.col("v"))
    typed_ok = F.when(F.col("sql_type") == "bigint", raw.try_cast("bigint").isNotNull()) \
        .when(F.col("sql_type") == "double", raw.try_cast("double").isNotNull()).otherwise(F.lit(True))
    return j.select("line_id", "table_name", "column_name", raw.alias("raw"), (raw.isNull() | typed_ok).alias("cast_ok"))


@query("parse_extract_lines", f"""WITH o AS (SELECT o_orderkey AS line_id,
  CASE WHEN {_sql_hex("'lb'", 'CAST(o_orderkey AS VARCHAR)')} = 0 THEN ' ' ELSE '' END || 'extract ' ||
  CASE WHEN {_sql_hex("'tb'", 'CAST(o_orderkey AS VARCHAR)')} = 0 THEN 'unknown_tbl' ELSE 'orders' END ||
  ': "o_orderkey": ' || CAST(o_orderkey AS VARCHAR) || '; "o_custkey": ' || CAST(o_custkey AS VARCHAR) ||
  '; "o_orderstatus": "' || CASE WHEN {_sql_hex("'q'", 'CAST(o_orderkey AS VARCHAR)')} = 0 THEN '?' ELSE o_orderstatus END || '"' ||
  CASE WHEN {_sql_hex("'mc'", 'CAST(o_orderkey AS VARCHAR)')} = 0 THEN '' ELSE '; "o_totalprice": ' || CAST(o_totalprice AS VARCHAR) END ||
  CASE WHEN {_sql_hex("'ex'", 'CAST(o_orderkey AS VARCHAR)')} = 0 THEN '; "note": 10:30' ELSE '' END ||
  CASE WHEN {_sql_hex("'nc'", 'CAST(o_orderkey AS VARCHAR)')} = 0 THEN '; "age" 30' ELSE '' END AS line FROM orders),
cat AS (SELECT * FROM (VALUES """ + ", ".join(f"('{t}', '{c}', '{ty}')" for t, c, ty in EXTRACT_CATALOG) + r""") v(table_name, column_name, sql_type)),
x AS (SELECT line_id, trim(regexp_extract(line, '^\s*extract\s+([^:]+):', 1)) AS table_name,
             regexp_extract(line, '(?s)^\s*extract\s+[^:]+:(.*)$', 1) AS body FROM o
      WHERE starts_with(regexp_replace(line, '^\s+', ''), 'extract')),
it AS (SELECT line_id, table_name, unnest(string_split(body, ';')) AS item FROM x),
items AS (SELECT line_id, table_name,
                 regexp_replace(trim(split_part(item, ':', 1)), '^"+|"+$', '', 'g') AS column_name,
                 regexp_replace(trim(substr(item, instr(item, ':') + 1)), '^"+|"+$', '', 'g') AS v
          FROM it WHERE instr(item, ':') > 0),
j AS (SELECT x.line_id, x.table_name, cat.column_name, cat.sql_type,
             CASE WHEN i.v IS NULL OR i.v IN ('?', '#') THEN NULL ELSE i.v END AS raw
      FROM x JOIN cat ON cat.table_name = x.table_name
      LEFT JOIN items i ON i.line_id = x.line_id AND i.table_name = x.table_name AND i.column_name = cat.column_name)
SELECT line_id, table_name, column_name, raw,
       raw IS NULL OR CASE WHEN sql_type = 'bigint' THEN regexp_matches(raw, '^\s*[+-]?[0-9]+\s*$') AND TRY_CAST(raw AS BIGINT) IS NOT NULL
                           WHEN sql_type = 'double' THEN TRY_CAST(raw AS DOUBLE) IS NOT NULL ELSE true END AS cast_ok
FROM j""")
def parse_extract_lines(spark, sf):
    cat = spark.createDataFrame(EXTRACT_CATALOG, "table_name string, column_name string, sql_type string")
    return finalize(parse_extract(extract_lines(spark, sf), F.broadcast(cat)))


# ------------------------------------------------------------------ G16

_BRACE = "concat('{', 'row' || row_id, ', ', attr, ', ', value, '}')"


def brace_texts(spark, sf):
    t = C.truth(spark, sf)
    b = F.concat(F.lit("{row"), F.col("row_id"), F.lit(", "), F.col("attr"), F.lit(", "), F.col("value"), F.lit("}"))
    return t.groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("row_id").cast("int").alias("r"), F.col("col_pos").alias("c"), b.alias("b")))), lambda x: x["b"]), " ")
        .alias("text"))


@query("parse_braces", f"""WITH t AS ({C.TRUTH_SQL}),
e AS (SELECT entry_id, string_agg('{{row' || row_id || ', ' || attr || ', ' || value || '}}', ' '
                                  ORDER BY CAST(row_id AS INTEGER), col_pos) AS text FROM t GROUP BY entry_id),
g AS (SELECT entry_id, u.g, u.o - 1 AS pos FROM e, unnest(regexp_extract_all(text, '\\{{([^{{}}]+)\\}}', 1))
      WITH ORDINALITY AS u(g, o)),
p AS (SELECT entry_id, pos, list_transform(string_split(g, ','), lambda x: trim(x)) AS parts FROM g)
SELECT entry_id, pos, parts[1] AS subject, parts[2] AS relation, array_to_string(parts[3:], ' ') AS object
FROM p WHERE len(parts) >= 3""")
def parse_braces(spark, sf):
    """``{a, b, c...}`` groups with 3+ parts -> (subject, relation, object),
    the rest joined by a space (G16)."""
    e = brace_texts(spark, sf)
    g = e.select("entry_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\{([^{}]+)\}"), 1)).alias("pos", "g"))
    p = g.select("entry_id", "pos", F.transform(F.split("g", ","), lambda x: F.trim(x)).alias("parts"))
    return finalize(p.filter(F.size("parts") >= 3).select(
        "entry_id", "pos", F.get("parts", 0).alias("subject"), F.get("parts", 1).alias("relation"),
        F.array_join(F.filter("parts", lambda x, i: i >= 2), " ").alias("object")))


# ------------------------------------------------------------------ G15

# The two answer formats, tried in order.
ASSOC_RE = r"(?s)paragraph \d+: (.*?)\nassociated superkey: ([^\n]+)"
ASSOC_BOLD_RE = r"(?s)(?:\*\*)?[Pp]aragraph\s+\d+:(?:\*\*)?\s*\n(.*?)\nassociated superkey:\s*([^\n]+)"


def association_texts(spark, sf):
    """Per entry, chosen by md5, a ``paragraph k: ...\\nassociated superkey: ...``
    answer, the same with bold headings on lines of their own, or a plain text
    without associations."""
    r = C.rendered(spark, sf).withColumn("entry_id", F.floor(F.col("c_custkey") / C.BATCH))
    r = r.withColumn("pos", F.col("c_custkey") - F.col("entry_id") * C.BATCH + 1)
    block = F.concat(F.lit("paragraph "), F.col("pos").cast("string"), F.lit(": "), F.col("sentence"),
                     F.lit("\nassociated superkey: customer.c_custkey="), F.col("c_custkey").cast("string"))
    e = r.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b"), "sentence"))).alias("a"))
    h = hex_digit(F.lit("sk"), F.col("entry_id").cast("string"))
    bold = F.transform("a", lambda x: F.regexp_replace(x["b"], r"^paragraph (\d+): ", "**Paragraph $1:**\n"))
    return e.select("entry_id", F.when(h < 4, F.array_join(F.transform("a", lambda x: x["sentence"]), "\n"))
                    .when(h < 8, F.array_join(bold, "\n"))
                    .otherwise(F.array_join(F.transform("a", lambda x: x["b"]), "\n")).alias("text"))


@query("parse_superkeys", f"""WITH r AS ({C.RENDERED_SQL}),
rp AS (SELECT *, c_custkey - entry_id * {C.BATCH} + 1 AS pos FROM r),
e AS (SELECT entry_id, CASE WHEN {_sql_hex("'sk'", 'CAST(entry_id AS VARCHAR)')} < 4
        THEN string_agg(sentence, chr(10) ORDER BY pos)
        WHEN {_sql_hex("'sk'", 'CAST(entry_id AS VARCHAR)')} < 8
        THEN string_agg('**Paragraph ' || CAST(pos AS VARCHAR) || ':**' || chr(10) || sentence || chr(10) ||
                        'associated superkey: customer.c_custkey=' || CAST(c_custkey AS VARCHAR), chr(10) ORDER BY pos)
        ELSE string_agg('paragraph ' || CAST(pos AS VARCHAR) || ': ' || sentence || chr(10) ||
                        'associated superkey: customer.c_custkey=' || CAST(c_custkey AS VARCHAR), chr(10) ORDER BY pos) END AS text
      FROM rp GROUP BY entry_id),
m AS (SELECT entry_id, CASE WHEN regexp_matches(text, '{ASSOC_RE}') THEN regexp_extract_all(text, '{ASSOC_RE}', 1) ELSE regexp_extract_all(text, '{ASSOC_BOLD_RE}', 1) END AS ps,
             CASE WHEN regexp_matches(text, '{ASSOC_RE}') THEN regexp_extract_all(text, '{ASSOC_RE}', 2) ELSE regexp_extract_all(text, '{ASSOC_BOLD_RE}', 2) END AS ks,
             string_split(text, chr(10)) AS lines FROM e),
a AS (SELECT entry_id, u.p AS paragraph, ks[u.o] AS superkey, u.o - 1 AS pos FROM m, unnest(ps) WITH ORDINALITY AS u(p, o)
      WHERE len(ps) > 0),
f AS (SELECT entry_id, u.p AS paragraph, CAST(u.o AS VARCHAR) AS superkey, u.o - 1 AS pos
      FROM m, unnest(lines) WITH ORDINALITY AS u(p, o) WHERE len(ps) = 0)
SELECT entry_id, pos, trim(paragraph) AS paragraph, trim(superkey) AS superkey FROM (SELECT * FROM a UNION ALL SELECT * FROM f) z""")
def parse_superkeys(spark, sf):
    """Paragraph/superkey pairs by the first answer format that matches; with none
    found, each line is a paragraph and its 1-based number is the superkey (G15)."""
    e = association_texts(spark, sf)
    plain = F.col("text").rlike(ASSOC_RE)
    found = lambda i: F.when(plain, F.regexp_extract_all("text", F.lit(ASSOC_RE), i)).otherwise(F.regexp_extract_all("text", F.lit(ASSOC_BOLD_RE), i))
    m = e.select("entry_id", found(1).alias("ps"), found(2).alias("ks"), F.split("text", "\n").alias("lines"))
    pairs = F.when(F.size("ps") > 0, F.arrays_zip(F.col("ps").alias("p"), F.col("ks").alias("k"))).otherwise(
        F.transform("lines", lambda x, i: F.struct(x.alias("p"), (i + 1).cast("string").alias("k"))))
    out = m.select("entry_id", F.posexplode(pairs).alias("pos", "z"))
    return finalize(out.select("entry_id", "pos", F.trim(F.col("z")["p"]).alias("paragraph"),
                               F.trim(F.col("z")["k"]).alias("superkey")))


# ------------------------------------------------------------------ G13, G14

# Schema-literal patterns, tried in order.
SCHEMA_PATTERNS = [
    r"```(?:json|python)?\s*schema\s*=\s*(\[[\s\S]*\])\s*```",
    r"```(?:json|python)?\s*(\[[\s\S]*\])\s*```",
    r"schema\s*=\s*(\[[\s\S]*\])",
    r"[Ss]chema\s*[:=]\s*(\[[\s\S]*?\])",
    r"[Ss]chema\s*:\s*\{\s*\"schema\"\s*:\s*(\[[\s\S]*?\])\s*}",
]
FENCE_RE = r"(?s)```(?:python|sql)\s*(.*?)```"



def schema_texts(spark, sf):
    cat = catalog(spark, sf)
    lit = cat.groupBy("domain").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_set(
        F.struct("table_pos", "table_name"))), lambda x: F.concat(F.lit('"'), x["table_name"], F.lit('"'))), ", "),
        F.lit("]")).alias("lit"))
    fmt = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("fmt|"), F.col("domain"))), 1, 1), 16, 10).cast("int"), F.lit(4))
    text = (F.when(fmt == 0, F.concat(F.lit("```python\nschema = "), "lit", F.lit("\n```")))
            .when(fmt == 1, F.concat(F.lit("```json\n"), "lit", F.lit("\n```")))
            .when(fmt == 2, F.concat(F.lit("Here it is: schema = "), "lit"))
            .otherwise(F.concat(F.lit("Schema: "), "lit", F.lit(" and no more"))))
    return lit.select("domain", fmt.alias("fmt"), text.alias("text"))


@query("extract_schema_text", f"""WITH {CATALOG_SQL},
l AS (SELECT domain, '[' || string_agg('"' || table_name || '"', ', ' ORDER BY table_pos) || ']' AS lit
      FROM (SELECT DISTINCT domain, table_pos, table_name FROM cat) d GROUP BY domain),
t AS (SELECT domain, ('0x' || substr(md5('fmt|' || domain), 1, 1))::INTEGER % 4 AS fmt, lit FROM l),
x AS (SELECT domain, fmt, CASE fmt WHEN 0 THEN '```python' || chr(10) || 'schema = ' || lit || chr(10) || '```'
                                 WHEN 1 THEN '```json' || chr(10) || lit || chr(10) || '```'
                                 WHEN 2 THEN 'Here it is: schema = ' || lit
                                 ELSE 'Schema: ' || lit || ' and no more' END AS text FROM t)
SELECT domain, fmt, coalesce(""" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')"
                                            for p in SCHEMA_PATTERNS) + f""") AS extracted,
       nullif(regexp_extract(text, '{FENCE_RE}', 1), '') AS fenced FROM x""")
def extract_schema_text(spark, sf):
    """First of five patterns that finds a list literal (G13) and the body of
    a python/sql fence (G14), over schema answers written four ways."""
    x = schema_texts(spark, sf)
    ext = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
                       for p in SCHEMA_PATTERNS])
    return finalize(x.select("domain", "fmt", ext.alias("extracted"),
                             F.nullif(F.regexp_extract("text", FENCE_RE, 1), F.lit("")).alias("fenced")))


# ------------------------------------------------------------------ G17

TRIPLET_SCHEMA = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "relation", "object")]))
# Fixed value: a list of objects.
LIST_RE = r"(?s)\[\s*\{.*?\}\s*\]"


def triplet_texts(spark, sf):
    t = C.truth(spark, sf)
    d = F.concat(F.lit('{"subject": "row'), F.col("row_id"), F.lit('", "relation": "'), F.col("attr"),
                 F.lit('", "object": "'), F.col("value"), F.lit('"}'))
    e = t.groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("row_id").cast("int").alias("r"), F.col("col_pos").alias("c"), d.alias("d")))), lambda x: x["d"]), ", ")
        .alias("body"))
    cut = hex_digit(F.lit("tl"), F.col("entry_id").cast("string")) < 4
    return e.select("entry_id", F.concat(F.lit("["), "body", F.when(cut, "").otherwise("]")).alias("text"))


@query("parse_triplet_list", f"""WITH t AS ({C.TRUTH_SQL}),
e AS (SELECT entry_id, '[' || string_agg('{{"subject": "row' || row_id || '", "relation": "' || attr || '", "object": "' || value || '"}}',
        ', ' ORDER BY CAST(row_id AS INTEGER), col_pos) ||
        CASE WHEN {_sql_hex("'tl'", 'CAST(entry_id AS VARCHAR)')} < 4 THEN '' ELSE ']' END AS text FROM t GROUP BY entry_id),
m AS (SELECT entry_id, coalesce(regexp_extract_all(text, '{LIST_RE}')[-1], text) AS o FROM e),
f AS (SELECT entry_id, CASE WHEN suffix(o, ']') THEN o ELSE o || ']' END AS j FROM m),
p AS (SELECT entry_id, CASE WHEN json_valid(j) THEN from_json(j, '[{{"subject": "VARCHAR", "relation": "VARCHAR", "object": "VARCHAR"}}]') END AS l FROM f)
SELECT entry_id, u.o - 1 AS pos, u.x.subject AS subject, u.x.relation AS relation, u.x.object AS object
FROM p, unnest(l) WITH ORDINALITY AS u(x, o)""")
def parse_triplet_list(spark, sf):
    """The last ``[ {...} ]`` block parsed as a list of triplets, repaired by
    appending ``]`` when it is cut; unparsable -> no rows (G17)."""
    e = triplet_texts(spark, sf)
    last = F.try_element_at(F.regexp_extract_all("text", F.lit(LIST_RE), 0), F.lit(-1))
    o = F.coalesce(last, F.col("text"))
    j = F.when(o.endswith("]"), o).otherwise(F.concat(o, F.lit("]")))
    p = e.select("entry_id", F.from_json(j, TRIPLET_SCHEMA).alias("l"))
    out = p.select("entry_id", F.posexplode("l").alias("pos", "x"))
    return finalize(out.select("entry_id", "pos", F.col("x")["subject"].alias("subject"),
                               F.col("x")["relation"].alias("relation"), F.col("x")["object"].alias("object")))


# ------------------------------------------------------------------ G19

HEADER = "<|start_header_id|>assistant<|end_header_id|>\n\n"
VALUES_SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("ok", T.BooleanType()),
                              T.StructField("note", T.StringType()), T.StructField("tag", T.StringType()),
                              T.StructField("_corrupt", T.StringType())])


def value_texts(spark, sf):
    ev = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    h = hex_digit(F.lit("pv"), F.col("event_id").cast("string"))
    txt = F.concat(F.when(h < 2, F.lit(HEADER)).otherwise(""), F.lit("{'k': "), k,
                   F.lit(", 'ok': "), F.when(F.col("value") > 10, "True").otherwise("False"),
                   F.lit(", 'note': "), F.when(h == 3, "None").otherwise(F.concat(F.lit("'"), F.col("event_type"), F.lit("'"))),
                   F.lit(", 'tag': ''"), F.when(h == 5, ", broken").otherwise(""), F.lit("}"))
    return ev.select("event_id", txt.alias("text"))


@query("parse_values", f"""WITH e AS (SELECT event_id,
  CASE WHEN {_sql_hex("'pv'", 'CAST(event_id AS VARCHAR)')} < 2 THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) ELSE '' END ||
  '{{''k'': ' || json_extract_string(props, '$.k') || ', ''ok'': ' || CASE WHEN value > 10 THEN 'True' ELSE 'False' END ||
  ', ''note'': ' || CASE WHEN {_sql_hex("'pv'", 'CAST(event_id AS VARCHAR)')} = 3 THEN 'None' ELSE '''' || event_type || '''' END ||
  ', ''tag'': ''''' || CASE WHEN {_sql_hex("'pv'", 'CAST(event_id AS VARCHAR)')} = 5 THEN ', broken' ELSE '' END || '}}' AS text FROM events),
c AS (SELECT event_id, regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(text,
        '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10), ''), '''', '"'),
        '\\bNone\\b', 'null', 'g'), '": ""', '": null'),
        '([\\s:,])True([\\s,}}\\]])', '\\1true\\2', 'g'), '([\\s:,])False([\\s,}}\\]])', '\\1false\\2', 'g') AS j FROM e),
p AS (SELECT event_id, from_json(j, '{{"k": "BIGINT", "ok": "BOOLEAN", "note": "VARCHAR", "tag": "VARCHAR"}}') AS s
      FROM c WHERE json_valid(j))
SELECT event_id, s.k AS k, s.ok AS ok, s.note AS note, s.tag AS tag FROM p""")
def parse_values(spark, sf):
    """Model-style Python literals cleaned to JSON and parsed (G19): header
    dropped, quotes, None, empty strings and True/False rewritten; a chunk that
    does not parse is dropped."""
    e = value_texts(spark, sf)
    x = F.replace(F.col("text"), F.lit(HEADER), F.lit(""))
    x = F.regexp_replace(x, "'", '"')
    x = F.regexp_replace(x, r"\bNone\b", "null")
    x = F.regexp_replace(x, '": ""', '": null')
    x = F.regexp_replace(x, r"(?<=\s|:|,)True(?=\s|,|}|\])", "true")
    x = F.regexp_replace(x, r"(?<=\s|:|,)False(?=\s|,|}|\])", "false")
    p = e.select("event_id", F.from_json(x, VALUES_SCHEMA, {"mode": "PERMISSIVE",
                                                             "columnNameOfCorruptRecord": "_corrupt"}).alias("s"))
    ok = F.col("s").isNotNull() & F.col("s")["_corrupt"].isNull()
    return finalize(p.filter(ok).select("event_id", F.col("s")["k"].alias("k"), F.col("s")["ok"].alias("ok"),
                                        F.col("s")["note"].alias("note"), F.col("s")["tag"].alias("tag")))
