"""Dataset sampling, ordering, cleaning and bookkeeping queries (A8, A9, A11,
B1-B3, B8-B13, B15, B16, C10, D19, E1-E5, E9, E10, F1, F4, G20, G21, G23, G24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import DOMAIN_RULES, domain_from_key, domain_from_path, finalize, is_number
from relweave.operators.clean import drop_columns, drop_pattern_columns, keep_mentioned, exclude_values, placeholder_filter, rename
from relweave.operators.contain import contained
from relweave.operators.dataset import cap_and_append, domain_context, first_k_per_group, first_seen, merged_pairs, positional_replace, round_robin
from relweave.operators.extract import pending
from relweave.operators.joins import union_results
from relweave.operators.windows import rank_in_group
from relweave.plans import common as C
from relweave.plans.q_clean import _sql_hex, hex_digit
from relweave.plans.registry import query
from relweave.sources.tables import read_table, tables


@query("is_number", r"""SELECT c_custkey, txt,
  CASE WHEN regexp_matches(trim(txt), '^-?\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$')
       THEN round(TRY_CAST(regexp_replace(trim(txt), '[$,]', '', 'g') AS DOUBLE), 6) END AS num
FROM (SELECT c_custkey, CASE """ + _sql_hex("'num'", "CAST(c_custkey AS VARCHAR)") + r""" % 4
  WHEN 0 THEN CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal))
  WHEN 1 THEN CAST(c_acctbal AS VARCHAR)
  WHEN 2 THEN replace(CAST(c_acctbal AS VARCHAR), '.', ',')
  ELSE CAST(c_acctbal AS VARCHAR) || 'e3' END AS txt FROM customer) x""")
def is_number_q(spark, sf):
    """B13 over account balances written four ways: ``-$1,234.56``, plain,
    decimal comma, exponent suffix."""
    c = read_table(spark, sf, "customer")
    sel = F.pmod(hex_digit(F.lit("num"), F.col("c_custkey").cast("string")), F.lit(4))
    money = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.lit("$"),
                     F.format_number(F.abs("c_acctbal"), 2))
    plain = F.col("c_acctbal").cast("string")
    txt = (F.when(sel == 0, money).when(sel == 1, plain)
           .when(sel == 2, F.regexp_replace(plain, r"\.", ",")).otherwise(F.concat(plain, F.lit("e3"))))
    x = c.select("c_custkey", txt.alias("txt"))
    return finalize(x.withColumn("num", is_number("txt")))


@query("domain_counts", """SELECT source AS domain, count(*) AS n FROM documents GROUP BY source""")
def domain_counts(spark, sf):
    """Entries per domain (D19), partial aggregation before the shuffle."""
    d = read_table(spark, sf, "documents")
    return finalize(d.groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("n")))


@query("domain_from_key", """SELECT doc_id, lang || '_' || source || '_' || CAST(doc_id AS VARCHAR) AS key,
       split_part(lang || '_' || source || '_' || CAST(doc_id AS VARCHAR), '_', 1) AS domain FROM documents""")
def domain_from_key_q(spark, sf):
    """Domain = text before the first ``_`` of a database key."""
    d = read_table(spark, sf, "documents")
    k = F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string"))
    return finalize(d.select("doc_id", k.alias("key")).withColumn("domain", domain_from_key("key")))


_DOM_SQL = "CASE " + " ".join(f"WHEN contains(path, '{n}') THEN '{d}'" for n, d, _ in DOMAIN_RULES) + " END"
_DIF_SQL = "CASE " + " ".join(f"WHEN contains(path, '{n}') THEN '{k}'" for n, _, k in DOMAIN_RULES) + " END"
#: Folder words of the derived paths: the five domains and one without a rule.
PATH_WORDS = [n for n, _, _ in DOMAIN_RULES] + ["misc"]
_PATH_SQL = ("SELECT page_id, 'sources/' || (CASE " + _sql_hex("'path'", "CAST(page_id AS VARCHAR)") + f" % {len(PATH_WORDS)} "
             + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(PATH_WORDS)) + " END) || '/' || url AS path FROM pages")


@query("domain_from_path", f"""SELECT page_id, path, {_DOM_SQL} AS domain, {_DIF_SQL} AS difficulty FROM ({_PATH_SQL}) p""")
def domain_from_path_q(spark, sf):
    """Domain and difficulty from a path by ordered substring tests (G23); the
    paths are the pages' urls below a folder picked by md5."""
    p = read_table(spark, sf, "pages")
    pick = F.pmod(hex_digit(F.lit("path"), F.col("page_id").cast("string")), F.lit(len(PATH_WORDS)))
    word = F.get(F.array(*[F.lit(w) for w in PATH_WORDS]), pick)
    p = p.select("page_id", F.concat(F.lit("sources/"), word, F.lit("/"), "url").alias("path"))
    dom, dif = domain_from_path("path")
    return finalize(p.select("page_id", "path", dom.alias("domain"), dif.alias("difficulty")))


@query("seeded_shuffle", """SELECT doc_id, md5('42|' || CAST(doc_id AS VARCHAR)) AS shuffle_key,
       row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS shuffle_pos FROM documents""")
def seeded_shuffle_q(spark, sf):
    """Deterministic shuffle (E9) with a dense global position computed from a
    range-partitioned sort, not a single-partition window."""
    d = read_table(spark, sf, "documents").select("doc_id")
    d = d.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string"))))
    return finalize(rank_in_group(d, None, ["shuffle_key", "doc_id"], out="shuffle_pos"))


@query("first_n_indexed", """SELECT row_number() OVER (ORDER BY o_orderkey) AS idx, o_orderkey, o_custkey, o_totalprice
FROM orders""")
def first_n_indexed(spark, sf):
    """1-based index over all rows in key order, index first."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    r = rank_in_group(o, None, ["o_orderkey"], out="idx")
    return finalize(r.select("idx", "o_orderkey", "o_custkey", "o_totalprice"))


@query("first_k_per_domain", """WITH r AS (SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank_in_group,
  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, rank_in_group FROM r WHERE rank_in_group <= 24 AND n >= 24""")
def first_k_per_domain(spark, sf):
    """First 24 entries per domain, domains with fewer removed."""
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return finalize(first_k_per_group(d, "source", ["doc_id"], 24).select("doc_id", "source", "rank_in_group"))


#: Domains interleaved, in this order; others are dropped.
INTERLEAVED = [f"src{i}" for i in range(18, -1, -1)]


@query("round_robin", "WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', {i})" for i, g in enumerate(INTERLEAVED)) + """) v(source, group_rank)),
r AS (SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS rn, group_rank
      FROM documents d JOIN g ON g.source = d.source)
SELECT doc_id, source, rn, group_rank, row_number() OVER (ORDER BY rn, group_rank) AS rr_pos FROM r""")
def round_robin_q(spark, sf):
    """Round-robin interleave over a given domain list; a domain that the list
    lacks is dropped (E3)."""
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return finalize(round_robin(d, "source", ["doc_id"], INTERLEAVED).select("doc_id", "source", "rn", "group_rank", "rr_pos"))


@query("positional_replace", """WITH t AS (SELECT doc_id, source, text,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE lang = 'en'),
s AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE lang = 'de')
SELECT t.doc_id, t.source, s.text IS NOT NULL AS replaced, md5(coalesce(s.text, t.text)) AS text_md5
FROM t LEFT JOIN s ON s.source = t.source AND s.i = t.i
UNION ALL SELECT doc_id, source, false, md5(text) FROM documents WHERE lang IS DISTINCT FROM 'en'""")
def positional_replace_q(spark, sf):
    """The i-th English document of a domain takes the text of the i-th German
    document of the same domain; all other documents keep theirs (C10)."""
    d = read_table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    t = d.filter(F.col("lang") == "en").drop("lang")
    s = d.filter(F.col("lang") == "de").drop("lang")
    r = positional_replace(t, s, "source", "doc_id", ["text"])
    rest = d.filter(~F.col("lang").eqNullSafe("en")).select("doc_id", "source", "text", F.lit(False).alias("replaced"))
    return finalize(r.select("doc_id", "source", "text", "replaced").unionByName(rest)
                    .select("doc_id", "source", "replaced", F.md5("text").alias("text_md5")))


@query("domain_context", """WITH d AS (SELECT doc_id, source, text AS t FROM documents),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5),
c AS (SELECT d.doc_id, d.source, d.t || coalesce(string_agg(f.t, '' ORDER BY f.doc_id) FILTER (WHERE f.doc_id <> d.doc_id), '') AS ctx
      FROM d LEFT JOIN f ON f.source = d.source GROUP BY d.doc_id, d.source, d.t)
SELECT doc_id, source, md5(ctx) AS ctx_md5, length(ctx) AS ctx_len FROM c""")
def domain_context_q(spark, sf):
    """Own text plus the first five texts of the same domain, itself skipped."""
    d = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    c = domain_context(d, "source", "doc_id", "text", k=5)
    return finalize(c.select("doc_id", "source", F.md5("context").alias("ctx_md5"),
                             F.length("context").alias("ctx_len")))


_SCHEMA_SQL = ("SELECT doc_id, source, CASE WHEN " + _sql_hex("'sch'", "CAST(doc_id AS VARCHAR)")
               + " < 12 THEN '' ELSE 'schema_' || lang || '_' || CAST(doc_id AS VARCHAR) END AS s FROM documents")


@query("domain_schema", f"""WITH d AS ({_SCHEMA_SQL}),
f AS (SELECT source, arg_min(s, doc_id) FILTER (WHERE s <> '') AS domain_schema FROM d GROUP BY source)
SELECT d.doc_id, d.source, d.s AS own_schema, f.domain_schema FROM d LEFT JOIN f ON f.source = d.source""")
def domain_schema(spark, sf):
    """The first non-empty schema seen in a domain serves all its entries (E5);
    three of four entries, by md5, have none of their own."""
    d = read_table(spark, sf, "documents")
    own = F.when(hex_digit(F.lit("sch"), F.col("doc_id").cast("string")) < 12, "").otherwise(
        F.concat_ws("_", F.lit("schema"), "lang", F.col("doc_id").cast("string")))
    d = d.select("doc_id", "source", own.alias("own_schema"))
    return finalize(first_seen(d, "source", "doc_id", "own_schema", "domain_schema"))


@query("merged_pairs", f"""WITH t0 AS ({C.TRUTH_SQL}), t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE {_sql_hex("'mp'", 'entry_id', 'attr', 'row_id')} < 4)
SELECT entry_id, attr, string_agg(row_id || '=' || value, '; ' ORDER BY CAST(row_id AS INTEGER), value) AS pairs, count(*) AS n
FROM (SELECT DISTINCT entry_id, attr, row_id, value FROM t) x GROUP BY entry_id, attr""")
def merged_pairs_q(spark, sf):
    """Key/values of a batch merged per attribute, repeated pairs once (D2, F5); by md5 one
    pair in four comes twice."""
    t = C.truth(spark, sf)
    t = t.unionByName(t.where(hex_digit(F.lit("mp"), F.col("entry_id").cast("string"), F.col("attr"), F.col("row_id")) < 4))
    t = t.select("entry_id", "attr", F.col("row_id").cast("int").alias("pos"), "value")
    m = merged_pairs(t, "entry_id", "attr", "pos", "value")
    return finalize(m.select("entry_id", "attr", F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["pos"].cast("string"), p["value"])), "; ").alias("pairs"),
                             F.size("pairs").alias("n")))


@query("cap_domain", """SELECT doc_id, source, part FROM (
  SELECT doc_id, source, 0 AS part, 0 AS r FROM documents WHERE source <> 'src1'
  UNION ALL SELECT doc_id, source, 1, row_number() OVER (ORDER BY doc_id) FROM documents WHERE source = 'src1') x WHERE r <= 24""")
def cap_domain(spark, sf):
    """One domain cut to its first 24 entries and put after the others (B8); the
    cap is the feature."""
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return finalize(cap_and_append(d, "source", "src1", ["doc_id"], 24).select("doc_id", "source", "part"))


@query("renumber_ids", f"""SELECT entry_id, attr, c_custkey AS orig_id, row_id AS new_id, value FROM ({C.TRUTH_SQL}) t""")
def renumber_ids(spark, sf):
    """Pair ids renumbered to their 1-based position in each attribute list."""
    return finalize(C.truth(spark, sf).select("entry_id", "attr", F.col("c_custkey").alias("orig_id"),
                                              F.col("row_id").alias("new_id"), "value"))


@query("gt_flatten", f"""SELECT entry_id, attr, row_id, kind, v FROM (
  SELECT entry_id, attr, row_id, 'id' AS kind, row_id AS v FROM ({C.TRUTH_SQL}) a
  UNION ALL SELECT entry_id, attr, row_id, 'value', value FROM ({C.TRUTH_SQL}) b) x
WHERE v <> '' AND lower(v) NOT IN ('none', 'null', 'na')""")
def gt_flatten(spark, sf):
    """Ground truth deep-flattened to scalar strings, ids included, empty and
    none/null/na dropped (B12)."""
    t = C.truth(spark, sf)
    x = t.select("entry_id", "attr", "row_id", F.inline(F.array(
        F.struct(F.lit("id").alias("kind"), F.col("row_id").alias("v")),
        F.struct(F.lit("value").alias("kind"), F.col("value").alias("v")))))
    return finalize(x.filter((F.col("v") != "") & ~F.lower("v").isin("none", "null", "na")))


def contained_passages(spark, sf):
    """(doc_id, item_id) where the lower-cased passage occurs in the lower-cased document."""
    d, b = tables(spark, sf, "documents", "benchmark")
    return contained(d, b, "doc_id", "text", "item_id", "text")


@query("containment_filter", """SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b
ON instr(lower(d.text), lower(b.text)) > 0""")
def containment_filter(spark, sf):
    return finalize(contained_passages(spark, sf))


@query("drop_empty_entries", """WITH h AS (SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b
  ON instr(lower(d.text), lower(b.text)) > 0),
e AS (SELECT d.doc_id, count(h.item_id) AS n_entities, l.doc_id IS NOT NULL AS has_kv FROM documents d
      LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, l.doc_id)
SELECT doc_id, n_entities, has_kv FROM e WHERE NOT (n_entities = 0 AND NOT has_kv)""")
def drop_empty_entries(spark, sf):
    """Entries with no entities and no key/values dropped (B10); ``has_kv``
    is the B11 keep flag. Entities = contained benchmark passages, key/values =
    the document's labels."""
    d, l = tables(spark, sf, "documents", "labels")
    n = contained_passages(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"))
    e = (d.select("doc_id").join(n, "doc_id", "left")
         .join(l.select("doc_id", F.lit(True).alias("has_kv")), "doc_id", "left")
         .select("doc_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
                 F.coalesce("has_kv", F.lit(False)).alias("has_kv")))
    return finalize(e.filter(~((F.col("n_entities") == 0) & ~F.col("has_kv"))))


@query("stage_stitch", """SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def stage_stitch(spark, sf):
    """Stage results joined by entry id, not by position (A11, Q7 fixed)."""
    d, l = tables(spark, sf, "documents", "labels")
    return finalize(d.select("doc_id", "n_chars").join(l, "doc_id"))


@query("resume_antijoin", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'done' END AS status,
       coalesce(CAST(l.quality AS VARCHAR), 'len:' || CAST(d.n_chars AS VARCHAR)) AS filled
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def resume_antijoin(spark, sf):
    """Resume (A8, A9, C12, I11): entries already processed (labelled) are
    kept, the rest are the anti-join and get the filler's output; a
    ``coalesce`` merges the two by key."""
    d, l = tables(spark, sf, "documents", "labels")
    todo = pending(d.select("doc_id", "n_chars"), l, "doc_id")
    fresh = todo.select("doc_id", F.lit("pending").alias("status"),
                        F.concat(F.lit("len:"), F.col("n_chars").cast("string")).alias("filled"))
    done = d.select("doc_id").join(l, "doc_id").select("doc_id", F.lit("done").alias("status"),
                                                     F.col("quality").cast("string").alias("filled"))
    return finalize(done.unionByName(fresh))


@query("prepare_dataset", """SELECT DISTINCT * FROM (
  SELECT 'customer' AS dataset, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier
  UNION ALL SELECT 'nation', n_name, NULL, NULL FROM nation) x WHERE dataset NOT IN ('nation')""")
def prepare_dataset(spark, sf):
    """Three datasets with suffixed and id columns: rename (B3), drop ``id``/``_y``
    columns and strip ``_x`` (B2), drop named columns (B1), union (F1), exclude a
    dataset by name (B16), distinct rows (F4)."""
    c, s, n = tables(spark, sf, "customer", "supplier", "nation")
    n2 = rename(n, {"n_name": "name_x", "n_nationkey": "nationid", "n_regionkey": "region"})
    n3 = drop_pattern_columns(drop_columns(n2, ["region"])).withColumn("dataset", F.lit("nation"))
    c2 = rename(c, {"c_custkey": "custid", "c_name": "name_x", "c_acctbal": "acctbal_x",
                    "c_mktsegment": "segment", "c_nationkey": "nation_y"})
    s2 = rename(s, {"s_suppkey": "suppid", "s_name": "name_x", "s_acctbal": "acctbal_x", "s_nationkey": "nation_y"})
    c3 = drop_pattern_columns(c2).withColumn("dataset", F.lit("customer"))
    s3 = drop_pattern_columns(s2).withColumn("dataset", F.lit("supplier"))
    u = union_results([c3, s3, n3])
    return finalize(exclude_values(u, "dataset", ["nation"]).distinct()
                    .select("dataset", "name", "acctbal", "segment"))


# Table names that get the suffix 1.
RESERVED = ["transaction", "order", "group", "select", "insert", "update", "delete", "from", "where", "join"]
PLACEHOLDER = ("table_name", "column_name", "value")


@query("cells_clean", """WITH raw AS (
  SELECT 'region' AS table_name, CAST(r_regionkey AS VARCHAR) AS row_key, 'r_name' AS column_name, r_name AS value FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'n_name', n_name FROM nation
  UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'o_orderstatus', o_orderstatus FROM orders),
nz AS (SELECT table_name, row_key, column_name,
  """ + _sql_hex("'cc'", "table_name", "row_key") + """ AS h, value FROM raw),
noisy AS (SELECT CASE WHEN h = 2 THEN 'table_name' ELSE table_name END AS table_name, row_key,
                 CASE WHEN h = 2 THEN 'column_name' ELSE column_name END AS column_name,
                 CASE WHEN h = 0 THEN '#' WHEN h = 1 THEN '?' WHEN h = 2 THEN 'value' ELSE value END AS value FROM nz)
SELECT CASE WHEN table_name IN (""" + ", ".join(f"'{r}'" for r in RESERVED) + """) THEN table_name || '1'
            ELSE table_name END AS table_name, row_key, column_name,
       CASE WHEN value IN ('#', '?') THEN NULL ELSE value END AS value
FROM noisy WHERE lower(table_name) <> 'table_name' AND lower(column_name) <> 'column_name' AND lower(value) <> 'value'""")
def cells_clean(spark, sf):
    """Cell cleanup (G20, G21, B15): whole-cell ``#`` and ``?`` become NULL,
    reserved table names get the suffix 1, header-word placeholder rows are
    dropped (any of the three parts, Q14 fixed)."""
    r, n, o = tables(spark, sf, "region", "nation", "orders")
    raw = union_results([
        r.select(F.lit("region").alias("table_name"), F.col("r_regionkey").cast("string").alias("row_key"),
                 F.lit("r_name").alias("column_name"), F.col("r_name").alias("value")),
        n.select(F.lit("nation").alias("table_name"), F.col("n_nationkey").cast("string").alias("row_key"),
                 F.lit("n_name").alias("column_name"), F.col("n_name").alias("value")),
        o.select(F.lit("order").alias("table_name"), F.col("o_orderkey").cast("string").alias("row_key"),
                 F.lit("o_orderstatus").alias("column_name"), F.col("o_orderstatus").alias("value"))])
    h = hex_digit(F.lit("cc"), F.col("table_name"), F.col("row_key"))
    noisy = raw.select(F.when(h == 2, F.lit("table_name")).otherwise(F.col("table_name")).alias("table_name"),
                       "row_key",
                       F.when(h == 2, F.lit("column_name")).otherwise(F.col("column_name")).alias("column_name"),
                       F.when(h == 0, "#").when(h == 1, "?").when(h == 2, "value").otherwise(F.col("value"))
                       .alias("value"))
    kept = placeholder_filter(noisy, ["table_name", "column_name", "value"], list(PLACEHOLDER))
    out = kept.select(F.when(F.col("table_name").isin(RESERVED), F.concat("table_name", F.lit("1")))
                      .otherwise(F.col("table_name")).alias("table_name"), "row_key", "column_name",
                      F.when(F.col("value").isin("#", "?"), F.lit(None)).otherwise(F.col("value")).alias("value"))
    return finalize(out)


_MENTION_SQL = f"""WITH t AS ({C.TRUTH_SQL}), e AS ({C.ENTRIES_SQL}),
p AS (SELECT t.entry_id, t.attr, t.row_id, CASE WHEN {_sql_hex("'men'", 't.entry_id', 't.attr', 't.row_id')} < 3 THEN reverse(t.value) ELSE t.value END AS value FROM t),
k AS (SELECT p.* FROM p JOIN e ON e.entry_id = p.entry_id WHERE instr(lower(e.text), lower(p.value)) > 0)"""


@query("mentioned_pairs", _MENTION_SQL + """
SELECT entry_id, attr, string_agg(row_id || '=' || value, '; ' ORDER BY CAST(row_id AS INTEGER)) AS pairs FROM k GROUP BY entry_id, attr""")
def mentioned_pairs(spark, sf):
    """Key/value pairs whose value the entry's text mentions; an attribute left
    without pairs goes (B9, B10). Three of sixteen values, by md5, are reversed."""
    t = C.truth(spark, sf)
    off = hex_digit(F.lit("men"), F.col("entry_id").cast("string"), F.col("attr"), F.col("row_id")) < 3
    p = t.select("entry_id", "attr", F.col("row_id").cast("int").alias("pos"), F.when(off, F.reverse("value")).otherwise(F.col("value")).alias("value"))
    g = p.groupBy("entry_id", "attr").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("pairs"))
    j = g.join(C.entries(spark, sf).select("entry_id", F.lower("text").alias("lt")), "entry_id")
    kept = keep_mentioned(F.col("pairs"), F.col("lt"), lambda x: x["value"])
    j = j.select("entry_id", "attr", kept.alias("pairs")).filter(F.size("pairs") > 0)
    return finalize(j.select("entry_id", "attr", F.array_join(F.transform("pairs", lambda x: F.concat_ws("=", x["pos"].cast("string"), x["value"])), "; ").alias("pairs")))


@query("drop_empty_key_values", """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def drop_empty_key_values(spark, sf):
    """Entries whose key/value map is empty are dropped (B11); a document's map
    holds its labels."""
    d, l = tables(spark, sf, "documents", "labels")
    kv = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))
    e = d.select("doc_id").join(l.select("doc_id", kv.alias("kv")), "doc_id", "left")
    e = e.withColumn("kv", F.coalesce("kv", F.create_map().cast("map<string,string>"))).filter(F.size("kv") > 0)
    return finalize(e.select("doc_id", F.col("kv")["quality"].alias("quality"), F.col("kv")["toxic"].alias("toxic")))
