"""Extraction stages and similarity queries (G12, J2, J4, J5, J6, I10, E12,
H2, H3, H5, H6, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import finalize, materialize, split_lines, split_sentences
from relweave.operators.dependencies import minimal_dependencies
from relweave.operators.extract import bind_passes, extract_passes, rule_extract, table_of
from relweave.operators.joins import union_results
from relweave.operators.simjoin import best_partners
from relweave.operators.similarity import near_duplicates
from relweave.operators.vectors import drop_near_copies
from relweave.plans import common as C
from relweave.plans import q_metrics as M
from relweave.plans.q_catalog import CATALOG_SQL, catalog
from relweave.plans.q_clean import _sql_hex, hex_digit
from relweave.plans.registry import query
from relweave.sources.tables import read_table, tables


@query("paragraph_superkeys", """SELECT doc_id, CAST(u.o - 1 AS BIGINT) AS para_pos, CAST(u.o AS VARCHAR) AS superkey,
       count(*) OVER (PARTITION BY doc_id, u.p) > 1 AS repeated
FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(p, o)""")
def paragraph_superkeys(spark, sf):
    """One key per paragraph (J2): the 1-based paragraph number fallback, and
    whether the same paragraph repeats inside the document, which the document's
    row finds from its sorted paragraphs."""
    d = read_table(spark, sf, "documents")
    p = materialize(d, ["doc_id"], paras=split_lines("text"))
    p = materialize(p, ["doc_id", "paras"], line_up=F.array_sort("paras"))
    p = materialize(p, ["doc_id", "paras"], twice=F.array_distinct(F.filter("line_up", lambda x, i: (i > 0) & (x == F.get("line_up", i - 1)))))
    p = p.select("doc_id", "twice", F.posexplode("paras").alias("para_pos", "p"))
    return finalize(p.select("doc_id", "para_pos", (F.col("para_pos") + 1).cast("string").alias("superkey"),
                             F.array_contains("twice", F.col("p")).alias("repeated")))


@query("schema_bound_facts", f"""WITH {CATALOG_SQL}
SELECT f.entry_id, f.line_pos, c.table_name, c.column_name, f.value FROM f
JOIN cat c ON c.domain = f.domain AND lower(c.column_name) = lower(f.attr)""")
def schema_bound_facts(spark, sf):
    """Open facts bound to the discovered schema by normalised column name
    (J4). The catalog is one row per (domain, column): a small side that AQE
    broadcasts, so hot domains do not meet in one task."""
    f = rule_extract(C.entries(spark, sf)).join(M.entry_domains(spark, sf), "entry_id")
    cat = catalog(spark, sf).select("domain", "table_name", "column_name")
    j = f.join(cat, (f.domain == cat.domain) & (F.lower(f.attr) == F.lower(cat.column_name)))
    return finalize(j.select("entry_id", "line_pos", "table_name", "column_name", "value"))


_TABLE_SQL = "CASE " + " ".join(f"WHEN starts_with(attr, '{p}') THEN '{t}'" for p, t in M.PREFIX_TABLE.items()) + " END"
_BOUND_SQL = "attr IN (" + ", ".join(f"'{c}'" for c in C.CUST_COLS) + ")"
_CELLS_SQL = f"""f AS ({C.FACTS_SQL}),
cells AS (SELECT 'ts' AS method, entry_id, line_pos, {_TABLE_SQL} AS table_name, attr, value FROM f
  UNION ALL SELECT 'tst', entry_id, line_pos, {_TABLE_SQL}, attr, value FROM f WHERE {_BOUND_SQL}
  UNION ALL SELECT 'tst_l', entry_id, line_pos, {_TABLE_SQL}, attr, value FROM f WHERE {_BOUND_SQL}
              AND (attr <> 'c_acctbal' OR TRY_CAST(value AS DOUBLE) IS NOT NULL)
              AND (attr <> 'c_nationkey' OR (regexp_matches(value, '^\\s*[+-]?[0-9]+\\s*$') AND TRY_CAST(value AS BIGINT) IS NOT NULL))
  UNION ALL SELECT 'baseline', entry_id, line_pos, 'data', attr, value FROM f)"""


def population_cells(spark, sf):
    """(method, entry_id, line_pos, table_name, attr, value): four ways to populate
    tables from the same entries (J5, J6): text only (ts), facts bound to the
    schema (tst), bound and typed (tst_l), and one wide table (baseline)."""
    f = rule_extract(C.entries(spark, sf)).withColumn("table_name", table_of("attr", M.PREFIX_TABLE))
    bound = F.col("attr").isin(*C.CUST_COLS)
    typed = (((F.col("attr") != "c_acctbal") | F.col("value").try_cast("double").isNotNull())
             & ((F.col("attr") != "c_nationkey") | F.col("value").try_cast("bigint").isNotNull()))
    # one pass over the facts: the methods that take a fact, with the table it goes to
    ways = F.array_compact(F.array(
        F.when(F.col("table_name").isNotNull(), F.struct(F.lit("ts").alias("method"), F.col("table_name").alias("t"))),
        F.when(bound & F.col("table_name").isNotNull(), F.struct(F.lit("tst").alias("method"), F.col("table_name").alias("t"))),
        F.when(bound & typed & F.col("table_name").isNotNull(), F.struct(F.lit("tst_l").alias("method"), F.col("table_name").alias("t"))),
        F.struct(F.lit("baseline").alias("method"), F.lit("data").alias("t"))))
    return (f.select("entry_id", "line_pos", "attr", "value", F.inline(ways))
            .select("method", "entry_id", "line_pos", F.col("t").alias("table_name"), "attr", "value"))


@query("population_strategies", f"""WITH {_CELLS_SQL}
SELECT method, count(*) AS n_cells, count(DISTINCT (entry_id, line_pos)) AS n_rows,
       count(DISTINCT table_name) AS n_tables FROM cells WHERE table_name IS NOT NULL GROUP BY method""")
def population_strategies(spark, sf):
    """Cells, rows and tables that each way of populating makes."""
    return finalize(population_cells(spark, sf).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("entry_id", "line_pos").alias("n_rows"),
        F.count_distinct("table_name").alias("n_tables")))


@query("population_cells", f"""WITH {_CELLS_SQL}
SELECT method, entry_id, line_pos, table_name, attr, value FROM cells WHERE table_name IS NOT NULL""")
def population_cells_q(spark, sf):
    return finalize(population_cells(spark, sf))


FDS = [("c_nationkey", "n_name"), ("n_name", "n_regionkey"), ("c_mktsegment", "c_nationkey"),
       ("n_regionkey", "n_nationkey")]


@query("functional_dependency", " UNION ALL ".join(
    f"""SELECT '{x}' AS lhs, '{y}' AS rhs, count(*) AS n_groups, count(*) FILTER (WHERE k > 1) AS n_violating,
       count(*) FILTER (WHERE k > 1) = 0 AS holds FROM (SELECT {x}, count(DISTINCT {y}) AS k
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY {x}) g""" for x, y in FDS))
def functional_dependency(spark, sf):
    """X -> Y holds when every X value has one Y value (I10), over customer
    joined to nation; distinct (x, y) pairs are reduced before counting."""
    c, n = tables(spark, sf, "customer", "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    outs = []
    for x, y in FDS:
        g = j.select(x, y).distinct().groupBy(x).agg(F.count(F.lit(1)).alias("k"))
        outs.append(g.agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(F.col("k") > 1, 1)).alias("n_violating"))
                    .select(F.lit(x).alias("lhs"), F.lit(y).alias("rhs"), "n_groups", "n_violating",
                            (F.col("n_violating") == 0).alias("holds")))
    return finalize(union_results(outs))


DEPENDENT = ["c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]


def _dependencies_sql(columns: list[str], most: int = 2) -> str:
    """Each candidate by itself, then those without a smaller one."""
    from itertools import combinations

    per = []
    for k in range(most + 1):
        for x in combinations(columns, k):
            for a in columns:
                if a not in x:
                    left = f"count(DISTINCT ({', '.join(x)}, 0))" if x else "1"
                    per.append(f"SELECT '{','.join(x)}' AS lhs, [{', '.join(repr(c) for c in x)}]::VARCHAR[] AS xs, '{a}' AS rhs, {left} = count(DISTINCT ({', '.join([*x, a])}, 0)) AS holds FROM w")
    return f"""WITH w AS (SELECT {', '.join(columns)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT * FROM ({' UNION ALL '.join(per)}) x WHERE holds)
SELECT lhs, rhs FROM h WHERE NOT EXISTS (SELECT 1 FROM h s WHERE s.rhs = h.rhs AND len(s.xs) < len(h.xs) AND list_has_all(h.xs, s.xs))"""


@query("dependency_discovery", _dependencies_sql(DEPENDENT))
def dependency_discovery(spark, sf):
    """All minimal dependencies with at most two left columns (I10) of customers
    joined to nations and regions, searched level by level."""
    c, n, r = tables(spark, sf, "customer", "nation", "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    found = minimal_dependencies(j, DEPENDENT)
    return spark.createDataFrame([(",".join(x), a) for x, a in found], "lhs string, rhs string")


def _rewritten(spark, sf):
    """Entries whose items are written, by md5, as ``attr is v``, ``ATTR: v``, ``the attr equals v``, or not as a fact."""
    f = rule_extract(C.entries(spark, sf))
    h = hex_digit(F.lit("ps"), F.col("entry_id").cast("string"), F.col("line_pos").cast("string"), F.col("fact_pos").cast("string"))
    item = (F.when(h < 4, F.concat(F.upper(F.replace("attr", F.lit("_"), F.lit(" "))), F.lit(": "), "value")).when(h < 6, F.concat(F.lit("the "), "attr", F.lit(" equals "), "value"))
            .when(h == 6, F.concat(F.lit("about "), "attr")).otherwise(F.concat("attr", F.lit(" is "), "value")))
    lines = f.groupBy("entry_id", "line_pos").agg(F.array_sort(F.collect_list(F.struct("fact_pos", item.alias("item")))).alias("i"))
    lines = lines.select("entry_id", F.struct("line_pos", F.concat(F.array_join(F.col("i.item"), ", "), F.lit(".")).alias("t")).alias("x"))
    return lines.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["t"], "\n").alias("text"))


_PASS_SQL = f"""ph AS (SELECT *, {_sql_hex("'ps'", 'CAST(entry_id AS VARCHAR)', 'CAST(line_pos AS VARCHAR)', 'CAST(fact_pos AS VARCHAR)')} AS h FROM ({C.FACTS_SQL}) z),
pf AS (SELECT entry_id, dense_rank() OVER (PARTITION BY entry_id ORDER BY line_pos) - 1 AS line_pos, h,
         CASE WHEN h < 4 THEN 2 WHEN h < 6 THEN 3 ELSE 1 END AS pass, CASE WHEN h < 4 THEN upper(replace(attr, '_', ' ')) ELSE attr END AS attr, attr AS own, value FROM ph)"""


@query("extraction_passes", f"""WITH {_PASS_SQL} SELECT entry_id, line_pos, pass, attr, value FROM pf WHERE h <> 6""")
def extraction_passes(spark, sf):
    """Open facts in three passes (J3): what one leaves uncovered, the next, wider one reads."""
    return finalize(extract_passes(_rewritten(spark, sf)))


@query("bound_passes", f"""WITH {CATALOG_SQL}, {_PASS_SQL}, dm AS (SELECT DISTINCT entry_id, domain FROM f)
SELECT p.entry_id, p.line_pos, p.pass, c.table_name, c.column_name, p.value, CASE WHEN p.h < 4 THEN 2 ELSE 1 END AS bound_pass
FROM pf p JOIN dm ON dm.entry_id = p.entry_id JOIN cat c ON c.domain = dm.domain AND lower(c.column_name) = lower(p.own) WHERE p.h <> 6""")
def bound_passes(spark, sf):
    """The same facts bound to the schema (J4): by name, and those left by the name with
    blanks for underscores."""
    f = extract_passes(_rewritten(spark, sf)).join(M.entry_domains(spark, sf), "entry_id")
    names = [F.lower("attr"), F.regexp_replace(F.lower(F.trim("attr")), r"[\s-]+", "_")]
    return finalize(bind_passes(f, catalog(spark, sf), names).select("entry_id", "line_pos", "pass", "table_name", "column_name", "value", "bound_pass"))


def _nouns(sentences):
    words = F.flatten(F.transform(sentences, lambda s: F.split(s, r"\s+")))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\pL\pN]+|[^\pL\pN]+$", ""))
    return F.filter(bare, lambda t: t.rlike(r"^\pN+$") | t.rlike(r"^\p{Lu}"))


def _fact_texts(text):
    """``attr | is | value`` of a text's facts, ordered by item."""
    lines = F.transform(split_lines(text), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\.$", ""))
    items = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, ", "))), lambda x: F.instr(x, " is ") > 0)
    return F.transform(F.array_sort(items), lambda x: F.concat(
        F.substr(x, F.lit(1), F.instr(x, " is ") - 1), F.lit(" | is | "), F.substr(x, F.instr(x, " is ") + 4)))


@query("noun_coverage", r"""WITH s AS (SELECT d.doc_id, u.s FROM documents d, unnest(list_filter(list_transform(
        string_split(regexp_replace(d.text, '\.\s+', '.' || chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS u(s)),
t AS (SELECT doc_id, regexp_replace(w, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') AS tok
      FROM s, unnest(string_split_regex(s.s, '\s+')) AS v(w)),
c AS (SELECT doc_id, tok FROM t WHERE regexp_matches(tok, '^\pN+$') OR regexp_matches(tok, '^\p{Lu}')),
l AS (SELECT d.doc_id, u.line FROM documents d, unnest(string_split(d.text, chr(10))) AS u(line)),
i AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\.$', ''), ', ')) AS item FROM l),
fa AS (SELECT doc_id, string_agg(substr(item, 1, instr(item, ' is ') - 1) || ' | is | ' || substr(item, instr(item, ' is ') + 4),
                                 ' || ' ORDER BY item) AS blob FROM i WHERE instr(item, ' is ') > 0 GROUP BY doc_id),
pt AS (SELECT DISTINCT doc_id, unnest([substr(item, 1, instr(item, ' is ') - 1), substr(item, instr(item, ' is ') + 4)]) AS part
       FROM i WHERE instr(item, ' is ') > 0)
SELECT d.doc_id, count(c.tok) AS n_tokens,
       count(c.tok) FILTER (WHERE fa.blob IS NULL OR instr(fa.blob, c.tok) = 0) AS n_uncovered,
       count(DISTINCT c.tok) FILTER (WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.doc_id = c.doc_id AND pt.part = c.tok)) AS n_not_a_value
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN fa ON fa.doc_id = d.doc_id GROUP BY d.doc_id""")
def noun_coverage(spark, sf):
    """Candidate nouns (numbers, capitalised words; a POS tagger can replace the
    rule) that no extracted fact covers (G12, F6), by substring of the
    document's facts and by equality with a fact's value. Tokens and facts stay
    in the document's row."""
    d = read_table(spark, sf, "documents")
    d = materialize(d, ["doc_id"], nouns=_nouns(split_sentences("text")), facts=_fact_texts("text"))
    d = materialize(d, ["doc_id", "nouns"], blob=F.array_join("facts", " || "),
                    parts=F.array_distinct(F.flatten(F.transform("facts", lambda x: F.split(x, r" \| is \| ")))))
    # a noun that repeats is looked up once
    d = materialize(d, ["doc_id", "nouns", "parts"], lacking=F.filter(F.array_distinct("nouns"), lambda t: F.instr(F.col("blob"), t) == 0))
    return finalize(d.select("doc_id", F.size("nouns").alias("n_tokens"),
                             F.size(F.filter("nouns", lambda t: F.array_contains(F.col("lacking"), t))).alias("n_uncovered"),
                             F.size(F.array_except("nouns", "parts")).alias("n_not_a_value")))


@query("string_similarity_topk", """WITH n AS (SELECT DISTINCT p_name AS s FROM part),
pr AS (SELECT a.s AS a, b.s AS b FROM n a JOIN n b ON a.s <> b.s),
""" + M.sql_cos("s", "SELECT a, b FROM pr") + """
SELECT n.s AS name, round(coalesce(max(cos), 0.0), 6) AS best, arg_max(scs.b, (cos, scs.b)) FILTER (WHERE cos > 0) AS best_match,
       count(*) FILTER (WHERE cos >= 0.5) AS n_similar
FROM n LEFT JOIN scs ON scs.a = n.s GROUP BY n.s""")
def string_similarity_topk(spark, sf):
    """For each distinct part name the nearest of all other names, its cosine, and
    how many score >= 0.5 (H2, H3, E12), by a join on prefixes of rare grams."""
    best = best_partners(read_table(spark, sf, "part"), "p_name")
    return finalize(best.withColumnRenamed("s", "name"))


# Cosine above which a fact or a cell repeats an earlier one.
FACT_T, CELL_T = 0.97, 0.99


def _near_dup_sql(items: str, least: float) -> str:
    """SQL for items(entry_id, line_pos, pos, t): kept unless an earlier one is too close."""
    return f"""WITH {items},
pr AS (SELECT a.entry_id, a.line_pos, a.pos AS pi, b.pos AS pj, a.t AS a, b.t AS b FROM items a JOIN items b
       ON a.entry_id = b.entry_id AND a.line_pos = b.line_pos AND a.pos < b.pos),
{M.sql_cos('n', 'SELECT a, b FROM pr')},
gone AS (SELECT DISTINCT pr.entry_id, pr.line_pos, pr.pj FROM pr JOIN ncs ON ncs.a = pr.a AND ncs.b = pr.b WHERE ncs.cos > {least})
SELECT i.entry_id, i.line_pos, i.pos, i.t FROM items i
LEFT JOIN gone g ON g.entry_id = i.entry_id AND g.line_pos = i.line_pos AND g.pj = i.pos WHERE g.pj IS NULL"""


def _copies(spark, sf):
    """Facts of every entry, and by md5 a second mention of one in four: the same,
    or with one more letter. Positions follow the facts, copies after originals."""
    f = rule_extract(C.entries(spark, sf))
    h = hex_digit(F.lit("dup"), F.col("entry_id").cast("string"), F.col("line_pos").cast("string"), F.col("fact_pos").cast("string"))
    again = F.when(h < 2, F.col("value")).when(h < 4, F.concat("value", F.lit("s")))
    both = F.array_compact(F.array(F.struct(F.lit(0).alias("copy"), F.col("value").alias("v")),
                                   F.when(again.isNotNull(), F.struct(F.lit(1).alias("copy"), again.alias("v")))))
    return f.select("entry_id", "line_pos", "fact_pos", "attr", F.inline(both))


_COPIES_SQL = f"""ff AS ({C.FACTS_SQL}),
hh AS (SELECT *, {_sql_hex("'dup'", 'CAST(entry_id AS VARCHAR)', 'CAST(line_pos AS VARCHAR)', 'CAST(fact_pos AS VARCHAR)')} AS h FROM ff),
cp AS (SELECT entry_id, line_pos, fact_pos, attr, 0 AS copy, value AS v FROM hh
       UNION ALL SELECT entry_id, line_pos, fact_pos, attr, 1, CASE WHEN h < 2 THEN value ELSE value || 's' END FROM hh WHERE h < 4)"""


def _kept(items, threshold):
    """Items (entry_id, line_pos, order columns o, text t) that stay, one row per paragraph."""
    g = items.groupBy("entry_id", "line_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]).alias("ts"))
    kept = F.transform(near_duplicates(F.col("ts"), threshold), lambda j: F.struct(j.alias("pos"), F.get("ts", j).alias("t")))
    return g.select("entry_id", "line_pos", F.inline(kept))


@query("near_dup_facts", _near_dup_sql(_COPIES_SQL + """,
items AS (SELECT entry_id, line_pos, row_number() OVER (PARTITION BY entry_id, line_pos ORDER BY copy, fact_pos) - 1 AS pos,
                 'row | ' || attr || ' | ' || v AS t FROM cp)""", FACT_T))
def near_dup_facts(spark, sf):
    """Near-duplicate facts inside a paragraph removed (H5): compared as ``subject |
    relation | object``; a fact goes when an earlier one has cosine > 0.97, even
    if that one goes too."""
    c = _copies(spark, sf)
    items = c.select("entry_id", "line_pos", F.struct("copy", "fact_pos").alias("o"), F.concat(F.lit("row | "), "attr", F.lit(" | "), "v").alias("t"))
    return finalize(_kept(items, FACT_T))


@query("near_dup_cells", _near_dup_sql(_COPIES_SQL + f""",
items AS (SELECT entry_id, line_pos, row_number() OVER (PARTITION BY entry_id, line_pos ORDER BY copy, fact_pos) - 1 AS pos,
                 ({_TABLE_SQL}) || ' | ' || attr || ' | ' || v AS t FROM cp WHERE ({_TABLE_SQL}) IS NOT NULL AND {_BOUND_SQL})""", CELL_T))
def near_dup_cells(spark, sf):
    """Near-duplicate schema-bound values inside a paragraph removed (H6): compared
    as ``table | column | value`` at 0.99."""
    c = _copies(spark, sf).withColumn("table_name", table_of("attr", M.PREFIX_TABLE)).filter(F.col("table_name").isNotNull() & F.col("attr").isin(*C.CUST_COLS))
    items = c.select("entry_id", "line_pos", F.struct("copy", "fact_pos").alias("o"), F.concat_ws(" | ", "table_name", "attr", "v").alias("t"))
    return finalize(_kept(items, CELL_T))


NEAR_DUP_T = 0.97
_PLANTED = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  UNION ALL SELECT vec_id + 1000000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i = 1 THEN x + 0.05 ELSE x END) FROM embeddings WHERE vec_id % 10 = 3
  UNION ALL SELECT vec_id + 2000000000, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 100 = 7)"""


@query("near_dup_vectors", f"""WITH {_PLANTED}
SELECT vec_id FROM v e WHERE NOT EXISTS (SELECT 1 FROM v a WHERE a.vec_id < e.vec_id AND list_cosine_similarity(a.e, e.e) > {NEAR_DUP_T})""")
def near_dup_vectors(spark, sf):
    """Vectors without a near copy of a smaller id (H6), over the table and copies
    derived from it: one in ten with its first component moved, one in a hundred as it is."""
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    moved = e.where("vec_id % 10 = 3").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i == 0, x + 0.05).otherwise(x)).alias("embedding"))
    same = e.where("vec_id % 100 = 7").select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), "embedding")
    return finalize(drop_near_copies(union_results([e, moved, same]), NEAR_DUP_T))
