"""Quality metrics: row matching, value/tuple/column coverage, entity
coverage (C7-C9, H1, H4, D9, D11, D12, D14-D16).

Ground truth comes from customer profiles batched into entries. "Predicted"
databases for three extraction methods are the truth cells with md5-chosen
drops, corruptions, wrong row ids and missing databases, so scores are not
trivially 1 and both engines can rebuild them exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import finalize, materialize
from relweave.operators import coverage as V
from relweave.operators.coverage import CC_T, COLUMN_T, TC_T, VALUE_T
from relweave.operators.rescore import match_rows
from relweave.operators.similarity import best_matches, with_grams
from relweave.plans import common as C
from relweave.plans.registry import query
from relweave.session import spread

# Method name, drop share, corrupt share, missing-database share, rank.
METHODS = [("staged", 0.05, 0.10, 0.02, 0), ("tst", 0.10, 0.10, 0.05, 1), ("single_shot", 0.35, 0.15, 0.10, 2)]
PREFIX_TABLE = {"c_": "customer", "n_": "nation", "r_": "region"}


def hunit(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10) \
        .cast("bigint") / F.lit(4294967296.0)


def entry_domains(spark, sf):
    p = C.customer_profile(spark, sf).withColumn("entry_id", F.floor(F.col("c_custkey") / C.BATCH))
    return p.groupBy("entry_id").agg(F.min_by("domain", "c_custkey").alias("domain"))


def truth_items(spark, sf):
    return C.truth(spark, sf).select("entry_id", "attr", "row_id", "value")


def pred_cells(spark, sf):
    """(method, method_rank, entry_id, table_name, row_pos, id_val, column_name, value)."""
    t = truth_items(spark, sf)
    ms = F.array(*[F.struct(F.lit(n).alias("method"), F.lit(d).alias("drop"), F.lit(a).alias("alter"),
                            F.lit(x).alias("dbmiss"), F.lit(r).alias("method_rank")) for n, d, a, x, r in METHODS])
    m = t.select("*", F.inline(ms))
    u = hunit(F.lit("pred"), F.col("method"), F.col("entry_id"), F.col("attr"), F.col("row_id"))
    dbu = hunit(F.lit("db"), F.col("method"), F.col("entry_id"))
    tbl = F.lit(None).cast("string")
    for p, tn in PREFIX_TABLE.items():
        tbl = F.when(F.col("attr").startswith(p), F.lit(tn)).otherwise(tbl)
    rid = F.col("row_id").cast("int")
    return (m.filter((u >= F.col("drop")) & (dbu >= F.col("dbmiss")))
            .select("method", "method_rank", "entry_id",
                    F.when(F.col("method") == "single_shot", F.lit("data")).otherwise(tbl).alias("table_name"),
                    (rid - 1).alias("row_pos"),
                    F.when(hunit(F.lit("rid"), F.col("method"), F.col("entry_id"), F.col("row_id")) < 0.1,
                           (rid + 10).cast("string")).otherwise(F.col("row_id")).alias("id_val"),
                    F.when(F.col("method") == "tst", F.expr("substring(attr, 3)")).otherwise(F.col("attr"))
                    .alias("column_name"),
                    F.when(u < F.col("drop") + F.col("alter"), F.reverse("value")).otherwise(F.col("value"))
                    .alias("value")))


CELL = "array<struct<method:string,row_pos:int,id_val:string,column_name:string,value:string>>"


def entry_frame(spark, sf):
    """One row per entry: domain, truth and the predicted cells of all methods.
    All three are grouped by the entry, so they meet without a further shuffle."""
    truth = truth_items(spark, sf).groupBy("entry_id").agg(F.collect_list(F.struct("attr", "row_id", "value")).alias("truth"))
    cells = pred_cells(spark, sf).groupBy("entry_id").agg(
        F.collect_list(F.struct("method", "row_pos", "id_val", "column_name", "value")).alias("pred"))
    e = (entry_domains(spark, sf).join(truth, "entry_id", "left").join(cells, "entry_id", "left")
         .select("entry_id", "domain", F.coalesce("truth", F.array().cast("array<struct<attr:string,row_id:string,value:string>>")).alias("truth"),
                 F.coalesce("pred", F.array().cast(CELL)).alias("pred")))
    return spread(e, "entry_id")


def _databases(pred):
    """array<struct<method, cells>>: each method's cells, its id column included."""
    def one(name):
        mine = F.filter(pred, lambda c: c["method"] == name)
        return F.struct(F.lit(name).alias("method"), V.with_id_cells(mine, lambda c: c["id_val"]).alias("cells"))
    return F.array(*[one(n) for n, *_ in METHODS])


def scored(spark, sf, score, targets):
    """(method, entry_id, domain, score): ``targets`` once per entry from its truth
    and all its cells, ``score`` for each of its databases."""
    e = materialize(entry_frame(spark, sf), ["entry_id", "domain", "truth"], dbs=_databases(F.col("pred")))
    e = materialize(e, ["entry_id", "domain", "dbs"], targets=targets(F.col("truth"), F.flatten(F.transform("dbs", lambda d: d["cells"]))))
    per = F.transform("dbs", lambda d: F.struct(d["method"].alias("method"), F.when(
        F.size(d["cells"]) > 0, score(F.col("targets"), d["cells"])).otherwise(0.0).alias("score")))
    return e.select("entry_id", "domain", F.inline(per))


# ------------------------------------------------------------------ C7 + H4

def row_match(spark, sf):
    """Per (method, entry): avg_row_accuracy, match_accuracy,
    match_in_right_column_accuracy; -1 for all three when the database has no
    rows (H4 with C7's positional fallback)."""
    return match_rows(entry_frame(spark, sf), [n for n, *_ in METHODS], VALUE_T, COLUMN_T)


# ------------------------------------------------------------------ D14-D16

def _value_targets(truth, cells):
    return V.value_targets(truth, F.transform(cells, lambda c: c["value"]))


def value_coverage(spark, sf):
    """VC (D15): share of truth values contained in the lower-cased cells of
    the entry's database joined by `` | ``; 0 when either side is empty."""
    plain = lambda truth, cells: F.transform(V.counted(V.truth_values(truth)), lambda c: F.struct(F.lower(c["v"]).alias("lv"), c["n"].alias("n")))
    return scored(spark, sf, V.value_coverage, plain).withColumnRenamed("score", "vc")


def tuple_coverage(spark, sf):
    """TC (D14): share of truth values whose best cosine against the distinct
    cells of the entry's database is >= 0.7."""
    return scored(spark, sf, V.tuple_coverage, _value_targets).withColumnRenamed("score", "tc")


def column_consistency(spark, sf):
    """CC (D16): share of (attr, value) pairs for which the cells equal to the
    value -- else containing it or contained in it -- sit in a column whose
    name has cosine >= 0.5 with the attribute."""
    targets = lambda truth, cells: V.column_targets(truth, F.transform(cells, lambda c: c["column_name"]))
    return scored(spark, sf, V.column_consistency, targets).withColumnRenamed("score", "cc")


def entity_coverage(spark, sf):
    """D9 per (method, domain): for every truth attribute without ``id`` in its
    name, the best cosine against the predicted column names (``table_col``
    and ``col``); the sum over all attributes x 100."""
    dom = entry_domains(spark, sf)
    attrs = truth_items(spark, sf).join(dom, "entry_id").groupBy("domain").agg(F.collect_set("attr").alias("attrs"))
    # a schema's names: bounded by its columns
    names = pred_cells(spark, sf).join(dom, "entry_id").groupBy("method", "domain").agg(
        F.collect_set(F.struct("table_name", "column_name")).alias("cols"))
    j = names.join(attrs, "domain")
    both = F.flatten(F.transform("cols", lambda c: F.array(F.concat_ws("_", c["table_name"], c["column_name"]), c["column_name"])))
    asked = F.filter("attrs", lambda a: ~F.lower(a).contains("id"))
    best = best_matches(with_grams(asked), with_grams(both))
    return j.select("method", "domain", (F.aggregate(best, F.lit(0.0), lambda s, x: s + x["best"]) / F.size("attrs") * 100.0).alias("entity_coverage"))


# ------------------------------------------------------------------ oracle SQL

def sql_hunit(*parts: str) -> str:
    return ("('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
            + ")), 1, 8))::BIGINT / 4294967296.0")


_M = "(VALUES " + ", ".join(f"('{n}', {d}::DOUBLE, {a}::DOUBLE, {x}::DOUBLE, {r})" for n, d, a, x, r in METHODS) \
    + ") m(method, drp, alt, dbmiss, method_rank)"
_TBL = "CASE " + " ".join(f"WHEN starts_with(t.attr, '{p}') THEN '{tn}'" for p, tn in PREFIX_TABLE.items()) + " END"

PRED_SQL = f"""SELECT m.method, m.method_rank, t.entry_id,
  CASE WHEN m.method = 'single_shot' THEN 'data' ELSE {_TBL} END AS table_name,
  CAST(t.row_id AS INTEGER) - 1 AS row_pos,
  CASE WHEN {sql_hunit("'rid'", 'm.method', 't.entry_id', 't.row_id')} < 0.1
       THEN CAST(CAST(t.row_id AS INTEGER) + 10 AS VARCHAR) ELSE t.row_id END AS id_val,
  CASE WHEN m.method = 'tst' THEN substr(t.attr, 3) ELSE t.attr END AS column_name,
  CASE WHEN {sql_hunit("'pred'", 'm.method', 't.entry_id', 't.attr', 't.row_id')} < m.drp + m.alt
       THEN reverse(t.value) ELSE t.value END AS value
FROM ({C.TRUTH_SQL}) t CROSS JOIN {_M}
WHERE {sql_hunit("'pred'", 'm.method', 't.entry_id', 't.attr', 't.row_id')} >= m.drp
  AND {sql_hunit("'db'", 'm.method', 't.entry_id')} >= m.dbmiss"""

_ENT_SQL = f"""SELECT CAST(floor(c_custkey / {C.BATCH}) AS BIGINT) AS entry_id, arg_min(domain, c_custkey) AS domain
FROM ({C.PROFILE_SQL}) p GROUP BY 1"""

BASE_SQL = f"""t AS (SELECT entry_id, attr, row_id, value FROM ({C.TRUTH_SQL}) x),
p AS ({PRED_SQL}),
r AS (SELECT DISTINCT method, entry_id, row_pos, id_val FROM p),
cells AS (SELECT method, entry_id, row_pos, column_name, value FROM p
          UNION ALL SELECT method, entry_id, row_pos, 'id', id_val FROM r),
dbs AS (SELECT DISTINCT method, entry_id FROM r),
ents AS ({_ENT_SQL}),
grid AS (SELECT e.entry_id, e.domain, m.method FROM ents e CROSS JOIN {_M}),
gv AS (SELECT entry_id, v FROM (SELECT entry_id, row_id AS v FROM t UNION ALL SELECT entry_id, value FROM t) z
       WHERE v <> '' AND lower(v) NOT IN ('none', 'null', 'na')),
gp AS (SELECT entry_id, attr, v FROM (SELECT entry_id, attr, row_id AS v FROM t UNION ALL SELECT entry_id, attr, value FROM t) z
       WHERE v <> '' AND lower(v) NOT IN ('none', 'null', 'na'))"""


def sql_cos(prefix: str, pairs: str) -> str:
    """CTEs ``{prefix}cs(a, b, cos)`` for the distinct pairs selected by ``pairs``
    (a query returning columns a, b)."""
    return f"""{prefix}pp AS (SELECT DISTINCT a, b FROM ({pairs}) q),
{prefix}ss AS (SELECT a AS s FROM {prefix}pp UNION SELECT b FROM {prefix}pp),
{prefix}gg AS (SELECT s, substr(' ' || lower(s) || ' ', i, 3) AS gram, count(*) AS cnt
     FROM {prefix}ss, unnest(generate_series(1, length(' ' || lower(s) || ' ') - 2)) AS g(i) GROUP BY ALL),
{prefix}nn AS (SELECT s, sqrt(sum(cnt * cnt)) AS nrm FROM {prefix}gg GROUP BY s),
{prefix}dd AS (SELECT q.a, q.b, sum(ga.cnt * gb.cnt) AS dot FROM {prefix}pp q
     JOIN {prefix}gg ga ON ga.s = q.a JOIN {prefix}gg gb ON gb.s = q.b AND gb.gram = ga.gram GROUP BY q.a, q.b),
{prefix}cs AS (SELECT q.a, q.b, CASE WHEN na.nrm > 0 AND nb.nrm > 0 THEN coalesce(d.dot, 0) / (na.nrm * nb.nrm)
                 ELSE 0.0 END AS cos
     FROM {prefix}pp q LEFT JOIN {prefix}dd d ON d.a = q.a AND d.b = q.b
     LEFT JOIN {prefix}nn na ON na.s = q.a LEFT JOIN {prefix}nn nb ON nb.s = q.b)"""


def sql_is_number(x: str) -> str:
    return (rf"CASE WHEN regexp_matches(trim({x}), '^-?\$?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?$') "
            rf"THEN TRY_CAST(regexp_replace(trim({x}), '[$,]', '', 'g') AS DOUBLE) END")


ROW_MATCH_SQL = f"""WITH {BASE_SQL},
it AS (SELECT d.method, t.entry_id, t.attr, t.row_id, t.value FROM t JOIN dbs d ON d.entry_id = t.entry_id),
ids AS (SELECT DISTINCT method, entry_id, row_id FROM it),
ex AS (SELECT i.method, i.entry_id, i.row_id, r.row_pos FROM ids i
       JOIN r ON r.method = i.method AND r.entry_id = i.entry_id AND r.id_val = i.row_id),
fb AS (SELECT i.method, i.entry_id, i.row_id, r.row_pos FROM ids i
       JOIN r ON r.method = i.method AND r.entry_id = i.entry_id
       WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.method = i.method AND ex.entry_id = i.entry_id AND ex.row_id = i.row_id)
         AND r.row_pos >= CAST(i.row_id AS INTEGER) - 1
         AND (r.row_pos - (CAST(i.row_id AS INTEGER) - 1)) % 5 = 0),
cand AS (SELECT * FROM ex UNION ALL SELECT * FROM fb),
pairs AS (SELECT it.method, it.entry_id, it.attr, it.row_id, it.value, c.column_name, c.value AS cell
          FROM it JOIN cand ON cand.method = it.method AND cand.entry_id = it.entry_id AND cand.row_id = it.row_id
          JOIN cells c ON c.method = cand.method AND c.entry_id = cand.entry_id AND c.row_pos = cand.row_pos),
{sql_cos('v', 'SELECT value AS a, cell AS b FROM pairs')},
{sql_cos('c', 'SELECT attr AS a, column_name AS b FROM pairs')},
sc AS (SELECT pairs.*,
         CASE WHEN {sql_is_number('pairs.value')} IS NOT NULL THEN
              CASE WHEN {sql_is_number('pairs.cell')} IS NOT NULL
                        AND abs({sql_is_number('pairs.value')} - {sql_is_number('pairs.cell')}) < 0.01
                   THEN 1.0 ELSE 0.0 END
              ELSE (vcs.cos + 1.0) / 2.0 END >= {VALUE_T} AS hit,
         (ccs.cos + 1.0) / 2.0 >= {COLUMN_T} AS colok
       FROM pairs JOIN vcs ON vcs.a = pairs.value AND vcs.b = pairs.cell
       JOIN ccs ON ccs.a = pairs.attr AND ccs.b = pairs.column_name),
pi AS (SELECT method, entry_id, attr, row_id, max(CASE WHEN hit THEN 1 ELSE 0 END) AS hit,
              max(CASE WHEN hit AND colok THEN 1 ELSE 0 END) AS col_hit FROM sc GROUP BY ALL),
items AS (SELECT it.method, it.entry_id, it.attr, it.row_id, coalesce(pi.hit, 0) AS hit, coalesce(pi.col_hit, 0) AS col_hit,
                 CASE WHEN EXISTS (SELECT 1 FROM cand WHERE cand.method = it.method AND cand.entry_id = it.entry_id
                                   AND cand.row_id = it.row_id) THEN 1 ELSE 0 END AS found
          FROM it LEFT JOIN pi ON pi.method = it.method AND pi.entry_id = it.entry_id AND pi.attr = it.attr
                                 AND pi.row_id = it.row_id),
pa AS (SELECT method, entry_id, attr, sum(found) / count(DISTINCT row_id) AS row_acc, sum(hit) AS hits,
              sum(col_hit) AS col_hits, count(*) AS n FROM items GROUP BY ALL),
pe AS (SELECT method, entry_id, avg(row_acc) AS a, sum(hits) / sum(n) AS m, sum(col_hits) / sum(n) AS c
       FROM pa GROUP BY ALL),
rm AS (SELECT g.method, g.entry_id, g.domain, coalesce(pe.a, -1.0) AS avg_row_accuracy,
              coalesce(pe.m, -1.0) AS match_accuracy, coalesce(pe.c, -1.0) AS match_in_right_column_accuracy
       FROM grid g LEFT JOIN pe ON pe.method = g.method AND pe.entry_id = g.entry_id)"""


@query("gt_row_match", ROW_MATCH_SQL + """
SELECT method, entry_id, domain, round(avg_row_accuracy, 6) AS avg_row_accuracy,
       round(match_accuracy, 6) AS match_accuracy,
       round(match_in_right_column_accuracy, 6) AS match_in_right_column_accuracy FROM rm""")
def gt_row_match(spark, sf):
    return finalize(row_match(spark, sf))


@query("match_summary", ROW_MATCH_SQL + """
SELECT method, count(*) AS n_total, count(*) FILTER (WHERE match_accuracy >= 0) AS n_processed,
       round(avg(avg_row_accuracy) FILTER (WHERE match_accuracy >= 0), 6) AS avg_row_accuracy,
       round(avg(match_accuracy) FILTER (WHERE match_accuracy >= 0), 6) AS match_accuracy,
       round(avg(match_in_right_column_accuracy) FILTER (WHERE match_accuracy >= 0), 6)
         AS match_in_right_column_accuracy
FROM rm GROUP BY method""")
def match_summary(spark, sf):
    """Run summary (D11, D12): means over databases that produced rows, plus
    total and processed counts, per method."""
    rm = row_match(spark, sf)
    ok = F.col("match_accuracy") >= 0
    return finalize(rm.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(ok, 1)).alias("n_processed"),
        *[F.avg(F.when(ok, F.col(c))).alias(c) for c in
          ("avg_row_accuracy", "match_accuracy", "match_in_right_column_accuracy")]))


@query("value_coverage", f"""WITH {BASE_SQL},
blob AS (SELECT method, entry_id, string_agg(lower(value), ' | ' ORDER BY row_pos, column_name, lower(value)) AS blob
         FROM cells GROUP BY ALL),
j AS (SELECT g.method, g.entry_id, CASE WHEN b.blob IS NOT NULL AND instr(b.blob, lower(gv.v)) > 0 THEN 1.0 ELSE 0.0 END AS hit
      FROM grid g JOIN gv ON gv.entry_id = g.entry_id LEFT JOIN blob b ON b.method = g.method AND b.entry_id = g.entry_id)
SELECT g.method, g.entry_id, g.domain, round(coalesce(a.vc, 0.0), 6) AS vc
FROM grid g LEFT JOIN (SELECT method, entry_id, avg(hit) AS vc FROM j GROUP BY ALL) a
  ON a.method = g.method AND a.entry_id = g.entry_id""")
def value_coverage_q(spark, sf):
    return finalize(value_coverage(spark, sf))


@query("tuple_coverage", f"""WITH {BASE_SQL},
gvm AS (SELECT d.method, gv.entry_id, gv.v FROM gv JOIN dbs d ON d.entry_id = gv.entry_id),
cand AS (SELECT DISTINCT gvm.method, gvm.entry_id, gvm.v AS a, c.value AS b FROM gvm
         JOIN cells c ON c.method = gvm.method AND c.entry_id = gvm.entry_id),
{sql_cos('t', 'SELECT a, b FROM cand')},
best AS (SELECT cand.method, cand.entry_id, cand.a AS v, max(tcs.cos) AS best FROM cand
         JOIN tcs ON tcs.a = cand.a AND tcs.b = cand.b GROUP BY ALL),
agg AS (SELECT gvm.method, gvm.entry_id, avg(CASE WHEN coalesce(best.best, 0.0) >= {TC_T} THEN 1.0 ELSE 0.0 END) AS tc
        FROM gvm LEFT JOIN best ON best.method = gvm.method AND best.entry_id = gvm.entry_id AND best.v = gvm.v
        GROUP BY ALL)
SELECT g.method, g.entry_id, g.domain, round(coalesce(agg.tc, 0.0), 6) AS tc
FROM grid g LEFT JOIN agg ON agg.method = g.method AND agg.entry_id = g.entry_id""")
def tuple_coverage_q(spark, sf):
    return finalize(tuple_coverage(spark, sf))


@query("column_consistency", f"""WITH {BASE_SQL},
lc AS (SELECT DISTINCT method, entry_id, lower(value) AS lv, column_name FROM cells),
gpm AS (SELECT d.method, gp.entry_id, gp.attr, lower(gp.v) AS lq FROM gp JOIN dbs d ON d.entry_id = gp.entry_id),
keyed AS (SELECT DISTINCT method, entry_id, attr, lq FROM gpm),
eq AS (SELECT k.*, lc.column_name FROM keyed k JOIN lc ON lc.method = k.method AND lc.entry_id = k.entry_id AND lc.lv = k.lq),
cont AS (SELECT k.*, lc.column_name FROM keyed k JOIN lc ON lc.method = k.method AND lc.entry_id = k.entry_id
         WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.method = k.method AND eq.entry_id = k.entry_id
                           AND eq.attr = k.attr AND eq.lq = k.lq)
           AND (instr(lc.lv, k.lq) > 0 OR instr(k.lq, lc.lv) > 0)),
cols AS (SELECT * FROM eq UNION ALL SELECT * FROM cont),
{sql_cos('k', 'SELECT attr AS a, column_name AS b FROM cols')},
ok AS (SELECT cols.method, cols.entry_id, cols.attr, cols.lq FROM cols JOIN kcs ON kcs.a = cols.attr AND kcs.b = cols.column_name
       GROUP BY ALL HAVING max(kcs.cos) >= {CC_T}),
agg AS (SELECT gpm.method, gpm.entry_id, avg(CASE WHEN ok.lq IS NOT NULL THEN 1.0 ELSE 0.0 END) AS cc
        FROM gpm LEFT JOIN ok ON ok.method = gpm.method AND ok.entry_id = gpm.entry_id AND ok.attr = gpm.attr
                              AND ok.lq = gpm.lq GROUP BY ALL)
SELECT g.method, g.entry_id, g.domain, round(coalesce(agg.cc, 0.0), 6) AS cc
FROM grid g LEFT JOIN agg ON agg.method = g.method AND agg.entry_id = g.entry_id""")
def column_consistency_q(spark, sf):
    return finalize(column_consistency(spark, sf))


@query("entity_coverage", f"""WITH {BASE_SQL},
attrs AS (SELECT DISTINCT e.domain, t.attr FROM t JOIN ents e ON e.entry_id = t.entry_id),
pc AS (SELECT DISTINCT p.method, e.domain, p.table_name, p.column_name FROM p JOIN ents e ON e.entry_id = p.entry_id),
names AS (SELECT DISTINCT method, domain, table_name || '_' || column_name AS name FROM pc
          UNION SELECT DISTINCT method, domain, column_name FROM pc),
md AS (SELECT DISTINCT method, domain FROM pc),
cand AS (SELECT md.method, md.domain, a.attr FROM attrs a JOIN md ON md.domain = a.domain
         WHERE NOT contains(lower(a.attr), 'id')),
pairs AS (SELECT cand.method, cand.domain, cand.attr AS a, n.name AS b FROM cand
          JOIN names n ON n.method = cand.method AND n.domain = cand.domain),
{sql_cos('e', 'SELECT a, b FROM pairs')},
best AS (SELECT pairs.method, pairs.domain, pairs.a AS attr, max(ecs.cos) AS best FROM pairs
         JOIN ecs ON ecs.a = pairs.a AND ecs.b = pairs.b GROUP BY ALL),
num AS (SELECT cand.method, cand.domain, sum(coalesce(best.best, 0.0)) AS s FROM cand
        LEFT JOIN best ON best.method = cand.method AND best.domain = cand.domain AND best.attr = cand.attr GROUP BY ALL),
den AS (SELECT domain, count(*) AS n FROM attrs GROUP BY domain)
SELECT md.method, md.domain, round(coalesce(num.s, 0.0) / den.n * 100.0, 6) AS entity_coverage
FROM md LEFT JOIN num ON num.method = md.method AND num.domain = md.domain JOIN den ON den.domain = md.domain""")
def entity_coverage_q(spark, sf):
    return finalize(entity_coverage(spark, sf))
