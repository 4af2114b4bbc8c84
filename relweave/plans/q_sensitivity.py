"""The sensitivity study end to end.

Entries (batches of rendered customer rows) are noised into 12 variants plus
the clean text, each variant is turned into a database by three extraction
methods, and every database is scored against the frozen ground truth:
TC tuple coverage, VC value coverage, CC column consistency, RI referential
integrity and EX load validity, averaged per (variant, method).

An entry is one bounded row from text to scores. Noise is generated code over its
sentences; a variant's databases are scored by what each different sentence adds,
so the sentences that noise left alone are read and compared once for all 39
databases, and only the five scores leave the row.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relweave.functions import noise as N
from relweave.functions.text import finalize
from relweave.operators.rescore import Method, score_variants
from relweave.plans import common as C
from relweave.plans import q_metrics as M
from relweave.plans.q_noise import FLAGS, _BASE, _noisy_rows, at_top_level, with_sentences
from relweave.plans.registry import query
from relweave.session import spread

METHODS = ["staged", "tst", "single_shot"]
VARIANTS = ["clean"] + [f"{k}_{lv}" for k in N.TYPES for lv in N.LEVELS]
TYPED = {"c_nationkey": "bigint", "c_acctbal": "double"}
_FK = (("c_nationkey", "n_name"),)
_PK = (("c_", "c_name"),)
WAYS = [Method("staged", True, False, False, _FK, _PK), Method("tst", True, True, False, _FK, _PK), Method("single_shot", False, False, True, ())]
METRICS = ["tc", "vc", "cc", "ri", "ex"]


def entry_variants(spark, sf):
    """(entry_id, truth, texts): one row per entry with the sentences of all its variants."""
    e = C.entries(spark, sf).select(F.lit("entry").alias("src"), F.col("entry_id").alias("id"), "text")
    t = at_top_level(with_sentences(e), N.TYPES, ["id"])
    flags, named = {n: F.col(p) for n, p in FLAGS.items()}, {"v0": F.col("sents")}
    for k, kind in enumerate(N.TYPES):
        levels = N.noise_levels(kind, F.col("sents"), flags, F.col(f"top{k}"))
        named |= {f"v{VARIANTS.index(f'{kind}_{lv}')}": noisy for lv, noisy in levels.items()}
    m = t.select("id", F.array(*[named[f"v{i}"] for i in range(len(VARIANTS))]).alias("texts"))
    truth = M.truth_items(spark, sf).groupBy("entry_id").agg(F.collect_list(F.struct("attr", "row_id", "value")).alias("truth"))
    return spread(truth.join(m, truth.entry_id == m.id).select("entry_id", "truth", "texts"), "entry_id")


def cell_scores(spark, sf):
    """Per (variant, method, entry): tc, vc, cc, ri, ex and the declared foreign keys."""
    return score_variants(entry_variants(spark, sf), VARIANTS, WAYS, list(M.PREFIX_TABLE), list(C.CUST_COLS), TYPED)


def summary(spark, sf):
    """Per (variant, method) mean of the five metrics, the declared foreign
    keys (Q13) and n."""
    s = cell_scores(spark, sf)
    return s.groupBy("variant", "method").agg(*[F.avg(c).alias(c) for c in METRICS], F.max("n_fk").alias("n_fk"),
                                              F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ oracle SQL

def _variant_sql() -> str:
    parts = [f"SELECT * FROM (WITH {_BASE} SELECT id AS entry_id, 'clean' AS variant, pos, s AS ns FROM p "
             f"WHERE level = 'L1' AND src = 'entry') c0"]
    for i, kind in enumerate(N.TYPES, start=1):
        parts.append(f"""SELECT * FROM (WITH {_BASE},
{_noisy_rows(kind)} SELECT id AS entry_id, '{kind}_' || level AS variant, pos, ns FROM r WHERE src = 'entry') c{i}""")
    return "\nUNION ALL\n".join(parts)


_SENTS = r"""vs AS (""" + "{variants}" + r"""),
vr AS (SELECT entry_id, variant, row_number() OVER (PARTITION BY entry_id, variant ORDER BY pos) - 1 AS row_pos, ns
       FROM vs)"""


def _cells_sql() -> str:
    tbl = "CASE " + " ".join(f"WHEN starts_with(attr, '{p}') THEN '{t}'" for p, t in M.PREFIX_TABLE.items()) + " END"
    cust = ", ".join(f"'{c}'" for c in C.CUST_COLS)
    return _SENTS.format(variants=_variant_sql()) + f""",
it AS (SELECT vr.entry_id, vr.variant, vr.row_pos, u.item FROM vr,
       unnest(string_split(regexp_replace(vr.ns, '\\.$', ''), ', ')) AS u(item)),
facts AS (SELECT entry_id, variant, row_pos, substr(item, 1, instr(item, ' is ') - 1) AS attr,
                 substr(item, instr(item, ' is ') + 4) AS value FROM it WHERE instr(item, ' is ') > 0),
cells0 AS (SELECT 'staged' AS method, variant, entry_id, {tbl} AS table_name, row_pos, attr AS column_name, value
          FROM facts WHERE {tbl} IS NOT NULL
          UNION ALL
          SELECT 'tst', variant, entry_id, {tbl}, row_pos, attr, value FROM facts
          WHERE {tbl} IS NOT NULL AND attr IN ({cust}) AND NOT ({_typed_sql('attr')})
          UNION ALL
          SELECT 'single_shot', variant, entry_id, 'data', row_pos, attr, regexp_extract(value, '^([^.]*)', 1)
          FROM facts),
cells AS (SELECT * FROM cells0 UNION ALL
          SELECT DISTINCT method, variant, entry_id, NULL, row_pos, 'id', CAST(row_pos + 1 AS VARCHAR) FROM cells0)"""


def _typed_sql(col: str) -> str:
    return " OR ".join(
        f"({col} = '{c}' AND (TRY_CAST(value AS {t.upper()}) IS NULL"
        + (r" OR NOT regexp_matches(value, '^\s*[+-]?[0-9]+\s*$')" if t == "bigint" else "") + "))"
        for c, t in TYPED.items())


def _scores_sql() -> str:
    vlist = ", ".join(f"('{v}')" for v in VARIANTS)
    mlist = ", ".join(f"('{m}')" for m in METHODS)
    typed = _typed_sql("column_name")
    return f"""WITH t AS (SELECT entry_id, attr, row_id, value FROM ({C.TRUTH_SQL}) x),
{_cells_sql()},
grid AS (SELECT e.entry_id, v.variant, m.method FROM (SELECT DISTINCT entry_id FROM t) e
         CROSS JOIN (VALUES {vlist}) v(variant) CROSS JOIN (VALUES {mlist}) m(method)),
dbs AS (SELECT DISTINCT variant, method, entry_id FROM cells),
gv0 AS (SELECT entry_id, v FROM (SELECT entry_id, row_id AS v FROM t UNION ALL SELECT entry_id, value FROM t) z
        WHERE v <> '' AND lower(v) NOT IN ('none', 'null', 'na')),
gp0 AS (SELECT entry_id, attr, v FROM (SELECT entry_id, attr, row_id AS v FROM t UNION ALL SELECT entry_id, attr, value FROM t) z
        WHERE v <> '' AND lower(v) NOT IN ('none', 'null', 'na')),
gv AS (SELECT d.variant, d.method, gv0.entry_id, gv0.v FROM gv0 JOIN dbs d ON d.entry_id = gv0.entry_id),
blob AS (SELECT variant, method, entry_id,
                string_agg(lower(value), ' | ' ORDER BY row_pos, column_name, lower(value)) AS blob FROM cells GROUP BY ALL),
vc AS (SELECT gv.variant, gv.method, gv.entry_id, avg(CASE WHEN instr(b.blob, lower(gv.v)) > 0 THEN 1.0 ELSE 0.0 END) AS vc
       FROM gv JOIN blob b USING (variant, method, entry_id) GROUP BY ALL),
tcand AS (SELECT DISTINCT gv.variant, gv.method, gv.entry_id, gv.v AS a, c.value AS b FROM gv
          JOIN cells c USING (variant, method, entry_id)),
{M.sql_cos('t', 'SELECT a, b FROM tcand')},
tbest AS (SELECT tcand.variant, tcand.method, tcand.entry_id, tcand.a AS v, max(tcs.cos) AS best FROM tcand
          JOIN tcs ON tcs.a = tcand.a AND tcs.b = tcand.b GROUP BY ALL),
tc AS (SELECT gv.variant, gv.method, gv.entry_id,
              avg(CASE WHEN coalesce(tbest.best, 0.0) >= {M.TC_T} THEN 1.0 ELSE 0.0 END) AS tc
       FROM gv LEFT JOIN tbest USING (variant, method, entry_id, v) GROUP BY ALL),
lc AS (SELECT DISTINCT variant, method, entry_id, lower(value) AS lv, column_name FROM cells),
gpm AS (SELECT d.variant, d.method, gp0.entry_id, gp0.attr, lower(gp0.v) AS lq FROM gp0 JOIN dbs d ON d.entry_id = gp0.entry_id),
keyed AS (SELECT DISTINCT variant, method, entry_id, attr, lq FROM gpm),
eq AS (SELECT k.*, lc.column_name FROM keyed k JOIN lc USING (variant, method, entry_id) WHERE lc.lv = k.lq),
cont AS (SELECT k.*, lc.column_name FROM keyed k JOIN lc USING (variant, method, entry_id)
         WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.variant = k.variant AND eq.method = k.method
                           AND eq.entry_id = k.entry_id AND eq.attr = k.attr AND eq.lq = k.lq)
           AND (instr(lc.lv, k.lq) > 0 OR instr(k.lq, lc.lv) > 0)),
cols AS (SELECT * FROM eq UNION ALL SELECT * FROM cont),
{M.sql_cos('k', 'SELECT attr AS a, column_name AS b FROM cols')},
ok AS (SELECT cols.variant, cols.method, cols.entry_id, cols.attr, cols.lq FROM cols
       JOIN kcs ON kcs.a = cols.attr AND kcs.b = cols.column_name GROUP BY ALL HAVING max(kcs.cos) >= {M.CC_T}),
cc AS (SELECT gpm.variant, gpm.method, gpm.entry_id, avg(CASE WHEN ok.lq IS NOT NULL THEN 1.0 ELSE 0.0 END) AS cc
       FROM gpm LEFT JOIN ok USING (variant, method, entry_id, attr, lq) GROUP BY ALL),
ch AS (SELECT variant, method, entry_id, TRY_CAST(value AS BIGINT) AS k FROM cells
       WHERE table_name = 'customer' AND column_name = 'c_nationkey' AND TRY_CAST(value AS BIGINT) IS NOT NULL
         AND regexp_matches(value, '^\\s*[+-]?[0-9]+\\s*$')),
pa AS (SELECT DISTINCT variant, method, entry_id, TRY_CAST(regexp_extract(value, '(\\d+)$', 1) AS BIGINT) AS k FROM cells
       WHERE table_name = 'nation' AND column_name = 'n_name'
         AND TRY_CAST(regexp_extract(value, '(\\d+)$', 1) AS BIGINT) IS NOT NULL),
ri AS (SELECT ch.variant, ch.method, ch.entry_id, avg(CASE WHEN pa.k IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ri_fk
       FROM ch LEFT JOIN pa USING (variant, method, entry_id, k) GROUP BY ALL),
kr AS (SELECT variant, method, entry_id, row_pos, count(*) FILTER (WHERE column_name = 'c_name') AS n, any_value(value) FILTER (WHERE column_name = 'c_name') AS k
       FROM cells WHERE table_name = 'customer' GROUP BY ALL),
kb AS (SELECT variant, method, entry_id, max(CASE WHEN n <> 1 THEN 1 ELSE 0 END) AS odd, count(k) <> count(DISTINCT k) AS twice FROM kr GROUP BY ALL),
ex AS (SELECT c.variant, c.method, c.entry_id, max(CASE WHEN {typed} THEN 1 ELSE 0 END) + coalesce(max(kb.odd), 0) + coalesce(max(CASE WHEN kb.twice THEN 1 ELSE 0 END), 0) AS bad
       FROM cells c LEFT JOIN kb USING (variant, method, entry_id) GROUP BY ALL),
scores AS (SELECT g.variant, g.method, g.entry_id,
       coalesce(tc.tc, 0.0) AS tc, coalesce(vc.vc, 0.0) AS vc, coalesce(cc.cc, 0.0) AS cc,
       CASE WHEN g.method = 'single_shot' THEN 1.0 WHEN d.entry_id IS NULL THEN 0.0 ELSE coalesce(ri.ri_fk, 1.0) END AS ri,
       CASE WHEN d.entry_id IS NOT NULL AND ex.bad = 0 THEN 1.0 ELSE 0.0 END AS ex
FROM grid g LEFT JOIN dbs d USING (variant, method, entry_id) LEFT JOIN vc USING (variant, method, entry_id)
LEFT JOIN tc USING (variant, method, entry_id) LEFT JOIN cc USING (variant, method, entry_id)
LEFT JOIN ri USING (variant, method, entry_id) LEFT JOIN ex USING (variant, method, entry_id)),
summ AS (SELECT variant, method, avg(tc) AS tc, avg(vc) AS vc, avg(cc) AS cc, avg(ri) AS ri, avg(ex) AS ex,
                max(CASE WHEN method = 'single_shot' THEN 0 ELSE 1 END) AS n_fk, count(*) AS n FROM scores GROUP BY ALL)"""


SUMMARY_SQL = _scores_sql()


@query("sensitivity_summary", SUMMARY_SQL + """
SELECT variant, method, round(tc, 6) AS tc, round(vc, 6) AS vc, round(cc, 6) AS cc, round(ri, 6) AS ri,
       round(ex, 6) AS ex, n_fk, n FROM summ""")
def sensitivity_summary(spark, sf):
    return finalize(summary(spark, sf))


@query("variant_matrix", SUMMARY_SQL + """
SELECT variant, """ + ", ".join(
    f"round(max({m_}) FILTER (WHERE method = '{me}'), 6) AS {me}_{m_}"
    for me in METHODS for m_ in METRICS) + " FROM summ GROUP BY variant")
def variant_matrix(spark, sf):
    """Variant x (method, metric) matrix (D25): one pivot over the fixed
    method list."""
    s = summary(spark, sf)
    pv = s.groupBy("variant").pivot("method", METHODS).agg(
        *[F.first(F.round(m_, 6)).alias(m_) for m_ in METRICS])
    return finalize(pv)


@query("degradation_delta", SUMMARY_SQL + """,
noisy AS (SELECT s.*, split_part(s.variant, '_L', 1) AS noise_type, 'L' || split_part(s.variant, '_L', 2) AS level
          FROM summ s WHERE s.variant <> 'clean')
SELECT n.noise_type, n.level, CASE n.level WHEN 'L1' THEN 10 WHEN 'L2' THEN 30 ELSE 60 END AS pct, n.method,
       """ + ",\n       ".join(f"round(n.{m_}, 6) AS {m_}, round(n.{m_} - c.{m_}, 6) AS delta_{m_}" for m_ in METRICS) + """
FROM noisy n JOIN summ c ON c.variant = 'clean' AND c.method = n.method""")
def degradation_delta(spark, sf):
    """Value at 10/30/60 % per noise type and method, and its delta to the
    clean row of the same method (D26)."""
    # 13 variants x 3 methods: the clean row of a method joins its noisy ones by a window over 13 rows
    w = Window.partitionBy("method")
    s = summary(spark, sf)
    for m_ in METRICS:
        s = s.withColumn(f"c_{m_}", F.max(F.when(F.col("variant") == "clean", F.col(m_))).over(w))
    n = s.filter(F.col("variant") != "clean") \
        .withColumn("noise_type", F.split_part("variant", F.lit("_L"), F.lit(1))) \
        .withColumn("level", F.concat(F.lit("L"), F.split_part("variant", F.lit("_L"), F.lit(2))))
    pct = F.when(F.col("level") == "L1", 10).when(F.col("level") == "L2", 30).otherwise(60)
    return finalize(n.select("noise_type", "level", pct.cast("bigint").alias("pct"), "method",
                             *[c for m_ in METRICS for c in
                               (F.col(m_), (F.col(m_) - F.col(f"c_{m_}")).alias(f"delta_{m_}"))]))
