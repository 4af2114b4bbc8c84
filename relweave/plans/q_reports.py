"""Roll-ups, restrictions, pivots and ensembles over metric rows (D3-D6, D21-D23,
C11, F3, E6, E7, F2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relweave.functions.text import finalize
from relweave.operators.joins import common_keys
from relweave.plans import common as C
from relweave.plans import q_metrics as M
from relweave.plans import q_sensitivity as S
from relweave.plans.registry import query

SCORES = ["avg_row_accuracy", "match_accuracy", "match_in_right_column_accuracy"]
METHOD_NAMES = [m[0] for m in M.METHODS]


def metric_rows(spark, sf):
    """Row-match scores per (method, entry, domain)."""
    return M.row_match(spark, sf)


def domain_rollup(rm, restrict_ok: bool = False, domains: list[str] | None = None):
    """Mean per (method, domain) plus an ``overall`` row per method.
    ``grouping_id`` marks the roll-up row; the grand total is dropped. With ``domains``
    only these have rows of their own; ``overall`` is over all entries."""
    src = rm.filter(F.col("match_accuracy") >= 0) if restrict_ok else rm
    r = src.rollup("method", "domain").agg(*[F.avg(c).alias(c) for c in SCORES],
                                           F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    if domains is not None:
        r = r.filter((F.col("_g") == 1) | F.col("domain").isin(domains))
    return r.filter(F.col("_g") < 3).select(
        "method", F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.col("domain")).alias("domain"),
        *SCORES, "n")


_ROLLUP_SQL = """SELECT method, coalesce(domain, 'overall') AS domain,
       round(avg(avg_row_accuracy), 6) AS avg_row_accuracy, round(avg(match_accuracy), 6) AS match_accuracy,
       round(avg(match_in_right_column_accuracy), 6) AS match_in_right_column_accuracy, count(*) AS n
FROM {src} GROUP BY ROLLUP (method, domain) HAVING method IS NOT NULL"""


@query("domain_rollup", M.ROW_MATCH_SQL + "\n" + _ROLLUP_SQL.format(src="rm"))
def domain_rollup_q(spark, sf):
    return finalize(domain_rollup(metric_rows(spark, sf)))


#: Domains that a report asks for.
LISTED = ["building", "machinery"]


@query("domain_list_rollup", M.ROW_MATCH_SQL + ", ro AS (" + _ROLLUP_SQL.format(src="rm") + f""")
SELECT * FROM ro WHERE domain IN ({", ".join(f"'{d}'" for d in [*LISTED, "overall"])})""")
def domain_list_rollup(spark, sf):
    """The roll-up over a given list of domains (D3)."""
    return finalize(domain_rollup(metric_rows(spark, sf), domains=LISTED))


@query("correct_db_count", M.ROW_MATCH_SQL + """
SELECT method, domain, count(*) FILTER (WHERE match_accuracy <> 0) AS n_correct, count(*) AS n_entries
FROM rm GROUP BY method, domain""")
def correct_db_count(spark, sf):
    """Entries per (method, domain) whose value match is not 0."""
    rm = metric_rows(spark, sf)
    return finalize(rm.groupBy("method", "domain").agg(
        F.count(F.when(F.col("match_accuracy") != 0, 1)).alias("n_correct"), F.count(F.lit(1)).alias("n_entries")))


@query("common_key_mean", M.ROW_MATCH_SQL + """,
ck AS (SELECT entry_id FROM rm GROUP BY entry_id
       HAVING count(DISTINCT method) = 3 AND min(match_accuracy) <> -1),
src AS (SELECT * FROM rm WHERE entry_id IN (SELECT entry_id FROM ck) AND match_accuracy >= 0)
""" + _ROLLUP_SQL.format(src="src"))
def common_key_mean(spark, sf):
    """Means over entries scored by every method and never -1."""
    rm = metric_rows(spark, sf)
    ck = common_keys(rm, "entry_id", "method", "match_accuracy", len(METHOD_NAMES))
    return finalize(domain_rollup(ck, restrict_ok=True))


@query("common_keys", M.ROW_MATCH_SQL + """
SELECT entry_id FROM rm GROUP BY entry_id HAVING count(DISTINCT method) = 3 AND min(match_accuracy) <> -1""")
def common_keys_q(spark, sf):
    """Keys common to all methods with a score."""
    rm = metric_rows(spark, sf)
    return finalize(common_keys(rm, "entry_id", "method", "match_accuracy", len(METHOD_NAMES))
                    .select("entry_id").distinct())


@query("pct_correct", M.ROW_MATCH_SQL + """,
per AS (SELECT method, domain, count(*) FILTER (WHERE match_accuracy <> 0) AS n_correct, count(*) AS n FROM rm GROUP BY ALL),
div AS (SELECT count(*) / count(DISTINCT domain) / 3.0 AS d, count(DISTINCT domain) AS nd FROM rm)
SELECT per.method, round(sum(n_correct) / (max(div.d) * max(div.nd)) * 100.0, 2) AS pct_correct
FROM per CROSS JOIN div GROUP BY per.method""")
def pct_correct(spark, sf):
    """% correct databases (D21): correct count summed over domains divided by
    (entries per domain x number of domains), x 100, two digits."""
    rm = metric_rows(spark, sf)
    # One row per (method, domain); the domains' divisor is the same for every
    # method, so it comes from one aggregate over these few rows.
    per = rm.groupBy("method", "domain").agg(F.count(F.when(F.col("match_accuracy") != 0, 1)).alias("c"), F.count(F.lit(1)).alias("n"))
    per_method = per.groupBy("method").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    every = per.agg(F.sum("n").alias("all"), F.count_distinct("domain").alias("nd"))
    share = F.col("c") / (F.col("all") / F.col("nd") / float(len(METHOD_NAMES)) * F.col("nd")) * 100.0
    return finalize(per_method.join(every, F.lit(True)).select("method", F.round(share, 2).alias("pct_correct")))


@query("null_share_integrity", f"""WITH {M.BASE_SQL},
width AS (SELECT method, count(DISTINCT column_name) AS w FROM cells GROUP BY method),
rs AS (SELECT c.method, c.entry_id, c.row_pos, count(*) / max(width.w) AS share FROM cells c
       JOIN width ON width.method = c.method GROUP BY ALL),
pe AS (SELECT method, entry_id, avg(share) AS s FROM rs GROUP BY ALL)
SELECT g.method, round(sum(coalesce(pe.s, 0.0)) / count(*), 6) AS null_share_integrity, count(*) AS n_entries
FROM grid g LEFT JOIN pe ON pe.method = g.method AND pe.entry_id = g.entry_id GROUP BY g.method""")
def null_share_integrity(spark, sf):
    """Referential-integrity score as non-null share (D6): per joined row the
    share of present cells over the method's column count, mean per database
    (0 without rows), summed and divided by all entries."""
    cells = M.pred_cells(spark, sf)
    # the id column counts as a column, and as a cell of every row
    width = cells.groupBy("method").agg((F.count_distinct("column_name") + 1).alias("w"))
    rs = cells.groupBy("method", "entry_id", "row_pos").agg((F.count(F.lit(1)) + 1).alias("k")) \
        .join(width, "method").withColumn("share", F.col("k") / F.col("w"))
    pe = rs.groupBy("method", "entry_id").agg(F.avg("share").alias("s"))
    grid = M.entry_domains(spark, sf).select("entry_id", F.explode(F.array(*[F.lit(m) for m in METHOD_NAMES])).alias("method"))
    j = grid.join(pe, ["method", "entry_id"], "left")
    return finalize(j.groupBy("method").agg(
        (F.sum(F.coalesce("s", F.lit(0.0))) / F.count(F.lit(1))).alias("null_share_integrity"),
        F.count(F.lit(1)).alias("n_entries")))


@query("method_pivot_best", M.ROW_MATCH_SQL + """,
ru AS (""" + _ROLLUP_SQL.format(src="rm") + """),
pv AS (SELECT domain, max(match_accuracy) FILTER (WHERE method = 'staged') AS staged,
              max(match_accuracy) FILTER (WHERE method = 'tst') AS tst,
              max(match_accuracy) FILTER (WHERE method = 'single_shot') AS single_shot FROM ru GROUP BY domain)
SELECT domain, staged, tst, single_shot,
       concat_ws(',', CASE WHEN staged >= greatest(staged, tst, single_shot) - 1e-6 THEN 'staged' END,
                      CASE WHEN tst >= greatest(staged, tst, single_shot) - 1e-6 THEN 'tst' END,
                      CASE WHEN single_shot >= greatest(staged, tst, single_shot) - 1e-6 THEN 'single_shot' END) AS best,
       domain = 'overall' AS is_total
FROM pv""")
def method_pivot_best(spark, sf):
    """Domain x method pivot of match accuracy with the best method(s) marked
    within 1e-6 and the overall row flagged to sort last (D22, D23, E11).
    The pivot values come from the fixed method list, so no extra job."""
    ru = domain_rollup(metric_rows(spark, sf))
    pv = ru.groupBy("domain").pivot("method", METHOD_NAMES).agg(F.first(F.round("match_accuracy", 6)))
    top = F.greatest(*[F.col(m) for m in METHOD_NAMES])
    best = F.concat_ws(",", *[F.when(F.col(m) >= top - 1e-6, F.lit(m)) for m in METHOD_NAMES])
    return finalize(pv.select("domain", *[F.round(m, 6).alias(m) for m in METHOD_NAMES],
                              best.alias("best"), (F.col("domain") == "overall").alias("is_total")))


ENS_COMBOS = {"staged+tst": ["staged", "tst"], "staged+single_shot": ["staged", "single_shot"],
              "all": ["staged", "tst", "single_shot"]}
ENS_CAP = 15  # rows of a member that enter an ensemble (E6); a parameter of ensemble_rows


def ensemble_rows(rows, combos: dict, cap: int = ENS_CAP):
    """Per (combo, entry) the first ``cap`` rows of each member method, in
    method order; a group holds at most cap x members rows."""
    capped = rows.withColumn("_r", F.row_number().over(Window.partitionBy("method", "entry_id").orderBy("row_pos"))) \
        .filter(F.col("_r") <= cap).drop("_r")
    named = F.array(*[F.struct(F.lit(c).alias("combo"), F.array(*[F.lit(m) for m in ms]).alias("members"))
                      for c, ms in combos.items()])
    ex = capped.select("*", F.inline(named)).filter(F.array_contains("members", F.col("method"))).drop("members")
    w = Window.partitionBy("combo", "entry_id").orderBy("method_rank", "row_pos")
    return ex.withColumn("ens_pos", F.row_number().over(w) - 1)


@query("ensemble_union", f"""WITH {M.BASE_SQL},
rk AS (SELECT DISTINCT p.method, p.method_rank, p.entry_id, p.row_pos, p.id_val FROM p),
capped AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY method, entry_id ORDER BY row_pos) <= {ENS_CAP}),
combos AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', '{m}')" for c, ms in ENS_COMBOS.items() for m in ms)
       + f""") v(combo, method))
SELECT c.combo, k.entry_id, k.method, k.row_pos, k.id_val,
       row_number() OVER (PARTITION BY c.combo, k.entry_id ORDER BY k.method_rank, k.row_pos) - 1 AS ens_pos
FROM capped k JOIN combos c ON c.method = k.method""")
def ensemble_union(spark, sf):
    """Ensembles (E6, F2): per database, the first 15 rows of each member
    method concatenated in method order; positions are renumbered within the
    (combo, entry) group."""
    rk = M.pred_cells(spark, sf).select("method", "method_rank", "entry_id", "row_pos", "id_val").distinct()
    return finalize(ensemble_rows(rk, ENS_COMBOS).select("combo", "entry_id", "method", "row_pos", "id_val", "ens_pos"))


_ENS_SQL = "(VALUES " + ", ".join(f"('{c}', '{m}')" for c, ms in ENS_COMBOS.items() for m in ms) + ") v(combo, method)"


@query("ensemble_attributes", f"""WITH {M.BASE_SQL},
mem AS (SELECT v.combo, p.entry_id, p.method, p.method_rank, p.table_name, e.domain
        FROM p JOIN {_ENS_SQL} ON v.method = p.method JOIN ents e ON e.entry_id = p.entry_id),
has AS (SELECT combo, entry_id, method, method_rank, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS schema, min(domain) AS domain FROM mem GROUP BY ALL),
nul AS (SELECT *, CASE WHEN {M.sql_hunit("'ens'", 'method', 'entry_id')} < 0.5 THEN NULL ELSE schema END AS own FROM has)
SELECT combo, entry_id, arg_min(own, method_rank) FILTER (WHERE own IS NOT NULL) AS schema, arg_min(domain, method_rank) AS domain, count(*) AS n_members
FROM nul GROUP BY combo, entry_id""")
def ensemble_attributes(spark, sf):
    """Schema and domain of an ensemble: the first member's, in method order, that
    has one (E7). Half of the members, by md5, have lost their schema."""
    p = M.pred_cells(spark, sf).join(M.entry_domains(spark, sf), "entry_id")
    has = p.groupBy("method", "method_rank", "entry_id").agg(F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("s"), F.min("domain").alias("domain"))
    own = F.when(M.hunit(F.lit("ens"), F.col("method"), F.col("entry_id")) < 0.5, F.lit(None)).otherwise(F.col("s"))
    named = F.array(*[F.struct(F.lit(c).alias("combo"), F.array(*[F.lit(m) for m in ms]).alias("members")) for c, ms in ENS_COMBOS.items()])
    ex = has.withColumn("own", own).select("*", F.inline(named)).filter(F.array_contains("members", F.col("method")))
    return finalize(ex.groupBy("combo", "entry_id").agg(
        F.min_by("own", F.when(F.col("own").isNotNull(), F.col("method_rank"))).alias("schema"),
        F.min_by("domain", "method_rank").alias("domain"), F.count(F.lit(1)).alias("n_members")))


_INTEGRITY_SQL = f"""WITH {M.BASE_SQL},
per AS (SELECT c.method, e.domain, c.entry_id, avg(CASE WHEN c.id_val = CAST(c.row_pos + 1 AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS ri
        FROM r c JOIN ents e ON e.entry_id = c.entry_id GROUP BY ALL),
md AS (SELECT method, domain, round(avg(ri), 3) AS ri FROM per GROUP BY ALL),
pv AS (SELECT domain, """ + ", ".join(f"max(ri) FILTER (WHERE method = '{m}') AS {m}" for m in METHOD_NAMES) + " FROM md GROUP BY domain)"


@query("integrity_pivot", _INTEGRITY_SQL + """
SELECT *, concat_ws(',', """ + ", ".join(f"CASE WHEN {m} = greatest({', '.join(METHOD_NAMES)}) THEN '{m}' END" for m in METHOD_NAMES) + """) AS best FROM pv""")
def integrity_pivot(spark, sf):
    """Domain x method pivot of row-id integrity, every method that reaches the row's
    exact maximum marked (D24)."""
    r = M.pred_cells(spark, sf).select("method", "entry_id", "row_pos", "id_val").distinct()
    ok = (F.col("id_val") == (F.col("row_pos") + 1).cast("string")).cast("double")
    per = r.groupBy("method", "entry_id").agg(F.avg(ok).alias("ri")).join(M.entry_domains(spark, sf), "entry_id")
    md = per.groupBy("domain", "method").agg(F.round(F.avg("ri"), 3).alias("ri"))
    pv = md.groupBy("domain").pivot("method", METHOD_NAMES).agg(F.first("ri"))
    top = F.greatest(*METHOD_NAMES)
    best = F.concat_ws(",", *[F.when(F.col(m) == top, F.lit(m)) for m in METHOD_NAMES])
    return finalize(pv.withColumn("best", best))


#: Difficulty of a domain (fixed values of the reports' second axis).
DIFFICULTY = {"automobile": "easy", "building": "easy", "furniture": "medium", "household": "medium", "machinery": "hard"}
_SHORT = {"avg_row_accuracy": "rc", "match_accuracy": "vc", "match_in_right_column_accuracy": "cc"}


@query("difficulty_pivot", M.ROW_MATCH_SQL + f""",
d AS (SELECT method, CASE domain {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DIFFICULTY.items())} END AS difficulty, avg_row_accuracy, match_accuracy,
             match_in_right_column_accuracy FROM rm)
SELECT difficulty, """ + ", ".join(f"round(avg({c}) FILTER (WHERE method = '{m}'), 6) AS {m}_{s}" for m in METHOD_NAMES for c, s in _SHORT.items()) + """
FROM d GROUP BY difficulty""")
def difficulty_pivot(spark, sf):
    """Difficulty x (method, metric) pivot of the three accuracies."""
    level = F.lit(None).cast("string")
    for k, v in DIFFICULTY.items():
        level = F.when(F.col("domain") == k, F.lit(v)).otherwise(level)
    d = metric_rows(spark, sf).withColumn("difficulty", level)
    return finalize(d.groupBy("difficulty").pivot("method", METHOD_NAMES).agg(*[F.avg(c).alias(s) for c, s in _SHORT.items()]))


_LEVELS = ["easy", "medium", "hard"]
_LEVEL_SQL = f"""lv AS (SELECT domain, (['easy', 'medium', 'hard'])[ntile(3) OVER (ORDER BY m, domain)] AS difficulty
  FROM (SELECT domain, avg(length(text)) AS m FROM ({C.ENTRIES_SQL}) e GROUP BY domain) a),
ed AS (SELECT entry_id, domain FROM ({C.ENTRIES_SQL}) e)"""
_COVERAGES = ["tc", "vc", "cc"]


def domain_difficulty(spark, sf):
    """(domain, difficulty) by the mean length of a domain's entries, in three equal parts. One row for each domain."""
    per = C.entries(spark, sf).groupBy("domain").agg(F.avg(F.length("text")).alias("m"))
    return per.select("domain", F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), F.ntile(3).over(Window.orderBy("m", "domain"))).alias("difficulty"))


@query("model_difficulty_pivot", S.SUMMARY_SQL + f""", {_LEVEL_SQL}
SELECT s.variant AS model, lv.difficulty, """ + ", ".join(f"round(avg({c}) FILTER (WHERE method = '{m}'), 6) AS {m}_{c}" for m in S.METHODS for c in _COVERAGES) + """
FROM scores s JOIN ed ON ed.entry_id = s.entry_id JOIN lv ON lv.domain = ed.domain GROUP BY s.variant, lv.difficulty""")
def model_difficulty_pivot(spark, sf):
    """Rows (model, difficulty), three coverages per method (D22): the model is the text
    variant that an extraction read, the difficulty comes from the domain's entries."""
    s = S.cell_scores(spark, sf).join(M.entry_domains(spark, sf), "entry_id").join(domain_difficulty(spark, sf), "domain")
    return finalize(s.withColumnRenamed("variant", "model").groupBy("model", "difficulty").pivot("method", S.METHODS).agg(*[F.avg(c).alias(c) for c in _COVERAGES]))


@query("ri_score_pivot", S.SUMMARY_SQL + f""", {_LEVEL_SQL},
pv AS (SELECT ed.domain, s.variant AS model, """ + ", ".join(f"round(avg(ri) FILTER (WHERE method = '{m}'), 3) AS {m}" for m in S.METHODS) + """
  FROM scores s JOIN ed ON ed.entry_id = s.entry_id GROUP BY ed.domain, s.variant)
SELECT *, concat_ws(',', """ + ", ".join(f"CASE WHEN {m} = greatest({', '.join(S.METHODS)}) THEN '{m}' END" for m in S.METHODS) + ") AS best FROM pv")
def ri_score_pivot(spark, sf):
    """(dataset, model) x method pivot of the referential integrity score, every method that
    reaches the row's exact maximum marked (D24)."""
    s = S.cell_scores(spark, sf).join(M.entry_domains(spark, sf), "entry_id").withColumnRenamed("variant", "model")
    pv = s.groupBy("domain", "model").pivot("method", S.METHODS).agg(F.round(F.avg("ri"), 3))
    best = F.concat_ws(",", *[F.when(F.col(m) == F.greatest(*S.METHODS), F.lit(m)) for m in S.METHODS])
    return finalize(pv.withColumn("best", best))
