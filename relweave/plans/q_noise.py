"""Noise injection queries (G6-G11, D20) over documents and rendered entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import noise as N
from relweave.functions.text import finalize, join_sentences, materialize, split_sentences
from relweave.plans import common as C
from relweave.plans.registry import query
from relweave.session import spread
from relweave.sources.tables import read_table


# Words of the staff notes, picked by md5.
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Coach"]
SCHOOLS = ["High School", "Elementary School", "Middle School", "Unified School District", "School District", "College"]


def _pick(tag, words):
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), F.col("s_suppkey").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(h, F.lit(len(words))).cast("int"))


def staff_notes(spark, sf):
    """One note per supplier, case kept: a title, a school, a county, a year and a
    five-digit code."""
    sup = read_table(spark, sf, "supplier")
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = sup.join(n, "s_nationkey")
    text = F.concat(_pick("title", TITLES), F.lit(" Lee of "), "n_name", F.lit(" "), _pick("school", SCHOOLS), F.lit(", Alameda County, knows "), "s_name",
                    F.lit(". The school was founded in "), (F.lit(1900) + F.pmod("s_suppkey", F.lit(100))).cast("string"),
                    F.lit(". Its code is "), (F.lit(10000) + F.pmod(F.col("s_suppkey") * 7, F.lit(90000))).cast("string"),
                    F.lit(". It is in Orange County. Room "), (F.lit(10) + F.pmod("s_suppkey", F.lit(80))).cast("string"), F.lit(" is open."))
    return j.select(F.lit("staff").alias("src"), F.col("s_suppkey").alias("id"), text.alias("text"))


def texts(spark, sf):
    """Documents, rendered customer entries and staff notes as one (src, id, text) table."""
    d = read_table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    e = C.entries(spark, sf).select(F.lit("entry").alias("src"), F.col("entry_id").alias("id"), "text")
    return d.unionByName(e).unionByName(staff_notes(spark, sf))


def with_sentences(df):
    """Sentence array, sampling hashes and one picked-flag array per level,
    each evaluated once per text. Texts are dealt out first: their sentences
    take far longer than the move."""
    t = materialize(spread(df, "src", "id"), ["src", "id"], sents=split_sentences("text"))
    t = materialize(t, ["src", "id", "sents"],
                    hs=N.sentence_hashes(F.col("sents"), F.col("src"), F.col("id")))
    t = materialize(t, ["src", "id", "sents", "hs"], srt=F.sort_array("hs"))
    named = {f"p_{name}": N.picked_flags(F.col("hs"), lvl, F.col("srt")) for name, lvl in N.LEVELS.items()}
    return materialize(t, ["src", "id", "sents"], **named)


TOP = max(N.LEVELS, key=N.LEVELS.get)
FLAGS = {name: f"p_{name}" for name in N.LEVELS}


def at_top_level(t, kinds: list[str], keep: list[str]):
    """``with_sentences`` rows with the sentences as each of ``kinds`` leaves them at
    the highest level, as columns ``top0``, ``top1``, ..."""
    top = {f"top{i}": N.apply_noise(kind, F.col("sents"), F.col(FLAGS[TOP]), F.col("src"), F.col("id")) for i, kind in enumerate(kinds)}
    return materialize(t, [*keep, "sents", *FLAGS.values()], **top)


def noisy_texts(spark, sf, kind: str):
    t = at_top_level(with_sentences(texts(spark, sf)), [kind], ["src", "id"])
    noisy = N.noise_levels(kind, F.col("sents"), {n: F.col(p) for n, p in FLAGS.items()}, F.col("top0"))
    per_level = [F.struct(F.lit(name).alias("level"), join_sentences(v).alias("text")) for name, v in noisy.items()]
    return t.select("src", "id", F.inline(F.array(*per_level)))


# ------------------------------------------------------------------ oracle SQL

_SENT_LIST = r"""list_filter(list_transform(
        string_split(regexp_replace(t.text, '\.\s+', '.' || chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""

def _pick_sql(tag: str, words: list[str]) -> str:
    h = f"('0x' || substr(md5('{tag}|' || CAST(s_suppkey AS VARCHAR)), 1, 8))::BIGINT"
    return f"([{', '.join(repr(w) for w in words)}])[CAST({h} % {len(words)} AS INTEGER) + 1]"


STAFF_SQL = f"""SELECT 'staff' AS src, s_suppkey AS id, {_pick_sql('title', TITLES)} || ' Lee of ' || n_name || ' ' || {_pick_sql('school', SCHOOLS)}
  || ', Alameda County, knows ' || s_name || '. The school was founded in ' || CAST(1900 + s_suppkey % 100 AS VARCHAR)
  || '. Its code is ' || CAST(10000 + (s_suppkey * 7) % 90000 AS VARCHAR) || '. It is in Orange County. Room ' || CAST(10 + s_suppkey % 80 AS VARCHAR) || ' is open.' AS text
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


_BASE = f"""texts AS (
  SELECT 'doc' AS src, doc_id AS id, text FROM documents
  UNION ALL SELECT 'entry' AS src, entry_id AS id, text FROM ({C.ENTRIES_SQL}) e
  UNION ALL {STAFF_SQL}),
lv AS (SELECT * FROM (VALUES ('L1', 0.1::DOUBLE), ('L2', 0.3::DOUBLE), ('L3', 0.6::DOUBLE)) v(level, lvl)),
s AS (SELECT t.src, t.id, u.s, u.o - 1 AS pos FROM texts t, unnest({_SENT_LIST}) WITH ORDINALITY AS u(s, o)),
sn AS (SELECT *, count(*) OVER (PARTITION BY src, id) AS n,
              md5(concat_ws('|', '42', src, CAST(id AS VARCHAR), CAST(pos AS VARCHAR))) AS h FROM s),
p AS (SELECT sn.*, lv.level,
             greatest(1, CAST(round_even(n * lvl, 0) AS INTEGER)) >= n
             OR row_number() OVER (PARTITION BY src, id, lv.level ORDER BY h)
                <= greatest(1, CAST(round_even(n * lvl, 0) AS INTEGER)) AS picked
      FROM sn CROSS JOIN lv)"""


def _hash(tag: str) -> str:
    return (f"('0x' || substr(md5(concat_ws('|', '{tag}', '42', src, CAST(id AS VARCHAR), "
            f"CAST(pos AS VARCHAR))), 1, 8))::BIGINT")


_PRE = r"^((?:.*?[^\pL\pN_])??)"
_POST = r"(?:[^\pL\pN_]|$)"
_Y, _Z, _D = (_PRE + r"((?:19|20)\d{2})" + _POST, _PRE + r"(\d{5})" + _POST, _PRE + r"(\d{2,})" + _POST)


def _bump(pat: str, delta: str) -> str:
    pre, num = f"regexp_extract(s, '(?s){pat}', 1)", f"regexp_extract(s, '(?s){pat}', 2)"
    return (f"{pre} || CAST(CAST({num} AS DECIMAL(38,0)) + {delta} AS VARCHAR) || "
            f"substr(s, length({pre}) + length({num}) + 1)")


_H1 = _hash("t1")
NOISY_SQL = {
    "type1_contradictory": f"""CASE WHEN NOT picked THEN s
        WHEN regexp_matches(s, '(?s){_Y}') THEN {_bump(_Y, f'(1 + {_H1} % 10)')}
        WHEN regexp_matches(s, '(?s){_Z}') THEN {_bump(_Z, f'(10 + {_H1} % 90)')}
        WHEN regexp_matches(s, '(?s){_D}') THEN {_bump(_D, f'(5 + {_H1} % 46)')}
        ELSE s END""",
    "type3_duplicates": r"""CASE WHEN NOT picked THEN s ELSE (
        CASE WHEN """ + _hash("t3") + r""" / 4294967296.0 < 0.5
             THEN regexp_replace(x3, '\b(\w+)\s+County\b', '\1', 'g') ELSE x3 END) END""",
    "type4_structural": r"""CASE WHEN NOT picked OR len(ws) < 3 THEN s ELSE array_to_string(list_filter(
        list_transform(ws, lambda w, j: CASE WHEN j - 1 = """ + _hash("t4w") + r""" % len(ws)
            AND length(regexp_replace(w, '\PL+$', '')) > 2 THEN
              substr(w, 1, hs % (length(regexp_replace(w, '\PL+$', '')) - 1))
              || substr(w, hs % (length(regexp_replace(w, '\PL+$', '')) - 1) + 2, 1)
              || substr(w, hs % (length(regexp_replace(w, '\PL+$', '')) - 1) + 1, 1)
              || substr(w, hs % (length(regexp_replace(w, '\PL+$', '')) - 1) + 3)
            ELSE w END),
        lambda w, j: NOT (len(ws) > 3 AND j - 1 = 1 + """ + _hash("t4d") + r""" % (len(ws) - 2))), ' ') END""",
}

_X3 = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
  '\bMr\.\s+', '', 'g'), '\bMrs\.\s+', '', 'g'), '\bMs\.\s+', '', 'g'), '\bDr\.\s+', '', 'g'),
  '\bProf\.\s+', '', 'g'), '\bHigh School\b', 'High', 'g'), '\bElementary School\b', 'Elementary', 'g'),
  '\bMiddle School\b', 'Middle', 'g'), '\bUnified School District\b', 'Unified', 'g'),
  '\bSchool District\b', 'District', 'g')"""


def _noisy_rows(kind: str) -> str:
    if kind == "type2_missing":
        return """q AS (SELECT *, sum(CASE WHEN picked THEN 0 ELSE 1 END) OVER (PARTITION BY src, id, level) AS n_kept
                  FROM p),
r AS (SELECT src, id, level, pos, s AS ns, s FROM q WHERE CASE WHEN n_kept < 2 THEN pos < 2 ELSE NOT picked END)"""
    return f"""q AS (SELECT *, string_split_regex(s, '\\s+') AS ws, {_X3} AS x3, {_hash('t4s')} AS hs FROM p),
r AS (SELECT src, id, level, pos, {NOISY_SQL[kind]} AS ns, s FROM q)"""


def noisy_sql(kind: str) -> str:
    return f"""WITH {_BASE},
{_noisy_rows(kind)},
j AS (SELECT t.src, t.id, lv.level,
             coalesce(string_agg(r.ns, ' ' ORDER BY r.pos) FILTER (WHERE r.ns <> ''), '') AS txt
      FROM texts t CROSS JOIN lv LEFT JOIN r ON r.src = t.src AND r.id = t.id AND r.level = lv.level
      GROUP BY t.src, t.id, lv.level)
SELECT src, id, level, CASE WHEN txt = '' OR suffix(txt, '.') THEN txt ELSE txt || '.' END AS text FROM j"""


def _register(kind: str, name: str):
    @query(name, noisy_sql(kind))
    def _q(spark, sf):
        return finalize(noisy_texts(spark, sf, kind))
    return _q


for _kind, _name in [("type1_contradictory", "noise_contradictory"), ("type2_missing", "noise_missing"),
                     ("type3_duplicates", "noise_duplicates"), ("type4_structural", "noise_structural")]:
    _register(_kind, _name)


def _stats_sql() -> str:
    parts = []
    for kind in N.TYPES:
        if kind == "type2_missing":
            body = f"""{_noisy_rows(kind)}
SELECT '{kind}_' || lv.level AS variant, (SELECT count(*) FROM sn) - count(r.pos) AS n_modified
FROM lv LEFT JOIN r ON r.level = lv.level GROUP BY lv.level"""
        else:
            body = f"""{_noisy_rows(kind)}
SELECT '{kind}_' || level AS variant, count(*) FILTER (WHERE ns <> s) AS n_modified FROM r GROUP BY level"""
        parts.append(f"(WITH {_BASE}, {body})")
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH m AS ({union}), tot AS (SELECT count(*) AS n_total FROM (WITH {_BASE} SELECT * FROM sn) z)
SELECT variant, CAST(n_modified AS BIGINT) AS n_modified, CAST(n_total AS BIGINT) AS n_total,
       round(100.0 * n_modified / n_total, 6) AS pct FROM m CROSS JOIN tot"""


@query("noise_matrix_stats", _stats_sql())
def noise_matrix_stats(spark, sf):
    """Per variant: modified sentences, total sentences, percentage.
    The sentence split is computed once per text, a sentence is rewritten once by each
    type and all 12 variants are counted from the same arrays, so each text is read once."""
    rewritten = [kind for kind in N.TYPES if kind != "type2_missing"]
    t = at_top_level(with_sentences(texts(spark, sf)), rewritten, [])
    sents, cells = F.col("sents"), []
    for kind in N.TYPES:
        for name, p in FLAGS.items():
            noisy = F.col(f"top{rewritten.index(kind)}") if kind in rewritten else N.type2(sents, F.col(p))
            cells.append(F.struct(F.lit(f"{kind}_{name}").alias("variant"), N.n_modified(kind, sents, noisy, F.col(p)).alias("m")))
    per = t.select(F.size("sents").alias("n"), F.inline(F.array(*cells)))
    agg = per.groupBy("variant").agg(F.sum("m").alias("n_modified"), F.sum("n").alias("n_total"))
    return finalize(agg.withColumn("pct", F.round(F.col("n_modified") * 100.0 / F.col("n_total"), 6)))
