"""Operator tests on literal fixtures (FIXTURES.md section 3), each compared
with a plain-Python statement of the rule it implements."""

import math
import re

from pyspark.sql import functions as F

from relweave.functions import noise as N
from relweave.functions.text import is_number, join_sentences, row_to_sentence, split_sentences
from relweave.operators.clean import drop_pattern_columns, null_profile
from relweave.operators.dataset import cap_and_append, domain_context, first_k_per_group, first_seen, merged_pairs, positional_replace, round_robin
from relweave.operators.extract import rule_extract
from relweave.operators.joins import fk_share, flatten, merge_nullsafe
from relweave.operators.similarity import best_matches, counted, gram_cosine, gram_struct, near_duplicates, partners, with_grams
from relweave.operators.windows import rank_in_group
from relweave.plans.q_catalog import fks_from_ddl
from relweave.plans.q_load import load_tables, merge_non_null, runtime_type, typed_load


def py_split(text):
    return [p.strip() for p in re.split(r"(?<=\.)\s+", text) if p.strip()]


def test_sentence_split_and_join(spark):
    texts = ["A. B.  C", "No period", "", "1.5 m. End.", "First.\nSecond. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(split_sentences("t")).collect()]
    assert got == [py_split(t) for t in texts]
    joined = [r[0] for r in df.select(join_sentences(split_sentences("t"))).collect()]
    exp = []
    for t in texts:
        j = " ".join(py_split(t))
        exp.append(j + "." if j and not j.endswith(".") else j)
    assert joined == exp


def test_row_to_sentence(spark):
    df = spark.createDataFrame([("'Quoted'", None, "nan", "Mixed Case", "a, b")],
                               "a string, b string, c string, d string, e string")
    got = df.select(row_to_sentence(["a", "b", "c", "d", "e"])).first()[0]
    assert got == "a is quoted, d is mixed case, e is a, b."


def test_is_number(spark):
    vals = ["$1,234.56", "-$1,000", "12,34", "1e3", " ", "42", "3.5"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(is_number("v")).collect()]
    assert got == [1234.56, -1000.0, None, None, None, 42.0, 3.5]


def _noisy(spark, sents, kind, level=1.0):
    df = spark.createDataFrame([("t", 1, sents)], "src string, id int, s array<string>")
    hs = N.sentence_hashes(F.col("s"), F.col("src"), F.col("id"))
    picked = N.picked_flags(hs, level)
    return df.select(N.apply_noise(kind, F.col("s"), picked, F.col("src"), F.col("id"))).first()[0]


def test_noise_type1_changes_first_year_at_match(spark):
    out = _noisy(spark, ["Built in 1998 at 94601.", "code 12345", "12020 in 2020", "no digits"], "type1_contradictory")
    assert re.fullmatch(r"Built in (\d{4}) at 94601\.", out[0]) and 1999 <= int(out[0][9:13]) <= 2008
    assert re.fullmatch(r"code \d{5}", out[1]) and 12355 <= int(out[1][5:]) <= 12444
    assert out[2].startswith("12020 in ") and out[2] != "12020 in 2020"
    assert out[3] == "no digits"


def test_noise_type2_keeps_two(spark):
    for n in (1, 2, 3, 10):
        s = [f"S{i}." for i in range(n)]
        out = _noisy(spark, s, "type2_missing", 1.0)
        assert out == s[:2]


def test_noise_type3_names(spark):
    out = _noisy(spark, ["Dr. Smith of Oakland High School, Alameda County"], "type3_duplicates")
    assert out[0] in ("Smith of Oakland High, Alameda County", "Smith of Oakland High, Alameda")


def test_noise_type4_structure(spark):
    out = _noisy(spark, ["a b", "one two three", "alpha beta gamma delta"], "type4_structural")
    assert out[0] == "a b"
    assert len(out[1].split()) == 3
    assert len(out[2].split()) == 3 and out[2].split()[0] in ("alpha", "lapha", "aplha", "alhpa", "alpah")


def test_sample_count_half_even(spark):
    # max(1, round_half_even(n * level)) sentences are picked
    for n, lvl in ((5, 0.1), (25, 0.1), (15, 0.3), (10, 0.6), (3, 0.1)):
        s = [f"S{i}." for i in range(n)]
        df = spark.createDataFrame([("t", 1, s)], "src string, id int, s array<string>")
        p = df.select(N.picked_flags(N.sentence_hashes(F.col("s"), F.col("src"), F.col("id")), lvl)).first()[0]
        assert sum(p) == min(n, max(1, round(n * lvl)))


def test_rule_extract_roundtrip(spark):
    df = spark.createDataFrame([(1, "a is x, b is 10:30, junk.\nc is y.")], "entry_id long, text string")
    got = sorted((r.line_pos, r.attr, r.value) for r in rule_extract(df).collect())
    assert got == [(0, "a", "x"), (0, "b", "10:30"), (1, "c", "y")]


def test_merge_nullsafe_matches_null_keys(spark):
    l = spark.createDataFrame([(1, "a"), (None, "b")], "k int, name string")
    r = spark.createDataFrame([(1, "x"), (None, "y")], "k2 int, name string")
    got = {tuple(x) for x in merge_nullsafe(l, r, "k", "k2").collect()}
    assert got == {(1, "a", "x"), (None, "b", "y")}


def test_fk_share(spark):
    c = spark.createDataFrame([(1,), (2,), (99,), (None,)], "v int")
    p = spark.createDataFrame([(1,), (2,)], "k int")
    r = fk_share(c, "v", p, "k").first()
    assert (r.n_child, r.n_matched) == (3, 2) and abs(r.share - 2 / 3) < 1e-12
    empty = fk_share(c.filter("v is null"), "v", p, "k").first()
    assert empty.share == 1.0


def test_typed_load_rules(spark):
    raw = spark.createDataFrame([(1, "1", "5", "1.5", "2020-01-02", "True", "F"), (2, "1", "6", "x", "bad", "maybe", None),
                                 (3, "k3", "7", "2", "2020-01-03", "'False'", "O"), (4, None, "#", "?", "2020-01-04", "no", "P"),
                                 (5, "5", "x", "2", "soon", "maybe", "'q'")],
                                "seq long, o_orderkey string, o_custkey string, o_totalprice string, o_orderdate string, o_urgent string, o_orderstatus string")
    x = {r.seq: r for r in typed_load(raw).collect()}
    assert {k: list(r.reasons) for k, r in x.items()} == {
        1: [], 2: ["duplicate_pk"], 3: ["pk_not_integer"], 4: ["pk_null"], 5: ["cast_failed:o_custkey", "cast_failed:o_orderdate", "cast_failed:o_urgent"]}
    assert (x[1].o_custkey, x[1].o_totalprice, x[1].o_urgent, x[1].o_orderstatus) == (5, 1.5, True, "F") and x[5].o_orderstatus == "q"


def test_typed_load_composite_text_and_missing_keys(spark):
    cat = [("a", "INT", True), ("b", "VARCHAR(9)", True), ("c", "DECIMAL(5,2)", False), ("d", "BLOB", False)]
    raw = spark.createDataFrame([(1, "1", "x", "2.5", "z"), (2, "1", "y", "q", "w"), (3, "1", "x", "3", "v"), (4, None, "x", "1", "u")], "seq long, a string, b string, c string, d string")
    got = {r.seq: (r.refused, r.c, r.d, list(r.reasons)) for r in typed_load(raw, cat).collect()}
    assert got == {1: (None, 2.5, "z", []), 2: (None, None, "w", ["cast_failed:c"]), 3: ("duplicate_pk", 3.0, "v", ["duplicate_pk"]), 4: ("pk_null", 1.0, "u", ["pk_null"])}
    free = typed_load(raw, [(c, t, False) for c, t, _ in cat])
    assert free.filter("refused is not null").count() == 0
    assert runtime_type("text") == "string" and runtime_type("decimal(3, 1)") == "double" and runtime_type("geometry") == "string"


def test_load_tables_refuses_unknown_ones(spark):
    raw = spark.createDataFrame([(1, "t", "1"), (2, "u", "2"), (3, None, "3"), (4, "t", "x")], "seq long, table_name string, k string")
    loaded, bad = load_tables(raw, {"t": [("k", "INTEGER", True)]})
    assert [r.k for r in loaded["t"].collect()] == [1]
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [(2, "unknown_table"), (3, "unknown_table"), (4, "pk_not_integer")]


def test_fks_from_ddl(spark):
    ddl = """CREATE TABLE a (id INT PRIMARY KEY, b INT REFERENCES x(y), price DECIMAL(5,2), c INT REFERENCES `z`( w ));
create table if not exists "t" (
  id INT,
  p INTEGER NOT NULL REFERENCES q(r),
  FOREIGN KEY (id) REFERENCES s(u)
);"""
    got = sorted((r.table_name, r.column_name, r.ref_table, r.ref_column) for r in fks_from_ddl(spark.createDataFrame([("d", ddl)], "domain string, ddl string")).collect())
    assert got == [("a", "b", "x", "y"), ("a", "c", "z", "w"), ("t", "p", "q", "r")]


def test_merge_non_null_first_wins_per_column(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 5, "y"), (1, 3, 6, None)], "k int, s int, a int, b string")
    r = merge_non_null(df, ["k"], ["s"], ["a", "b"]).first()
    assert (r.a, r.b) == (5, "x")


def test_rank_in_group_matches_window(spark):
    rows = [(g, i) for g in ("a", "b", "c") for i in range(40 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = sorted(tuple(r) for r in rank_in_group(df, "g", ["i"]).select("g", "i", "rn").collect())
    assert got == sorted((g, i, i + 1) for g, i in rows)
    whole = rank_in_group(df, None, ["g", "i"]).select("rn").collect()
    assert sorted(r.rn for r in whole) == list(range(1, len(rows) + 1))


def test_first_k_and_round_robin(spark):
    rows = [("a", i) for i in range(5)] + [("b", i) for i in range(2)] + [("c", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int")
    fk = sorted(tuple(r) for r in first_k_per_group(df, "g", ["i"], 3).select("g", "i").collect())
    assert fk == [("a", 0), ("a", 1), ("a", 2), ("c", 0), ("c", 1), ("c", 2)]
    rr = round_robin(df, "g", ["i"], ["b", "a"]).orderBy("rr_pos").select("g", "i", "rr_pos").collect()
    assert [(r.g, r.i) for r in rr] == [("b", 0), ("a", 0), ("b", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert [r.rr_pos for r in rr] == list(range(1, 8))


def _py_cos(a, b):
    def grams(s):
        p = " " + s.lower() + " "
        d = {}
        for i in range(len(p) - 2):
            d[p[i:i + 3]] = d.get(p[i:i + 3], 0) + 1
        return d
    x, y = grams(a), grams(b)
    na, nb = math.sqrt(sum(v * v for v in x.values())), math.sqrt(sum(v * v for v in y.values()))
    if not na or not nb:
        return 0.0
    return sum(v * y.get(k, 0) for k, v in x.items()) / (na * nb)


def test_gram_cosine_matches_python(spark):
    pairs = [("red widget", "red widgets"), ("small ring", "tiny bolt"), ("", "x"), ("abc", "abc"), ("aaaa", "aaaaa"), ("", ""), ("Äb", "äB")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", gram_cosine(gram_struct(F.col("a")), gram_struct(F.col("b"))).alias("cos")).collect():
        assert abs(r.cos - _py_cos(r.a, r.b)) < 1e-9


def test_partners_and_best_matches(spark):
    left, right = ["red widget", "bolt", "", "red widget"], ["red widgets", "blue bolt", "bolt", "zz"]
    df = spark.createDataFrame([(left, right), (left, [])], "l array<string>, r array<string>")
    got = df.select(partners(with_grams(F.col("l")), with_grams(F.col("r")), 0.6).alias("p"), best_matches(with_grams(F.col("l")), with_grams(F.col("r"))).alias("b")).collect()
    assert {x.s: set(x.near) for x in got[0].p} == {s: {t for t in right if _py_cos(s, t) >= 0.6} for s in set(left)}
    for x in got[0].b:
        best = max(right, key=lambda t: (_py_cos(x.s, t), t))
        assert x.best_match == best and abs(x.best - _py_cos(x.s, best)) < 1e-9
    assert all(x.best == 0 and x.best_match is None for x in got[1].b)
    assert [(x.v, x.n) for x in df.select(counted(F.col("l")).alias("c")).first().c] == [("red widget", 2), ("bolt", 1), ("", 1)]


def test_near_duplicates_brute_force(spark):
    lines = ["the quick brown fox", "the quick brown fox", "the quick brown fax", "something else",
             "Something else!", "unrelated text here", "the quick brown fox"]
    df = spark.createDataFrame([(1, lines), (2, lines[::-1]), (3, []), (4, ["x"])], "doc long, ts array<string>")
    for thr in (0.97, 0.8, 0.5):
        for r in df.select("ts", near_duplicates(F.col("ts"), thr).alias("kept")).collect():
            assert r.kept == [j for j, t in enumerate(r.ts) if not any(_py_cos(x, t) > thr for x in r.ts[:j])], thr


def test_drop_pattern_columns(spark):
    df = spark.createDataFrame([(1, "v", "x", "y", "z")], "id int, video string, name_x string, name_y string, a string")
    assert drop_pattern_columns(df).columns == ["name", "a"]
    assert drop_pattern_columns(df, whole_token=True).columns == ["video", "name", "a"]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int")
    r = null_profile(df, ["a", "b"]).first()
    assert (r.n_rows, r.n_any_null, r.n_all_null, r.n_after_drop_any, r.n_after_drop_all) == (3, 2, 1, 1, 2)


def test_domain_context_keeps_whole_texts(spark):
    rows = [("a", i, f"<{i}>" + "x" * 500) for i in range(7)] + [("b", 0, "only")]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    got = {(r.g, r.i): r.context for r in domain_context(df, "g", "i", "t", k=5).collect()}
    for g, i, t in rows:
        assert got[g, i] == t + "".join(x for h, j, x in rows if h == g and j != i and j < 5)


def test_first_seen_value_serves_the_group(spark):
    df = spark.createDataFrame([("a", 2, "s2"), ("a", 1, ""), ("a", 3, "s3"), ("b", 1, None)], "g string, i int, v string")
    assert {(r.g, r.i): r.f for r in first_seen(df, "g", "i", "v", "f").collect()} == {("a", 1): "s2", ("a", 2): "s2", ("a", 3): "s2", ("b", 1): None}


def test_merged_pairs_and_cap(spark):
    df = spark.createDataFrame([(1, "x", 1, "p"), (1, "x", 1, "p"), (1, "x", 2, "q"), (1, "y", 1, "p")], "e int, a string, i int, v string")
    got = {(r.e, r.a): [tuple(p) for p in r.pairs] for r in merged_pairs(df, "e", "a", "i", "v").collect()}
    assert got == {(1, "x"): [(1, "p"), (2, "q")], (1, "y"): [(1, "p")]}
    rows = spark.createDataFrame([("f", i) for i in range(30)] + [("g", i) for i in range(3)], "g string, i int")
    got = [(r.g, r.i, r.part) for r in cap_and_append(rows, "g", "f", ["i"], 24).collect()]
    assert sorted(got) == [("f", i, 1) for i in range(24)] + [("g", i, 0) for i in range(3)]


def test_positional_replace_keeps_unmatched_rows(spark):
    t = spark.createDataFrame([("a", 1, "t1"), ("a", 5, "t5"), ("b", 2, "u")], "g string, i int, t string")
    src = spark.createDataFrame([("a", 9, "s1")], "g string, i int, t string")
    got = {(r.g, r.i): (r.t, r.replaced) for r in positional_replace(t, src, "g", "i", ["t"]).collect()}
    assert got == {("a", 1): ("s1", True), ("a", 5): ("t5", False), ("b", 2): ("u", False)}


def test_flatten_from_the_parent_down(spark):
    t = {"p": spark.createDataFrame([(1,), (2,)], "id int"), "c": spark.createDataFrame([(10, 1), (11, 1)], "cid int, pid int"),
         "bridge": spark.createDataFrame([(10, 7)], "cid int, tag int"), "tag": spark.createDataFrame([(7, "x")], "tid int, name string")}
    edges = [{"child": "c", "child_col": "pid", "parent": "p", "parent_col": "id", "reverse": True},
             {"child": "bridge", "child_col": "cid", "parent": "c", "parent_col": "cid", "reverse": True},
             {"child": "bridge", "child_col": "tag", "parent": "tag", "parent_col": "tid", "how": "left"}]
    got = sorted(((r.p_id, r.c_cid, r.tag_name) for r in flatten(t, edges, "p").collect()), key=str)
    assert got == sorted([(1, 10, "x"), (1, 11, None), (2, None, None)], key=str)


def test_one_rewrite_serves_every_noise_level(spark):
    """What the highest level makes of a sentence is what a lower one makes of it; counts follow the same flags."""
    sents = ["Built in 1998 at 94601.", "Mr. Lee of  Alameda County,\tHigh School", "alpha beta gamma delta", "one two", "x", "no digits, 7 or a 12 here", "a b c", "Dr.  Who knows"]
    df = spark.createDataFrame([("s", i, [f"{x} {i}" for x in sents]) for i in range(12)] + [("s", 90, []), ("s", 91, None)], "src string, id long, s array<string>")
    hs, args = N.sentence_hashes(F.col("s"), F.col("src"), F.col("id")), (F.col("src"), F.col("id"))
    df = df.select("*", *[N.picked_flags(hs, lvl).alias(f"p_{name}") for name, lvl in N.LEVELS.items()])
    for kind in N.TYPES:
        one = {name: N.apply_noise(kind, F.col("s"), F.col(f"p_{name}"), *args) for name in N.LEVELS}
        all_ = N.noise_levels(kind, F.col("s"), {name: F.col(f"p_{name}") for name in N.LEVELS}, one["L3"])
        for name in N.LEVELS:
            count = N.n_modified(kind, F.col("s"), one[name] if kind == "type2_missing" else one["L3"], F.col(f"p_{name}"))
            for r in df.select("id", "s", one[name].alias("a"), all_[name].alias("b"), count.alias("n")).collect():
                assert r.a == r.b, (kind, name, r)
                if r.s is not None:
                    assert r.n == (len(r.s) - len(r.a) if kind == "type2_missing" else sum(x != y for x, y in zip(r.s, r.a)))


def test_structural_noise_equals_word_by_word(spark):
    import hashlib
    import re
    sents = ["alpha beta gamma delta epsilon", "one  two\tthree", "ab cd", "Straße été naïve", "x1 2y zz- (abc) def.", "a b c d"]
    rows = [("s", i, [f"{x} w{i}" for x in sents]) for i in range(15)]
    df = spark.createDataFrame(rows, "src string, id long, s array<string>")
    got = {r.id: r.v for r in df.select("id", N.type4(F.col("s"), F.transform("s", lambda x: F.lit(True)), F.col("src"), F.col("id")).alias("v")).collect()}
    for _, i, s in rows:
        for pos, x in enumerate(s):
            h = {t: int(hashlib.md5(f"{t}|42|s|{i}|{pos}".encode()).hexdigest()[:8], 16) for t in ("t4w", "t4d", "t4s")}
            w = re.split(r"\s+", x)
            if len(w) >= 3:
                at = h["t4w"] % len(w)
                end = len(w[at])
                while end and not w[at][end - 1].isalpha():
                    end -= 1
                if end > 2:
                    k = h["t4s"] % (end - 1)
                    w[at] = w[at][:k] + w[at][k + 1] + w[at][k] + w[at][k + 2:]
                if len(w) > 3:
                    del w[1 + h["t4d"] % (len(w) - 2)]
                x = " ".join(w)
            assert got[i][pos] == x
