"""The quote-aware reader of Python literals in model answers."""

import ast
import json
import random

from pyspark.sql import functions as F

from relweave.functions.literals import guarded, last_list, to_json, unguarded


def read(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", expr(F.col("t"))).collect())]


def test_literals_mean_what_python_reads(spark):
    rng = random.Random(3)
    words = ["it's", "None", "True", 'say "no"', "a, b", "x: y", "[1]", "{", "}]", "", "back\\slash", "False,", "é 中"]
    rows = [{"k": rng.randrange(9), "ok": rng.random() < 0.5, "none": None, "note": " ".join(rng.sample(words, rng.randint(1, 4))),
             "list": [rng.choice(words[:5]), None, True]} for _ in range(80)]
    got = read(spark, [repr(r) for r in rows], to_json)
    for r, j in zip(rows, got):
        assert json.loads(j) == {**ast.literal_eval(repr(r)), "note": r["note"] or None}


def test_unescaped_apostrophes_and_json(spark):
    texts = ["{'a': 'it's here', 'b': 'Jo's'}", '{"a": "she said "None" twice", "b": ""}', "{'a': True}", '{"a": "True", "b": null}', "not a literal", "", None]
    got = read(spark, texts, to_json)
    assert [json.loads(x) for x in got[:4]] == [{"a": "it's here", "b": "Jo's"}, {"a": 'she said "None" twice', "b": None}, {"a": True}, {"a": "True", "b": None}]
    assert got[4] == "not a literal" and got[5] == "" and got[6] is None


def test_last_list(spark):
    texts = ["first [{'a': 1}] then [ {'a': 'x }] y'} ] end", "[{'a': 1}, {'a': 2}", "It's none", "[]", "[{'a': 'b'}]\n```"]
    assert read(spark, texts, last_list) == ["[ {'a': 'x }] y'} ]", "[{'a': 1}, {'a': 2}]", None, None, "[{'a': 'b'}]"]


def test_guards_come_off(spark):
    texts = ["```python\nschema = ['a]b', \"c{\"]\n```", "don't touch [this]", "x = 'open [ string"]
    assert read(spark, texts, lambda t: unguarded(guarded(t))) == texts
    assert "]b" not in read(spark, texts, guarded)[0]


def test_long_texts_do_not_overflow(spark):
    text = "{'a': '" + "it's a long [text] \\'here\\' " * 2000 + "'}"
    assert len(json.loads(read(spark, [text], to_json)[0])["a"]) > 40_000
