"""Text -> facts (capability 2, J1-J6).

The reference calls a remote language model here. The pluggable interface is a
function ``DataFrame -> DataFrame`` producing facts; the default
``rule_extract`` inverts the row renderer with built-in string functions, and
``model_extractor`` wraps a user's batch model in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import materialize, split_lines, strip_ws
from relweave.operators.joins import union_results

FACT_SCHEMA = T.StructType([
    T.StructField("entry_id", T.LongType()),
    T.StructField("line_pos", T.LongType()),
    T.StructField("fact_pos", T.LongType()),
    T.StructField("attr", T.StringType()),
    T.StructField("value", T.StringType()),
])


def paragraphs(entries: DataFrame, text: str = "text", id_col: str = "entry_id") -> DataFrame:
    """One row per newline-separated paragraph, blanks kept."""
    return entries.select(id_col, F.posexplode(split_lines(text)).alias("line_pos", "line"))


def rule_extract(entries: DataFrame, text: str = "text", id_col: str = "entry_id") -> DataFrame:
    """Facts ``attr is value`` from rendered lines (J3 default).

    A line loses its final period and is split on ``", "``; each item splits at
    its first ``" is "``. Items without one are dropped alone, not the line
    (Q2)."""
    p = paragraphs(entries, text, id_col)
    body = F.regexp_replace(strip_ws("line"), r"\.$", "")
    items = p.select(id_col, "line_pos", F.posexplode(F.split(body, ", ")).alias("fact_pos", "item"))
    at = F.instr("item", " is ")
    return (items.filter(at > 0)
            .select(F.col(id_col).cast("bigint").alias("entry_id"),
                    F.col("line_pos").cast("bigint"), F.col("fact_pos").cast("bigint"),
                    F.expr("substring(item, 1, instr(item, ' is ') - 1)").alias("attr"),
                    F.expr("substring(item, instr(item, ' is ') + 4)").alias("value")))


def model_extractor(predict: Callable, schema: T.StructType = FACT_SCHEMA) -> Callable[[DataFrame], DataFrame]:
    """Wrap a batch model ``pandas.DataFrame -> pandas.DataFrame`` (rows in,
    facts out) as an extractor. Runs per Arrow batch inside the executors."""
    def run(entries: DataFrame) -> DataFrame:
        def batches(it):
            for pdf in it:
                yield predict(pdf)
        return entries.mapInPandas(batches, schema)
    return run


def pending(entries: DataFrame, done: DataFrame, key: str = "entry_id") -> DataFrame:
    """Entries still to process (A8/C12/I11): anti-join on the processed keys."""
    return entries.join(done.select(key).distinct(), key, "left_anti")


def table_of(attr_col: str, prefixes: dict[str, str]) -> F.Column:
    """Table name from an attribute prefix (``c_`` -> customer), else NULL."""
    out = F.lit(None).cast("string")
    for p, t in prefixes.items():
        out = F.when(F.col(attr_col).startswith(p), F.lit(t)).otherwise(out)
    return out


#: Rules of the passes, each wider than those before: separator of a text's items, and
#: an item's pattern with its attribute and value.
PASSES = [(", ", r"(?s)^(.+?) is (.*)$"), (", ", r"(?s)^([^:=]+?)\s*[:=]\s*(.+)$"), (r", |; | and ", r"(?s)^(?:the )?(.+?) (?:was|equals) (.+)$")]


def extract_passes(entries: DataFrame, passes: list[tuple[str, str]] = PASSES, text: str = "text", id_col: str = "entry_id") -> DataFrame:
    """(entry_id, line_pos, pass, attr, value): facts found in several passes (J3). What
    a pass leaves uncovered in a paragraph is the text of the next, wider one; after
    the last, or when nothing is left, the rest stays uncovered. A paragraph never
    leaves its row."""
    t = paragraphs(entries, text, id_col)
    t = materialize(t, [id_col, "line_pos"], rest=F.regexp_replace(strip_ws("line"), r"\.$", ""), found=F.array().cast("array<struct<pass:int,attr:string,value:string>>"))
    for number, (separator, pattern) in enumerate(passes, start=1):
        t = materialize(t, [id_col, "line_pos", "found"], items=F.split("rest", separator))
        got = F.transform(F.filter("items", lambda x: x.rlike(pattern)), lambda x: F.struct(
            F.lit(number).alias("pass"), F.regexp_extract(x, pattern, 1).alias("attr"), F.regexp_extract(x, pattern, 2).alias("value")))
        t = materialize(t, [id_col, "line_pos"], found=F.concat("found", got), rest=F.array_join(F.filter("items", lambda x: ~x.rlike(pattern)), ", "))
    return t.select(F.col(id_col).cast("bigint").alias("entry_id"), F.col("line_pos").cast("bigint"), F.inline("found"))


def bind_passes(facts: DataFrame, catalog: DataFrame, names: list) -> DataFrame:
    """The facts (with ``domain`` and ``attr``) bound to a catalog's columns (J4), and in
    which binding pass. ``names`` are expressions of ``attr``, each a wider way to write a
    column's name; a fact that an earlier one binds doesn't come to the next."""
    todo, bound = facts, []
    cat = catalog.select("domain", F.col("table_name"), F.col("column_name"), F.lower("column_name").alias("_n"))
    for number, name in enumerate(names, start=1):
        j = todo.withColumn("_n", name).join(cat, ["domain", "_n"], "left")
        bound.append(j.where(F.col("column_name").isNotNull()).withColumn("bound_pass", F.lit(number)).drop("_n"))
        todo = j.where(F.col("column_name").isNull()).select(*facts.columns)
    return union_results(bound)
