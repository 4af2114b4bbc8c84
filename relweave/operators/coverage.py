"""Scores of one database against one truth, as expressions over arrays (C7-C9,
D11, D14-D16, H3, H4).

A truth is array<struct<attr, row_id, value>>, a database array<struct<row_pos,
column_name, value>>. Both belong to one entry (a handful of rows), so a score
needs no join beyond the one that brings the two together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions.text import NULL_WORDS
from relweave.operators.similarity import counted, let, partners, with_grams

# Least similarity of a value, a column name, a covering cell, a consistent column.
VALUE_T, COLUMN_T, TC_T, CC_T = 0.8, 0.5, 0.7, 0.5


def _is_value(v: Column) -> Column:
    return (v != "") & ~F.lower(v).isin(*NULL_WORDS)


def truth_values(truth: Column) -> Column:
    """All truth values and row ids, empty ones and none/null/na dropped."""
    return F.filter(F.flatten(F.transform(truth, lambda t: F.array(t["row_id"], t["value"]))), _is_value)


def truth_pairs(truth: Column) -> Column:
    """struct(attr, lq) for every truth value and row id, lower-cased."""
    both = F.flatten(F.transform(truth, lambda t: F.array(
        F.struct(t["attr"].alias("attr"), t["row_id"].alias("v")), F.struct(t["attr"].alias("attr"), t["value"].alias("v")))))
    return F.transform(F.filter(both, lambda p: _is_value(p["v"])), lambda p: F.struct(p["attr"].alias("attr"), F.lower(p["v"]).alias("lq")))


def with_id_cells(cells: Column, id_of) -> Column:
    """The cells and, for each row, one of column ``id``; ``id_of`` gives a cell's row id."""
    rows = F.array_distinct(F.transform(cells, lambda c: F.struct(
        c["row_pos"].alias("row_pos"), F.lit("id").alias("column_name"), id_of(c).alias("value"))))
    plain = F.transform(cells, lambda c: F.struct(c["row_pos"].alias("row_pos"), c["column_name"].alias("column_name"), c["value"].alias("value")))
    return F.concat(plain, rows)


def value_targets(truth: Column, all_cells: Column, least: float = TC_T) -> Column:
    """array<struct<v, lv, n, near>>: each distinct truth value, also lower-cased, how
    often it occurs, and the strings among ``all_cells`` that cover it. Scored once per entry and reused
    for all its databases."""
    v = truth_values(truth)
    return F.zip_with(counted(v), partners(with_grams(v), with_grams(all_cells), least),
                      lambda a, b: F.struct(a["v"].alias("v"), F.lower(a["v"]).alias("lv"), a["n"].alias("n"), b["near"].alias("near")))


def column_targets(truth: Column, all_columns: Column, least: float = CC_T) -> Column:
    """array<struct<attr, lq, n, near>>: each distinct truth pair, how often it occurs,
    and the column names close to its attribute."""
    near = partners(with_grams(F.transform(truth, lambda t: t["attr"])), with_grams(all_columns), least)
    return let(near, lambda ps: F.transform(counted(truth_pairs(truth)), lambda c: F.struct(
        c["v"]["attr"].alias("attr"), c["v"]["lq"].alias("lq"), c["n"].alias("n"),
        F.get(F.filter(ps, lambda p: p["s"] == c["v"]["attr"]), F.lit(0))["near"].alias("near"))))


def _share(targets: Column, hit) -> Column:
    """Weighted share of targets for which ``hit`` holds; 0 for no targets."""
    zero = F.lit(0).cast("bigint")
    got = F.aggregate(targets, zero, lambda s, t: s + F.when(hit(t), t["n"]).otherwise(0))
    of = F.aggregate(targets, zero, lambda s, t: s + t["n"])
    return F.when(of > 0, got.cast("double") / of).otherwise(0.0)


def tuple_coverage(targets: Column, cells: Column) -> Column:
    """Share of truth values that some cell covers."""
    return let(F.transform(cells, lambda c: c["value"]), lambda vs: _share(targets, lambda t: F.arrays_overlap(t["near"], vs)))


def value_coverage(targets: Column, cells: Column) -> Column:
    """Share of truth values inside the lower-cased cells joined by `` | ``."""
    line = F.array_join(F.transform(F.array_sort(F.transform(cells, lambda c: F.struct(
        c["row_pos"], c["column_name"], F.lower(c["value"]).alias("v")))), lambda x: x["v"]), " | ")
    return let(line, lambda b: _share(targets, lambda t: (F.size(cells) > 0) & (F.instr(b, t["lv"]) > 0)))


def column_consistency(targets: Column, cells: Column) -> Column:
    """Share of truth pairs whose cells -- those equal to the value, else those
    containing it or contained in it -- sit in a column close to the attribute."""
    low = F.array_distinct(F.transform(cells, lambda c: F.struct(F.lower(c["value"]).alias("lv"), c["column_name"].alias("col"))))

    def hit(cs, lvs, t):
        close = lambda c: F.array_contains(t["near"], c["col"])
        part = lambda c: (F.instr(c["lv"], t["lq"]) > 0) | (F.instr(t["lq"], c["lv"]) > 0)
        return F.when(F.array_contains(lvs, t["lq"]), F.exists(cs, lambda c: (c["lv"] == t["lq"]) & close(c))) \
            .otherwise(F.exists(cs, lambda c: close(c) & part(c)))

    return let(low, lambda cs: let(F.transform(cs, lambda c: c["lv"]), lambda lvs: _share(
        targets, lambda t: F.coalesce(hit(cs, lvs, t), F.lit(False)))))
