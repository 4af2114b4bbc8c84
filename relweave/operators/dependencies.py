"""Minimal functional dependencies of a table, found level by level."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import cut_lineage


def class_counts(rows: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """How many classes of equal rows each set of columns makes, all sets in one pass;
    null counts as a value. The driver gets one number for each set."""
    def key(cols):
        return F.array(*[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in cols])

    if not sets:
        return {}
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("s"), key(cols).alias("k")) for i, cols in enumerate(sets)])))
    got = {r.s: r.n for r in long.groupBy("s", "k").agg(F.lit(1)).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {cols: got.get(i, 0) for i, cols in enumerate(sets)}


def minimal_dependencies(df: DataFrame, columns: list[str], most: int = 2) -> list[tuple[tuple[str, ...], str]]:
    """(left columns, right column) of every dependency that holds, has at most ``most``
    left columns, and holds for no fewer of them; a constant column depends on none.

    X -> A holds when X and X with A make equally many classes. A level's sets are the
    unions of the level before that can still give a minimal dependency: not above a key, nor
    above columns one of which depends on the others. Rows are reduced to distinct
    ones first; an empty table gives none.
    """
    rows = cut_lineage(df.select(*[F.col(f"`{c}`") for c in columns]).distinct())
    total = rows.count()
    if not total:
        return []
    classes = {(): 1}
    found: dict[str, list[tuple[str, ...]]] = {c: [] for c in columns}
    level: list[tuple[str, ...]] = [()]
    for size in range(most + 1):
        open_pairs = [(x, a) for x in level for a in columns if a not in x and not any(set(y) <= set(x) for y in found[a])]
        ordered = lambda x, a: tuple(c for c in columns if c in x or c == a)
        classes |= class_counts(rows, sorted({ordered(x, a) for x, a in open_pairs} - set(classes)))
        for x, a in open_pairs:
            if classes[x] == classes[ordered(x, a)]:
                found[a].append(x)
        if size < most:
            nxt = {tuple(c for c in columns if c in x or c == a) for x in level for a in columns if a not in x}
            classes |= class_counts(rows, sorted(nxt - set(classes)))
            level = [x for x in sorted(nxt) if not any(set(y) <= set(x) - {a} for a in x for y in found[a])
                     and not any(classes.get(y) == total for k in range(len(x)) for y in combinations(x, k))]
    return sorted((x, a) for a, xs in found.items() for x in xs)
