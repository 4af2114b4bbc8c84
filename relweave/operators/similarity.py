"""String and vector similarity.

Default text similarity: cosine of character 3-gram count vectors over
``' ' || lower(s) || ' '``. A string's grams, counts and norm are one struct
(:func:`gram_struct`), and the cosine of two structs is an expression
(:func:`gram_cosine`), so strings that are compared inside a bounded block (an
entry, a paragraph, one schema) are scored inside the block's row: each distinct
string gets its grams once, each distinct pair its cosine once, without joins
on strings or grams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions.text import is_number

N_GRAM = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_struct(s: Column, n: int = N_GRAM) -> Column:
    """struct(k: distinct grams, c: gram -> count, norm, and for the bound of
    :func:`may_reach` m: bit mask of the grams' hashes, p: grams that share a bit
    with another, x: highest count) of one string."""
    def grams(p):
        pos = F.when(F.length(p) >= n, F.sequence(F.lit(1), F.length(p) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(pos, lambda i: F.substring(p, i, n))

    def counted(g):
        return let(F.array_distinct(g), lambda k: let(
            F.transform(k, lambda x: (F.size(g) - F.size(F.array_remove(g, x))).cast("bigint")),
            lambda c: let(F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(one_bit(x))), lambda m: F.struct(
                k.alias("k"), F.map_from_arrays(k, c).alias("c"),
                F.sqrt(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x * x)).alias("norm"),
                m.alias("m"), (F.size(k) - F.bit_count(m)).alias("p"), F.coalesce(F.array_max(c), F.lit(0)).alias("x")))))

    def one_bit(gram):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(gram), F.lit(64)))

    return let(F.concat(F.lit(" "), F.lower(s), F.lit(" ")), lambda p: let(grams(p), counted))


def gram_cosine(a: Column, b: Column) -> Column:
    """Cosine of two gram structs; 0 for strings without grams."""
    dot = F.aggregate(F.array_intersect(a["k"], b["k"]), F.lit(0).cast("bigint"),
                      lambda s, k: s + F.element_at(a["c"], k) * F.element_at(b["c"], k))
    return F.when((a["norm"] > 0) & (b["norm"] > 0), dot / (a["norm"] * b["norm"])).otherwise(0.0)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only if the cosine of two gram structs is below ``least`` (> 0) for
    certain: shared grams share a bit, all but ``p`` of them one of their own, and
    none adds more than the product of the highest counts. A few operations on
    numbers that spare most pairs the comparison of grams."""
    shared = F.bit_count(a["m"].bitwiseAND(b["m"])) + a["p"]
    return (shared * a["x"] * b["x"]).cast("double") >= F.lit(least - 1e-9) * a["norm"] * b["norm"]


def cosine_reaches(a: Column, b: Column, least: float) -> Column:
    """``gram_cosine(a, b) >= least``."""
    reached = gram_cosine(a, b) >= least
    return may_reach(a, b, least) & reached if least > 0 else reached


def with_grams(strings: Column) -> Column:
    """array<struct<s, g>> of the distinct strings of an array."""
    return F.transform(F.array_distinct(strings), lambda s: F.struct(s.alias("s"), gram_struct(s).alias("g")))


def partners(left: Column, right: Column, least: float) -> Column:
    """For arrays made by :func:`with_grams`: array<struct<s, near>>, each left
    string with the right strings whose cosine is at least ``least``."""
    return let(right, lambda r: F.transform(left, lambda x: F.struct(x["s"].alias("s"), F.transform(
        F.filter(r, lambda y: cosine_reaches(x["g"], y["g"], least)), lambda y: y["s"]).alias("near"))))


def best_matches(left: Column, right: Column) -> Column:
    """For arrays made by :func:`with_grams`: array<struct<s, best, best_match>>, the
    nearest right string of each left one (ties: the larger string); a left
    string without any right one has 0 and NULL."""
    def one(x, r):
        scored = F.transform(r, lambda y: F.struct(gram_cosine(x["g"], y["g"]).alias("cos"), y["s"].alias("s")))
        return let(F.array_max(scored), lambda m: F.struct(
            x["s"].alias("s"), F.coalesce(m["cos"], F.lit(0.0)).alias("best"), m["s"].alias("best_match")))
    return let(right, lambda r: F.transform(left, lambda x: one(x, r)))


def counted(values: Column) -> Column:
    """array<struct<v, n>>: distinct elements and how often each occurs."""
    return let(values, lambda a: F.transform(F.array_distinct(a), lambda v: F.struct(
        v.alias("v"), (F.size(a) - F.size(F.array_remove(a, v))).alias("n"))))


def value_similarity(gt: Column, cell: Column, cos: Column) -> Column:
    """H1: numeric truth -> 1.0 when the cell is numeric within 0.01, else 0.0;
    otherwise the cosine rescaled to [0, 1] as ``(cos + 1) / 2``."""
    ng, nc = is_number(gt), is_number(cell)
    return (F.when(ng.isNotNull(), F.when(nc.isNotNull() & (F.abs(ng - nc) < 0.01), 1.0).otherwise(0.0))
            .otherwise((cos + 1.0) / 2.0))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two equal-length numeric arrays, JVM-side."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    nb = F.sqrt(F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(0.0)


def near_duplicates(texts: Column, threshold: float) -> Column:
    """H5/H6: positions (0-based) of an array that stay. Item j goes when any
    earlier item i (i < j) has cosine > threshold, even if i itself goes."""
    g = F.transform(texts, lambda t: gram_struct(t))
    return let(g, lambda gs: F.filter(F.transform(gs, lambda x, i: i), lambda j: ~F.exists(
        F.slice(gs, F.lit(1), j), lambda x: may_reach(x, F.get(gs, j), threshold) & (gram_cosine(x, F.get(gs, j)) > threshold))))

