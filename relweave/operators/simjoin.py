"""Exact similarity join of strings by prefixes of rare grams.

A string's grams are ordered by how few strings hold them. If two strings' first
common gram stands where either has less than ``t`` of its norm left, their cosine
is below ``t``; so only the grams before that point, the prefix, are indexed. A
pair meets at its first common gram alone, is passed over where the norms left
from there on can't reach ``t``, and is scored once. Grams that many strings share
are dealt out in chunks: the left string goes to one, the right one to all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions.text import materialize
from relweave.operators.similarity import gram_cosine, gram_struct
from relweave.session import cut_lineage

#: Left strings of one gram that meet in one task.
CHUNK = 4096
#: Slack for sums of squares in floating point; too little would lose pairs.
SLACK = 1e-9


def ranked_grams(strings: DataFrame, column: str) -> DataFrame:
    """(s, v, held, left) of the distinct strings: v their gram struct, its grams rarest
    first; held, how many strings hold each gram; left, the share of the norm from
    each gram on."""
    d = strings.select(F.col(column).alias("s")).where(F.col("s").isNotNull()).distinct()
    d = materialize(d, ["s"], g=gram_struct(F.col("s")))
    grams = d.select("s", F.explode("g.k").alias("gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    order = grams.join(df, "gram").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("o"))
    d = d.join(order, "s").select("s", F.col("o.gram").alias("k"), F.col("o.n").alias("held"), F.col("g.c").alias("c"), F.col("g.norm").alias("norm"))
    squares = F.transform("k", lambda x: F.element_at("c", x) * F.element_at("c", x))
    d = materialize(d, ["s", "k", "c", "norm", "held"], q=squares)
    # running sums from the back, then turned round
    back = F.aggregate(F.reverse("q"), F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    d = materialize(d, ["s", "k", "c", "norm", "held"], left=F.transform(F.reverse(back), lambda x: F.sqrt(x.cast("double"))))
    return d.select("s", F.struct("k", "c", "norm").alias("v"), "held", F.transform("left", lambda x: x / F.col("norm")).alias("left"))


def _index(ranked: DataFrame, least: float, side: str, chunk: int) -> DataFrame:
    """The prefix rows of a side, dealt to their gram's chunks."""
    places = F.filter(F.transform("left", lambda x, i: F.struct(F.get("v.k", i).alias("gram"), F.get("held", i).alias("held"), x.alias("left"))),
                      lambda p: p["left"] >= least - SLACK)
    rows = ranked.select(F.col("s").alias(side), F.col("v").alias(f"{side}_v"), F.explode(places).alias("p"))
    chunks = F.ceil(F.col("p.held") / F.lit(chunk)).cast("int")
    part = F.pmod(F.xxhash64(side), chunks).cast("int") if side == "a" else F.explode(F.sequence(F.lit(0), chunks - 1))
    return rows.select("*", part.alias("part")).select(side, f"{side}_v", F.col("p.gram").alias("gram"), "part", F.col("p.left").alias(f"{side}_left"))


def prefix_join(left: DataFrame, right: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b, cos): the pairs of different strings of two :func:`ranked_grams` frames,
    ranked together, whose cosine is at least ``least`` and above 0. ``left`` may be some rows of
    ``right``. Each pair comes once in each direction that the sides hold."""
    a, b = _index(left, least, "a", chunk), _index(right, least, "b", chunk)
    met = a.join(b, ["gram", "part"]).where((F.col("a") != F.col("b")) & (F.col("a_left") * F.col("b_left") >= least - SLACK)
                                            & (F.get(F.array_intersect("a_v.k", "b_v.k"), F.lit(0)) == F.col("gram")))
    return met.select("a", "b", gram_cosine(F.col("a_v"), F.col("b_v")).alias("cos")).where(F.col("cos") >= least)


def best_partners(strings: DataFrame, column: str, similar: float = 0.5, steps: tuple[float, ...] = (0.25, 0.0), chunk: int = CHUNK) -> DataFrame:
    """(s, best, best_match, n_similar): for each distinct string the other one of the
    largest cosine (ties: the larger string; 0 and NULL if none shares a gram), and how many reach ``similar``.

    Strings that have a partner at ``similar`` are done after one join; the others
    look again at lower and lower cosines, where prefixes are longer. Each join
    takes its maximum before anything is shuffled on.
    """
    ranked = cut_lineage(ranked_grams(strings, column))
    todo, found = ranked, None
    for least in (similar, *steps):
        best = (prefix_join(todo, ranked, least, chunk).groupBy("a").agg(F.max(F.struct("cos", "b")).alias("top"), F.count_if(F.col("cos") >= similar).alias("n_similar")))
        best = cut_lineage(best)
        todo = todo.join(best.select(F.col("a").alias("s")), "s", "left_anti")
        found = best if found is None else found.unionByName(best)
    all_strings = strings.select(F.col(column).alias("s")).where(F.col("s").isNotNull()).distinct()
    return (all_strings.join(found.withColumnRenamed("a", "s"), "s", "left")
            .select("s", F.coalesce("top.cos", F.lit(0.0)).alias("best"), F.col("top.b").alias("best_match"), F.coalesce("n_similar", F.lit(0)).alias("n_similar")))
