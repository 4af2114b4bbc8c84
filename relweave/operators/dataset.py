"""Dataset construction (capability 1): render rows as sentences, ground truth,
batching rows into entries, sampling and interleaving domains.

All grouping is on bounded keys (a batch of ``batch`` rows, one entry); windows
are partitioned by a key whose groups are bounded or are evaluated after a
key-local pre-filter, never over the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.text import render_value, row_to_sentence, truth_value
from relweave.operators.heavy import heavy_join
from relweave.operators.windows import rank_in_group


def render_rows(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Add ``sentence`` (G1) rendering every column but the key."""
    return df.withColumn("sentence", row_to_sentence(cols))


def truth_long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Ground truth in long form (G2): ``(key, attr, col_pos, value)`` for every
    present, non-``nan`` cell; attribute names lower-cased."""
    pairs = F.array(*[F.struct(F.lit(c.lower()).alias("attr"), F.lit(i).alias("col_pos"),
                               truth_value(c).alias("value")) for i, c in enumerate(cols)])
    return (df.select(key, F.inline(pairs))
            .filter(F.col("value").isNotNull()))


def present_attrs(cols: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(render_value(c).isNotNull(), F.lit(c.lower()))
                                     for c in cols]))


def batch_entries(rendered: DataFrame, key: str, cols: list[str], batch: int = 5,
                  domain: str = "domain") -> DataFrame:
    """Combine ``batch`` consecutive keys into one entry.

    Groups are ``floor(key / batch)`` -- at most ``batch`` rows each, so the
    ordered ``collect_list`` is bounded whatever the table size. Text joins the
    sentences by newline in key order; entities are the distinct attributes."""
    rows = (rendered.withColumn("entry_id", F.floor(F.col(key) / batch))
            .withColumn("_attrs", present_attrs(cols)))
    return rows.groupBy("entry_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"),
                                                                      F.col("sentence").alias("s")))),
                                 lambda x: x["s"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(domain, key).alias("domain"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_attrs")))), ",")
        .alias("entities"),
        F.sum(F.size("_attrs")).alias("n_pairs"),
    )


def batch_consecutive(rendered: DataFrame, key: str, cols: list[str], batch: int = 5, domain: str = "domain") -> DataFrame:
    """Combine each ``batch`` consecutive rows of one dataset into an entry (D2): rows are
    counted in key order inside their domain, so an entry never mixes domains
    and only a domain's last one may be shorter. Keys alone are numbered."""
    at = rank_in_group(rendered.select(domain, key), domain, [key], out="_at")
    rows = rendered.join(at.select(key, ((F.col("_at") - 1) / batch).cast("long").alias("entry_no")), key).withColumn("_attrs", present_attrs(cols))
    return rows.groupBy(domain, "entry_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("sentence").alias("s"))))["s"], "\n").alias("text"),
        F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_rows"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_attrs")))), ",").alias("entities"))


def entry_truth(truth: DataFrame, key: str, batch: int = 5) -> DataFrame:
    """Ground truth per entry with pair ids renumbered 1..n inside each
    attribute's list, in key order (D2 + E10)."""
    t = truth.withColumn("entry_id", F.floor(F.col(key) / batch))
    w = Window.partitionBy("entry_id", "attr").orderBy(key)
    return t.withColumn("row_id", F.row_number().over(w).cast("string"))


def first_k_per_group(df: DataFrame, group: str, order: list[str], k: int,
                      require_full: bool = True) -> DataFrame:
    """First ``k`` rows per group; groups with fewer than ``k`` rows removed.

    Row numbers come from a window partitioned by ``group``. To keep a hot group
    from landing whole in one task, candidates are first cut to the ``k``
    smallest per (group, hash bucket) -- each bucket's top-k is a superset of
    what the group keeps -- so the final window sees at most ``k * buckets`` rows
    per group. The group size comes from a separate partial-aggregated count."""
    buckets = 64
    b = F.pmod(F.xxhash64(*order), F.lit(buckets))
    pre = (df.withColumn("_b", b)
           .withColumn("_rb", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)))
           .filter(F.col("_rb") <= k).drop("_rb", "_b"))
    ranked = pre.withColumn("rank_in_group",
                            F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    out = ranked.filter(F.col("rank_in_group") <= k)
    if require_full:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
        out = out.join(sizes.select(group), group, "left_semi")
    return out


def round_robin(df: DataFrame, group: str, order: list[str], group_order: list[str]) -> DataFrame:
    """Round-robin interleave (E3): one row per group in the given group order,
    until every group is used; unlisted groups are dropped. ``rn`` is the row's
    position in its group, ``rr_pos`` its 1-based output position: rows are in
    order of (rn, group_rank), and a range-partitioned sort numbers them."""
    rank = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col(group)) - 1
    d = rank_in_group(df.filter(F.col(group).isin(group_order)), group, order, out="rn")
    return rank_in_group(d.withColumn("group_rank", rank.cast("int")), None, ["rn", "group_rank"], out="rr_pos")


def domain_context(df: DataFrame, group: str, order: str, text: str, k: int = 5) -> DataFrame:
    """Text plus the whole texts of the first ``k`` entries of the same group,
    itself skipped, concatenated without separator (E4). Fewer than ``k``
    entries in a group is allowed (Q22). Only the first ``k`` per group are
    gathered; a large group's rows are spread over many tasks, each with a copy of
    that one row."""
    firsts = (first_k_per_group(df.select(group, order, text), group, [order], k, require_full=False)
              .groupBy(group).agg(F.array_sort(F.collect_list(F.struct(
                  F.col(order).alias("o"), F.col(text).alias("t")))).alias("_ctx")))
    j = heavy_join(df, firsts, [group], "left")
    ctx = F.array_join(F.transform(F.filter("_ctx", lambda x: x["o"] != F.col(order)), lambda x: x["t"]), "")
    return j.withColumn("context", F.concat(F.col(text), F.coalesce(ctx, F.lit("")))).drop("_ctx")


def first_seen(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """Each row with its group's first non-empty value in ``order`` (E5): the value
    found once for a group is used for all its entries."""
    v = F.when(F.col(value) != "", F.col(value))
    firsts = df.groupBy(group).agg(F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(out))
    return heavy_join(df, firsts, [group], "left").select(*df.columns, out)


def merged_pairs(rows: DataFrame, entry: str, attr: str, pos: str, value: str) -> DataFrame:
    """Per entry and attribute the distinct (pos, value) pairs, first seen first
    (D2, F5). An entry holds a handful of rows."""
    w = rows.groupBy(entry, attr, pos, value).agg(F.count(F.lit(1)).alias("_n"))
    return w.groupBy(entry, attr).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("pairs"))


def cap_and_append(df: DataFrame, group: str, name: str, order: list[str], k: int) -> DataFrame:
    """Rows of group ``name`` are capped to the first ``k`` and come after all
    other rows. ``part`` 0: others, 1: the capped group."""
    others = df.filter(F.col(group) != name).withColumn("part", F.lit(0))
    capped = first_k_per_group(df.filter(F.col(group) == name), group, order, k, require_full=False)
    return others.unionByName(capped.drop("rank_in_group").withColumn("part", F.lit(1)))


def positional_replace(target: DataFrame, source: DataFrame, group: str, order: str,
                       value_cols: list[str]) -> DataFrame:
    """The i-th row of a group in ``target`` takes the i-th row's values from
    ``source``; rows without a partner keep theirs (C10). Positions come from
    ``rank_in_group`` so a large group is numbered by many tasks."""
    t = rank_in_group(target, group, [order], out="_i")
    s = rank_in_group(source, group, [order], out="_i")
    s = s.select(group, "_i", *[F.col(c).alias(f"_src_{c}") for c in value_cols])
    j = t.join(s, [group, "_i"], "left")
    rep = F.col(f"_src_{value_cols[0]}").isNotNull()
    for c in value_cols:
        j = j.withColumn(c, F.when(rep, F.col(f"_src_{c}")).otherwise(F.col(c)))
    return j.withColumn("replaced", rep).drop("_i", *[f"_src_{c}" for c in value_cols])
