"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit SimHashes over word shingles. Two fingerprints link when
they differ in few bits. Equal fingerprints are one trie leaf, so copies never
become pairs. The trie is joined with itself: pairs of nodes are descended
together, the differing bits so far are added up, and a pair whose sum exceeds
the budget is dropped with everything below it.

To spread the join over tasks the 64 bits are cut into budget+1 blocks. Two
fingerprints within the budget agree on at least one block, so for each block a
trie with that block's bits on top is partitioned by the block; node pairs then
start below the shared block with no differing bits. A block value with more
fingerprints than one task should hold is itself split into node pairs of its
next bits, of which only those within the budget meet.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import pick, slices
from relweave.session import cut_lineage

_CHUNK = 1 << 18  # node pairs or leaf pairs worked on at a time


# ---------------------------------------------------------------- fingerprints

def fingerprint_of(text: str, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: ASCII letters lower-cased, words split at ASCII white
    space, XXH64 over space-joined shingles; no words gives 0."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return _majority([xxhash.xxh64_intdigest(b" ".join(words), seed)])
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return _majority([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())])


def _majority(hashes: list[int]) -> int:
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long. Null text: as empty."""
    def run(batches):
        last: tuple[str, int] | None = None
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                if last is None or last[0] != t:
                    last = (t, fingerprint_of(t or "", size))
                out.append(last[1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return pick(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- trie join

class Forest:
    """Union-find over array positions; keeps the smallest position as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j = i[apart], j[apart]
            if not len(i):
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_join(v: np.ndarray, nodes: np.ndarray, depth: int, budget: int, forest: Forest) -> None:
    """Joins trie nodes of the sorted values ``v``. ``nodes``: rows (a_lo, a_hi,
    b_lo, b_hi, diff) of node pairs at bit ``depth``; equal ranges mean a node
    with itself. Links go into ``forest``; memory stays bounded because the
    frontier is worked on depth first in pieces."""
    stack = [(depth, nodes)]
    while stack:
        d, pairs = stack.pop()
        if len(pairs) > _CHUNK:
            stack.append((d, pairs[_CHUNK:]))
            pairs = pairs[:_CHUNK]
        same = pairs[:, 0] == pairs[:, 2]
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        pairs = pairs[~(same & (na < 2))]
        if not len(pairs):
            continue
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 64) | (d >= 64)
        _leaves(v, pairs[small], budget, forest)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        high = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)

        def middle(lo, hi):
            return np.clip(np.searchsorted(v, (v[lo] & high) | bit), lo, hi)

        al, ah, bl, bh, diff = pairs.T
        am, bm = middle(al, ah), middle(bl, bh)
        same = al == bl
        down = [np.stack(x, 1) for x in ((al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1))]
        down.append(np.stack((am, ah, bl, bm, diff + 1), 1)[~same])  # a node with itself: one mixed pair
        nxt = np.concatenate(down)
        nxt = nxt[(nxt[:, 4] <= budget) & (nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3])]
        if len(nxt):
            stack.append((d + 1, nxt))


def _leaves(v: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Compares all leaves of small node pairs."""
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    ends = np.cumsum(sizes)
    start = 0
    while start < len(pairs):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + 8 * _CHUNK, "right")))
        p, n = pairs[start:stop], sizes[start:stop]
        start = stop
        at = np.repeat(np.arange(len(p)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        wide = (p[:, 3] - p[:, 2])[at]
        i, j = p[at, 0] + k // wide, p[at, 2] + k % wide
        near = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
        forest.link(i[near], j[near])


def _turn(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if not by else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _divided(nodes: DataFrame, depth: int, width: int, budget: int, bits: int) -> DataFrame:
    """The rows of overfull node pairs, dealt to the pairs of child nodes ``bits`` bits
    further down whose error budget isn't exceeded."""
    masks = [F.struct(F.lit(sum(1 << i for i in c)).cast("long").alias("m"), F.lit(k).alias("k"))
             for k in range(budget + 1) for c in itertools.combinations(range(bits), k)]
    spent = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    below = (nodes.withColumn("own", F.expr(f"shiftrightunsigned(turned, {64 - width - depth}) & {(1 << depth) - 1}L"))
             .withColumn("next", F.expr(f"shiftrightunsigned(turned, {64 - width - depth - bits}) & {(1 << bits) - 1}L"))
             .withColumn("c", F.explode(F.filter(F.array(*masks), lambda c: c.k + spent <= budget))))
    here, there = (F.shiftleft(F.col(c), bits) for c in ("p", "q"))
    mine, other = F.col("next"), F.col("next").bitwiseXOR(F.col("c.m"))
    # one node paired with itself: the smaller child first; two nodes: each row on its own side
    same, left = F.col("p") == F.col("q"), F.col("own") == F.col("p")
    p = F.when(same, here + F.least(mine, other)).when(left, here + mine).otherwise(here + other)
    q = F.when(same, there + F.greatest(mine, other)).when(left, there + other).otherwise(there + mine)
    return below.select("r", "block", p.alias("p"), q.alias("q"), "fp", "turned")


def links(fps: DataFrame, budget: int = 3, split_over: int = 200_000, split_bits: int = 6) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column ``fp``) that connect
    exactly what is within ``budget`` differing bits; each task returns at most
    one edge per fingerprint it holds, never the pairs themselves.

    A pair of trie nodes with more than ``split_over`` fingerprints is divided into its
    pairs of child nodes, level by level until none is over."""
    blocks = budget + 1
    width = 64 // blocks
    turned = fps.select("fp", F.explode(F.array(*[F.lit(r) for r in range(blocks)])).alias("r"))
    # the bits after the block, in the turned order (wrapping round at the end)
    turned = turned.withColumn("turned", F.expr(
        "CASE r WHEN 0 THEN fp " + " ".join(
            f"WHEN {r} THEN shiftleft(fp, {r * width}) | shiftrightunsigned(fp, {64 - r * width})" for r in range(1, blocks)) + " END"))
    nodes = turned.withColumn("block", F.expr(f"shiftrightunsigned(turned, {64 - width})")).select(
        "r", "block", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "fp", "turned")
    key, depth, ready = ["r", "block", "p", "q"], 0, None
    while True:
        # overfull pairs: at most one for split_over rows
        over = cut_lineage(nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_over).select(*key))
        more = depth + split_bits <= 64 - width and not over.isEmpty()
        fine = (nodes.join(over, key, "left_anti") if more else nodes).select(*key, F.lit(depth).alias("depth"), "fp")
        ready = fine if ready is None else ready.unionByName(fine)
        if not more:
            break
        nodes = cut_lineage(_divided(nodes.join(over, key, "left_semi"), depth, width, budget, split_bits))
        depth += split_bits

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        r, block, p, q, deep = (t.column(c).to_numpy().astype(np.int64) for c in ("r", "block", "p", "q", "depth"))
        fp = t.column("fp").to_numpy().view(np.uint64)
        for turn in range(blocks):
            mine = r == turn
            if not mine.any():
                continue
            value, group = _turn(fp[mine], turn * width), np.stack((block[mine], deep[mine], p[mine], q[mine]), 1)
            order = np.lexsort((value, group[:, 3], group[:, 2], group[:, 1], group[:, 0]))
            value, group = value[order], group[order]
            cut = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(value)]])
            whole = group[lo, 1] == 0
            forest = Forest(len(value))
            # one sorted array per group is needed for binary search across groups: a
            # plain group is sorted globally by its block already; node pairs are run one by one
            if whole.any():
                keep = np.repeat(whole, hi - lo)
                v = value[keep]
                n = (hi - lo)[whole]
                e = np.cumsum(n)
                plain = Forest(len(v))
                trie_join(v, np.stack((e - n, e, e - n, e, np.zeros_like(e)), 1), width, budget, plain)
                forest.root[keep] = np.flatnonzero(keep)[plain.root]
            for a, b, (_, d, x, y) in zip(lo[~whole], hi[~whole], group[lo[~whole]].tolist()):
                v = value[a:b]
                one = Forest(len(v))
                if x == y:
                    node = np.array([[0, len(v), 0, len(v), 0]])
                else:
                    side = (v >> np.uint64(64 - width - d)) & np.uint64((1 << d) - 1)
                    m = int(np.searchsorted(side, np.uint64(max(x, y))))
                    node = np.array([[0, m, m, len(v), (x ^ y).bit_count()]])
                    if not 0 < m < len(v):
                        continue
                trie_join(v, node, width + d, budget, one)
                forest.root[a:b] = a + one.root
            linked = np.flatnonzero(forest.root != np.arange(len(value)))
            back = _turn(value, 64 - turn * width) if turn else value
            yield pa.RecordBatch.from_arrays([pa.array(back[linked].view(np.int64)), pa.array(back[forest.root[linked]].view(np.int64))], ["a", "b"])

    return ready.repartition(*key).mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars;
    every round is a grouped minimum and a join, cut by a checkpoint."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("s")).select("s.a", "s.b")
        e = cut_lineage(stars.where("a <> b").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                       budget: int = 3, split_over: int = 200_000) -> DataFrame:
    """(doc_id, fingerprint, component_id): ``fingerprint`` as 16 hex digits,
    ``component_id`` the smallest doc_id reachable over links of at most
    ``budget`` differing bits, the document itself included.

    Null and empty texts and texts without words have fingerprint 0 and link like
    any other. A text of fewer than ``size`` words is one shingle. A bit set in
    exactly half the shingles is 0. Repeated rows stay, each with the same
    answer. Null ids are ignored for the minimum; a component of null ids only
    has a null id. An empty table gives no rows; extra columns are ignored.
    """
    fps = cut_lineage(fingerprints(df, id_col, text_col, size))
    ids = _roots(fps, budget, split_over).select("fp", "component_id")
    return (fps.join(ids, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _roots(fps: DataFrame, budget: int, split_over: int) -> DataFrame:
    """(fp, root, component_id): every fingerprint's component, named by a fingerprint
    and by the smallest id (null where all ids are)."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(distinct.select("fp"), budget, split_over))
    # only fingerprints that link to another one
    named = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def first_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
               budget: int = 3, split_over: int = 200_000) -> DataFrame:
    """One row, all columns kept, of each component: the first by id, nulls last, and
    then by the other columns in their order (nulls first).

    Components are those of :func:`simhash_components` and belong to rows, not to
    ids: rows of one id, or of none, whose texts aren't near each other all stay.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    fps = cut_lineage(fingerprints(df, id_col, text_col, size))
    # the texts meet only the (fingerprint, id) pairs that can stay, so a large group of copies isn't one key
    firsts = (fps.distinct().join(_roots(fps, budget, split_over), "fp").where("doc_id <=> component_id")
              .select("fp", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "root"))

    def run(batches):
        for b in slices(batches):
            fp = pa.array(np.array([fingerprint_of(t or "", size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("record"), b.column("id"), b.column("no_id"), fp], ["record", "id", "no_id", "fp"])

    key = F.col(id_col).cast("long")
    rows = df.select(F.struct(*columns).alias("record"), F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("no_id"),
                     F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("fp", T.LongType())])
    kept = rows.mapInArrow(run, schema).join(firsts, ["fp", "id", "no_id"])
    # ids of a component's rows are equal here
    order = [id_col, *(c for c in df.columns if c != id_col)]
    best = kept.groupBy("root").agg(F.min(F.struct(*[F.col(f"record.`{c}`") for c in order])).alias("best"))
    return best.select(*[F.col(f"best.`{c}`") for c in df.columns])
