"""Nearest neighbours by a few stable projections and a kd-tree.

Vectors are scaled to length one, where the largest cosine is the smallest
distance, and projected on a few Gaussian directions. For a vector at distance
r the squared projected distance over r squared follows a chi-square law, so
near vectors project near. The upper levels of one kd-tree over the projections
deal all rows to cells, a cell's rows to shards of bounded size, and each shard
has a kd-tree of its own. A query asks one shard of its own cell, then with the
k-th cosine found there the shards of those cells that the chi-square test leaves
open. In a shard it takes leaves and their vectors by projected distance and
verifies them by exact cosine, until the test says that a nearer vector which
projects farther has become unlikely enough.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.session import cut_lineage

#: Most partitions of a search; a partition works its shards one after the other.
MOST_PARTITIONS = 1 << 15


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable of ``dims`` dimensions lies with
    probability ``p``; by bisection on the regularised incomplete gamma series."""
    def cdf(x):
        a, x = dims / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, dims + 20 * math.sqrt(2 * dims) + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class ProjectedTree:
    """A kd-tree over the projections of unit vectors, split at medians down to
    leaves of at most ``leaf`` vectors; ties are split by position."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray, leaf: int = 64):
        self.points = p = unit @ axes.T
        parts = [np.arange(len(p))]
        while len(parts[0]) > leaf or any(len(x) > leaf for x in parts):
            nxt = []
            for x in parts:
                if len(x) <= leaf:
                    nxt.append(x)
                    continue
                axis = int(np.ptp(p[x], axis=0).argmax())
                order = x[np.argsort(p[x, axis], kind="stable")]
                nxt += [order[:len(x) // 2], order[len(x) // 2:]]
            parts = nxt
        self.order = np.concatenate(parts)
        self.ends = np.cumsum([len(x) for x in parts])
        self.low = np.array([p[x].min(0) for x in parts])
        self.high = np.array([p[x].max(0) for x in parts])

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to each leaf's box."""
        out = np.zeros((len(q), len(self.ends)))
        for k in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, k] - q[:, k:k + 1], q[:, k:k + 1] - self.high[:, k]), 0)
            out += gap * gap
        return out


class Shard:
    """The vectors of one shard, ready for queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        # equal vectors are one point of the tree
        order = np.lexsort((ids, *vectors.T[::-1]))
        self.ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], np.any(vectors[1:] != vectors[:-1], axis=1)])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(ids)))
        self.points = vectors[self.first]
        self.norms = np.sqrt((self.points * self.points).sum(1))
        self.axes = axes
        self.tree = ProjectedTree(self.points / self.norms[:, None], axes)
        begins = np.concatenate([[0], self.tree.ends[:-1]])
        self.grid = np.full((len(begins), int((self.tree.ends - begins).max())), -1)
        for j, (a, z) in enumerate(zip(begins, self.tree.ends)):
            self.grid[j, :z - a] = self.tree.order[a:z]

    def search(self, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query position, id, cosine) of each query's nearest vectors here, and how many
        vectors were verified. ``bound``: a cosine that ``k`` others are known to reach."""
        q_norms = np.sqrt((q * q).sum(1))
        p = (q / q_norms[:, None]) @ self.axes.T
        far = self.tree.leaf_distances(p)
        turn = np.argsort(far, axis=1, kind="stable")
        n, keep, verified = len(q), k + 1, 0  # the query itself may be among them
        top_s, top_p = np.full((n, keep), -np.inf), np.full((n, keep), -1)
        live = np.arange(n)
        for step in range(len(self.grid)):
            # vectors nearer than the k-th found project within reach with probability of at least the stop level
            reach = self._reach(np.maximum(top_s[live, k], bound[live]), stop)
            leaf = turn[live, step]
            go = far[live, leaf] <= reach
            live, leaf, reach = live[go], leaf[go], reach[go]
            if not len(live):
                break
            for a in range(0, len(live), 256):
                who, cand = live[a:a + 256], self.grid[leaf[a:a + 256]]
                gap = self.tree.points[np.maximum(cand, 0)] - p[who][:, None, :]
                row, col = np.nonzero((cand >= 0) & ((gap * gap).sum(2) <= reach[a:a + 256, None]))
                at = cand[row, col]
                s = np.full(cand.shape, -np.inf)
                s[row, col] = (self.points[at] * q[who[row]]).sum(1) / (self.norms[at] * q_norms[who[row]])
                verified += len(at)
                cand = np.where(np.isfinite(s), cand, -1)
                s, cand = np.concatenate([top_s[who], s], 1), np.concatenate([top_p[who], cand], 1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :keep]
                top_s[who], top_p[who] = np.take_along_axis(s, best, 1), np.take_along_axis(cand, best, 1)
        return *self._first(q_ids, top_s, top_p, bound, k), verified

    @staticmethod
    def _reach(kth: np.ndarray, stop: float) -> np.ndarray:
        """Squared projected distance up to which a nearer vector is still likely; the
        margin lets copies in, whose projections differ by rounding."""
        return np.where(np.isfinite(kth), stop * (2 - 2 * np.clip(kth, -1, 1)) + 1e-9, np.inf)

    def _first(self, q_ids, top_s, top_p, bound, k):
        hit = (top_p >= 0) & (top_s >= bound[:, None])
        rows, p, s = np.nonzero(hit)[0], top_p[hit], top_s[hit]
        take = np.minimum(self.size[p], k + 1)
        inner = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
        who, vec, score = np.repeat(rows, take), self.ids[np.repeat(self.first[p], take) + inner], np.repeat(s, take)
        other = vec != q_ids[who]
        who, vec, score = who[other], vec[other], score[other]
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        begin = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
        rank = np.arange(len(who)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(who) else np.arange(0)
        best = rank < k
        return who[best], vec[best], score[best]


class Cells:
    """The upper levels of the kd-tree for vectors of one length: ``2 ** depth`` cells,
    split at medians of sampled projections, and each cell's shards."""

    def __init__(self, axes: np.ndarray, sample: np.ndarray, depth: int):
        self.axes, self.depth = axes, depth
        self.axis, self.at = np.zeros(2 ** depth - 1, np.int64), np.zeros(2 ** depth - 1)
        low, high = np.full((1, len(axes)), -np.inf), np.full((1, len(axes)), np.inf)
        parts = [sample]
        for level in range(depth):
            below = []
            for j, x in enumerate(parts):
                node = 2 ** level - 1 + j
                if len(x):
                    self.axis[node] = int(np.ptp(x, axis=0).argmax())
                    self.at[node] = np.median(x[:, self.axis[node]])
                right = x[:, self.axis[node]] >= self.at[node]
                below += [x[~right], x[right]]
            nodes = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
            low, high, parts = np.repeat(low, 2, 0), np.repeat(high, 2, 0), below
            left = 2 * np.arange(2 ** level)
            high[left, self.axis[nodes]] = self.at[nodes]
            low[left + 1, self.axis[nodes]] = self.at[nodes]
        self.low, self.high = low, high
        self.shards = np.ones(len(low), np.int64)
        self.base = 0

    def project(self, v: np.ndarray) -> np.ndarray:
        return v / np.sqrt((v * v).sum(1, keepdims=True)) @ self.axes.T

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] >= self.at[node])
        return node - (2 ** self.depth - 1)

    def deal(self, counts: dict[int, int], shard_rows: int, base: int) -> int:
        """Sets the cells' shards, numbered from ``base``; returns the next number."""
        self.shards = np.array([max(1, -(-counts.get(c, 0) // shard_rows)) for c in range(len(self.low))])
        self.base = base + np.concatenate([[0], np.cumsum(self.shards)[:-1]])
        return base + int(self.shards.sum())

    def shard(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        # the ids' upper product bits: ids in steps are dealt evenly too
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.base[cell] + (mixed % self.shards[cell].astype(np.uint64)).astype(np.int64)

    def distances(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to each cell."""
        out = np.zeros((len(p), len(self.low)))
        for k in range(p.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, k] - p[:, k:k + 1], p[:, k:k + 1] - self.high[:, k]), 0)
            out += gap * gap
        return out


def _lengths(batch: pa.RecordBatch):
    """(length, positions, vectors) of the batch's vectors, by their length; vectors are
    scaled by a power of two, which leaves cosines as they are and squares finite."""
    column = batch.column("v")
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = column.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
        yield int(dim), at, np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _sent(shard, kind: int, ids, vectors: np.ndarray, bound) -> pa.RecordBatch:
    n, dim = vectors.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(shard, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(ids, pa.int64()), lists,
                                       pa.array(np.broadcast_to(np.asarray(bound, np.float64), n))], ["shard", "kind", "id", "v", "bound"])


_SENT = "shard int, kind int, id long, v array<double>, bound double"
_FOUND = "query_id long, vec_id long, score double, shard int"


def _search_shards(axes: dict[int, np.ndarray], k: int, success: float, query_rows: int):
    """Rows sorted by shard, a shard's vectors (kind 0) before its queries (kind 1):
    the tree is built once and the queries stream past it."""
    def run(batches):
        of, held, ready = None, [], None
        for b in batches:
            shard, kind, ids = (b.column(c).to_numpy() for c in ("shard", "kind", "id"))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for part in np.split(np.arange(len(shard)), cut) if len(shard) else []:
                if shard[part[0]] != of:
                    of, held, ready = shard[part[0]], [], None
                rows = b.column("v").slice(int(part[0]), len(part))
                v = rows.flatten().to_numpy().reshape(len(part), -1)
                if not kind[part[0]]:
                    held.append((ids[part], v))
                    continue
                if ready is None:
                    if not held:
                        continue  # an empty cell
                    dim = v.shape[1]
                    ready, held = Shard(*(np.concatenate(x) for x in zip(*held)), axes[dim]), []
                    stop = chi_square_quantile(success, len(axes[dim]))
                bound = b.column("bound").to_numpy()
                for a in range(0, len(part), query_rows):
                    at = part[a:a + query_rows]
                    who, vec, score, _ = ready.search(ids[at], v[a:a + query_rows], bound[at], k, stop)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][who]), pa.array(vec), pa.array(score), pa.array(np.full(len(who), of, np.int32))],
                                                     ["query_id", "vec_id", "score", "shard"])
    return run


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 12,
            success: float = 0.97, block_rows: int = 16_384, query_rows: int = 1024, max_cells: int = 1024, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows by cosine of every row
    whose id is divisible by ``every``, nearest first, ties to the smaller id.

    A true neighbour is found with probability of at least ``success``; what is
    found carries its exact cosine in double precision. Every row is indexed; only
    the cells' borders are fitted on a sample of about 32 rows a cell, at most
    ``max_cells`` cells for each vector length. A cell has as many shards of about
    ``block_rows`` rows as it needs, also where most rows are copies of one vector;
    a shard's queries stream past its tree, and only a shard's ``k`` best leave it.

    Null ids and vectors that are null, zero, empty or hold null or non-finite
    components take no part. An id that repeats counts once, with its smallest
    vector. Vectors of different length are not compared. With fewer than ``k`` others all are
    returned; an empty table gives no rows; extra columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = cut_lineage(df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
                       .groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    cells, n_shards = _fit_cells(rows, dims, block_rows, max_cells, seed)
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def deal(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            for dim, at, x in _lengths(b):
                c = cells[dim]
                yield _sent(c.shard(c.cell(c.project(x)), ids[at]), 0, ids[at], x, -np.inf)

    def home(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            for dim, at, x in _lengths(b):
                c = cells[dim]
                yield _sent(c.shard(c.cell(c.project(x)), ids[at]), 1, ids[at], x, -np.inf)

    def others(batches):
        for b in batches:
            ids, bounds, homes = b.column("id").to_numpy(), b.column("bound").fill_null(-np.inf).to_numpy(), b.column("home").fill_null(-1).to_numpy()
            for dim, at, x in _lengths(b):
                c = cells[dim]
                stop = chi_square_quantile(success, len(c.axes))
                open_ = c.distances(c.project(x)) <= Shard._reach(bounds[at], stop)[:, None]
                for cell in np.flatnonzero(open_.any(0)):
                    for shard in c.base[cell] + np.arange(c.shards[cell]):
                        to = np.flatnonzero(open_[:, cell] & (homes[at] != shard))
                        if len(to):
                            yield _sent(np.full(len(to), shard), 1, ids[at][to], x[to], bounds[at][to])

    dealt = rows.mapInArrow(deal, _SENT)
    search = _search_shards({dim: c.axes for dim, c in cells.items()}, k, success, query_rows)
    parts = min(n_shards, MOST_PARTITIONS)

    def ask(queries):
        return (dealt.unionByName(queries).repartitionById(parts, (F.col("shard") % parts).cast("int"))
                .sortWithinPartitions("shard", "kind").mapInArrow(search, _FOUND))

    asks = rows.where(F.col("id") % every == 0)
    first = cut_lineage(ask(asks.mapInArrow(home, _SENT)))
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"), F.min("shard").alias("home"))
    rest = ask(asks.join(kth, "id", "left").mapInArrow(others, _SENT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _fit_cells(rows: DataFrame, dims: int, block_rows: int, max_cells: int, seed: int) -> tuple[dict[int, Cells], int]:
    """The cells of each vector length and the number of all shards."""
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    cells, n_shards = {}, 0
    for dim, n in sorted(sizes.items()):
        axes = np.random.default_rng(seed).standard_normal((min(dims, dim), dim))
        depth = min(max_cells, -(-n // block_rows)).bit_length() - 1
        mine = rows.where(F.col("dim") == dim)
        sample = np.zeros((0, dim))
        if depth:
            # ids of the smallest hashes, about 32 a cell
            top = min(1.0, 32 * 2 ** depth / n)
            drawn = mine.where(F.xxhash64("id") <= F.lit(int(-(1 << 63) + top * ((1 << 64) - 2048)))).select("v").toArrow().column("v").combine_chunks()
            sample = drawn.flatten().to_numpy().reshape(-1, dim)
        cells[dim] = c = Cells(axes, sample[:0] @ axes.T, 0)
        if depth:
            cells[dim] = c = Cells(axes, c.project(sample), depth)

        def cell_of(batches, c=c):
            for b in batches:
                for _, _, x in _lengths(b):
                    yield pa.RecordBatch.from_arrays([pa.array(c.cell(c.project(x)))], ["cell"])

        counts = {0: n} if not depth else {r.cell: r["count"] for r in mine.select("dim", "v").mapInArrow(cell_of, "cell long").groupBy("cell").count().collect()}
        n_shards = c.deal(counts, block_rows, n_shards)
    return cells, n_shards
