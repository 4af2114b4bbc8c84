"""Exact search of the largest inner products, by ball trees and shared bounds.

Rows go to the nearest of a few sampled pivots, and a pivot's rows to shards of
bounded size. Every shard has one ball tree, built once and kept in the shared
folder as one row. The inner product of a query with any point of a ball of centre
c and radius r is at most qc + |q|r; nodes are taken in the order of that bound
and left where it is below the query's k-th score. A query first asks one shard of
the most promising region; the k-th score found there goes with it to the other
regions, of which only those whose bound reaches it are asked.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import whole_components
from relweave.session import cut_lineage

#: No score is below this one; products fit into 2^62.
LOWEST = -(1 << 63)


def _above(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A bound computed in floating point, lifted over its own rounding error."""
    return value + 1e-9 * size + 1e-6


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exactly: in floating point where every sum
    stays below 2^53, otherwise in integers."""
    if not len(q) or not len(p):
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1]) < 2 ** 53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ p.astype(np.int64).T


class BallTree:
    """Balls over whole vectors, halved along the line between two far points down to
    leaves of at most ``leaf`` points. Equal vectors are one point, with its
    ``keep`` smallest ids: with one score, ties go to the smaller id."""

    FIELDS = ("points", "ids", "first", "size", "order", "centre", "radius", "begin", "end", "child")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.length = np.sqrt((self.centre * self.centre).sum(1))

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, keep: int, leaf: int = 64) -> BallTree:
        at = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[at], vectors[at]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        group = np.cumsum(new) - 1
        rank = np.arange(len(ids)) - np.flatnonzero(new)[group]
        kept = rank < keep
        points, size = vectors[new], np.bincount(group[kept])
        x = points.astype(np.float64)
        order, centre, radius, begin, end, child = np.arange(len(x)), [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, z, parent = todo.pop()
            mine = x[order[a:z]]
            c = mine.mean(0)
            far = np.sqrt(((mine - c) ** 2).sum(1))
            node = len(centre)
            centre.append(c)
            radius.append(far.max())
            begin.append(a)
            end.append(z)
            child.append((-1, -1))
            if parent >= 0:
                left, right = child[parent]
                child[parent] = (node, right) if left < 0 else (left, node)
            if z - a > leaf:
                one = mine[far.argmax()]
                line = mine[((mine - one) ** 2).sum(1).argmax()] - one
                order[a:z] = order[a:z][np.argsort(mine @ line, kind="stable")]
                mid = (a + z) // 2
                todo += [(mid, z, node), (a, mid, node)]
        return cls(points=points.astype(np.int32), ids=ids[kept], first=np.cumsum(size) - size, size=size, order=order, centre=np.array(centre),
                   radius=np.array(radius), begin=np.array(begin), end=np.array(end), child=np.array(child))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> BallTree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**arrays)

    def search(self, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query position, id, score) of each query's ``k`` best that reach its bound,
        and how many pairs were compared. In every round each query takes its next
        best nodes: one, and twice as many after each round that met leaves; a
        node below the query's k-th score so far is never opened."""
        qf = q.astype(np.float64)
        length = np.sqrt((qf * qf).sum(1))
        bound = bound.astype(np.int64).copy()
        best_q, best_id, best_s = (np.empty(0, np.int64) for _ in range(3))

        def upper(who, node):
            inner = np.einsum("ij,ij->i", qf[who], self.centre[node])
            return _above(inner + length[who] * self.radius[node], length[who] * (self.length[node] + self.radius[node]))

        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        ub = upper(who, node)
        compared, width = 0, 1
        while len(who):
            go = ub >= bound[who]
            who, node, ub = who[go], node[go], ub[go]
            at = np.lexsort((-ub, who))
            who, node, ub = who[at], node[at], ub[at]
            start = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
            turn = np.arange(len(who)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            now = turn < width
            w, x = who[now], node[now]
            who, node, ub = who[~now], node[~now], ub[~now]
            inner = self.child[x, 0] >= 0
            if inner.any():
                wi = np.repeat(w[inner], 2)
                xi = self.child[x[inner]].ravel()
                who, node, ub = np.concatenate([who, wi]), np.concatenate([node, xi]), np.concatenate([ub, upper(wi, xi)])
            got_q, got_p, got_s = [], [], []
            w, x = w[~inner], x[~inner]
            width *= 1 + bool(len(x))
            at = np.argsort(x, kind="stable")
            w, x = w[at], x[at]
            for part in np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1) if len(x) else []:
                p = self.order[self.begin[x[part[0]]]:self.end[x[part[0]]]]
                s = products(q[w[part]], self.points[p])
                compared += s.size
                row, col = np.nonzero(s >= bound[w[part]][:, None])
                got_q.append(w[part][row])
                got_p.append(p[col])
                got_s.append(s[row, col])
            if not got_q:
                continue
            gq, gp, gs = np.concatenate(got_q), np.concatenate(got_p), np.concatenate(got_s)
            take = self.size[gp]
            inner = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            gi = self.ids[np.repeat(self.first[gp], take) + inner]
            gq, gs = np.repeat(gq, take), np.repeat(gs, take)
            other = gi != q_ids[gq]
            cq, ci, cs = (np.concatenate([a, b[other]]) for a, b in ((best_q, gq), (best_id, gi), (best_s, gs)))
            at = np.lexsort((ci, -cs, cq))
            cq, ci, cs = cq[at], ci[at], cs[at]
            start = np.concatenate([[True], cq[1:] != cq[:-1]]) if len(cq) else np.zeros(0, bool)
            rank = np.arange(len(cq)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            best_q, best_id, best_s = cq[rank < k], ci[rank < k], cs[rank < k]
            full = rank == k - 1
            bound[cq[full]] = np.maximum(bound[cq[full]], cs[full])
        reach = best_s >= bound[best_q]
        return best_q[reach], best_id[reach], best_s[reach], compared


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim).astype(np.int64)


def _by_length(batch: pa.RecordBatch):
    """(length, positions, vectors) of a batch's rows of equal length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch.column("v").take(pa.array(at)), int(dim))


class Regions:
    """The pivots of every vector length and, once the table was dealt, each region's
    radius and shards."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radius: dict[int, np.ndarray] = {}
        self.base: dict[int, np.ndarray] = {}
        self.shards: dict[int, np.ndarray] = {}
        self.n_shards = 0

    def nearest(self, dim: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(region, squared distance to its pivot)."""
        p = self.pivots[dim]
        x = v.astype(np.float64)
        at = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
        return at, ((x - p[at]) ** 2).sum(1)

    def deal(self, counts: list[tuple[int, int, int, float]], shard_rows: int) -> None:
        """Numbers the shards: a region has one for every ``shard_rows`` rows."""
        for dim, p in self.pivots.items():
            self.radius[dim], self.base[dim], self.shards[dim] = np.full(len(p), -1.0), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for dim, region, n, far in sorted(counts):
            self.radius[dim][region] = far ** 0.5
            self.base[dim][region], self.shards[dim][region] = self.n_shards, -(-n // shard_rows)
            self.n_shards += -(-n // shard_rows)

    def shard(self, dim: int, region: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A row's shard of its region, from the id's mixed bits."""
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return self.base[dim][region] + (mixed % self.shards[dim][region].astype(np.uint64)).astype(np.int64)

    def upper(self, dim: int, q: np.ndarray) -> np.ndarray:
        """The most that a point of each region can score; empty regions nothing."""
        p, r, x = self.pivots[dim], self.radius[dim], q.astype(np.float64)
        length = np.sqrt((x * x).sum(1))[:, None]
        out = _above(x @ p.T + length * r, length * (np.sqrt((p * p).sum(1)) + r))
        out[:, r < 0] = -np.inf
        return out


def _run_shards(k: int, block: int):
    """Streams a partition's shards: a tree row, then the queries that ask it."""
    def run(batches):
        tree, tree_of = None, None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            ids, bound = b.column("id").to_numpy(), b.column("bound").fill_null(LOWEST).to_numpy()
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for part in np.split(np.arange(len(shard)), cut) if len(shard) else []:
                if not kind[part[0]]:
                    tree, tree_of = BallTree.from_bytes(b.column("data")[part[0]].as_py()), shard[part[0]]
                    continue
                if tree_of != shard[part[0]]:
                    raise RuntimeError("queries came before their tree")
                for at in range(0, len(part), block):
                    rows = part[at:at + block]
                    q = np.stack([np.frombuffer(x.as_py(), np.int32) for x in b.column("data").take(pa.array(rows))])
                    who, found, score, _ = tree.search(ids[rows], q, bound[rows], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows][who]), pa.array(shard[rows][who]), pa.array(found), pa.array(score)], ["query_id", "shard", "vec_id", "score"])
    return run


def top_products(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192,
                 max_regions: int = 1024, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the largest inner product
    with every row whose id is divisible by ``every``, best first, ties to the
    smaller id; components are ``floor(scale * x)``, scores exact.

    All rows are candidates but the query's own id. Null ids and vectors that are
    null or hold null or non-finite components take no part, nor do vectors with a
    component so large that a product wouldn't fit into a long (2^28 and more at 64
    components). An id that repeats counts once, with its smallest vector. Vectors
    of different length are not compared; empty ones score 0 with each other. With
    fewer than ``k`` others all are returned; an empty table gives no rows; extra
    columns are ignored.

    The driver holds at most ``max_regions`` pivots for each vector length, with
    their radius and count. A shard holds about ``shard_rows`` rows whatever the size of the
    table or of a region, and its queries stream past it.
    """
    spark = df.sparkSession
    v = F.col(vector_col)
    usable, whole = whole_components(v, scale, F.least(F.lit(float(1 << 30)), F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1)))))
    rows = (df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.cast("array<int>").alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    rows = cut_lineage(rows)
    sample = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    counted = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    sizes = {dim: -(-n // shard_rows) for dim, n in counted.items()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = min(max_regions, max(sizes.values()))
    picked: dict[int, list] = {}
    # the window gets the rows of the smallest hashes, twice as many as wanted and 32, not all rows of a length
    wide = {dim: min(1.0, (2 * min(most, sizes[dim]) + 32) / n) for dim, n in counted.items()}
    upto = F.create_map(*[F.lit(x) for dim, part in wide.items() for x in (dim, int(part * ((1 << 64) - 2048) - (1 << 63)))])[F.col("dim")]
    drawn = rows.where(F.xxhash64("id") <= upto).withColumn("turn", F.row_number().over(sample)).where(F.col("turn") <= most)
    for r in drawn.select("dim", "turn", "v").collect():
        if r.turn <= sizes[r.dim]:
            picked.setdefault(r.dim, []).append(r.v)
    for dim in sizes.keys() - picked.keys():  # no hash was small enough: the origin stands in
        picked[dim] = [[0] * dim]
    regions = Regions({dim: np.unique(np.array(p, np.float64).reshape(len(p), dim), axis=0) for dim, p in picked.items()})

    def near(batches):
        for b in batches:
            for dim, at, x in _by_length(b):
                region, far = regions.nearest(dim, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(region.astype(np.int32)), pa.array(far)], ["dim", "region", "far"])

    counts = rows.select("dim", "v").mapInArrow(near, "dim int, region int, far double").groupBy("dim", "region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
    regions.deal([tuple(r) for r in counts.collect()], shard_rows)

    def deal(batches):
        for b in batches:
            for dim, at, x in _by_length(b):
                ids = b.column("id").take(pa.array(at))
                shard = regions.shard(dim, regions.nearest(dim, x)[0], ids.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), ids, b.column("v").take(pa.array(at))], ["shard", "id", "v"])

    def plant(batches):
        held, of = [], None

        def tree():
            ids = np.concatenate([h[0] for h in held])
            data = BallTree.build(ids, np.concatenate([h[1] for h in held]), k + 1).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([data], pa.binary()), pa.array([LOWEST], pa.int64())],
                                              ["shard", "kind", "id", "data", "bound"])

        for b in batches:
            shard, ids = b.column("shard").to_numpy(), b.column("id").to_numpy()
            for part in np.split(np.arange(len(shard)), np.flatnonzero(shard[1:] != shard[:-1]) + 1) if len(shard) else []:
                if held and shard[part[0]] != of:
                    yield tree()
                    held = []
                of = shard[part[0]]
                rows_of = b.column("v").slice(int(part[0]), len(part))
                held.append((ids[part], _matrix(rows_of, len(rows_of[0]))))
        if held:
            yield tree()

    task = "shard int, kind int, id long, data binary, bound long"
    trees = cut_lineage(rows.mapInArrow(deal, "shard int, id long, v array<int>").repartitionById(regions.n_shards, "shard")
                        .sortWithinPartitions("shard").mapInArrow(plant, task))
    asks = rows.where(F.col("id") % every == 0)

    def home(batches):
        for b in batches:
            for dim, at, x in _by_length(b):
                ids = b.column("id").to_numpy()[at]
                yield _tasks(regions.shard(dim, regions.upper(dim, x).argmax(1), ids), ids, x, np.full(len(at), LOWEST))

    def others(batches):
        for b in batches:
            for dim, at, x in _by_length(b):
                ids, bound = b.column("id").to_numpy()[at], b.column("bound").fill_null(LOWEST).to_numpy()[at]
                upper = regions.upper(dim, x)
                mine = regions.shard(dim, upper.argmax(1), ids)
                for region in range(upper.shape[1]):
                    go = np.flatnonzero(upper[:, region] >= bound)
                    for shard in regions.base[dim][region] + np.arange(regions.shards[dim][region]):
                        to = go[mine[go] != shard]
                        if len(to):
                            yield _tasks(np.full(len(to), shard), ids[to], x[to], bound[to])

    def ask(tasks):
        return (trees.unionByName(tasks).repartitionById(regions.n_shards, "shard").sortWithinPartitions("shard", "kind")
                .mapInArrow(_run_shards(k, query_block), "query_id long, shard int, vec_id long, score long"))

    first = cut_lineage(ask(asks.mapInArrow(home, task)).drop("shard"))
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound")).withColumnRenamed("query_id", "id")
    rest = ask(asks.join(kth, "id", "left").mapInArrow(others, task)).drop("shard")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _tasks(shard: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    data = [x.tobytes() for x in q.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.ones(len(ids), np.int32)), pa.array(ids), pa.array(data, pa.binary()), pa.array(bound)],
                                      ["shard", "kind", "id", "data", "bound"])
