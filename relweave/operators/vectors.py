"""Near-duplicate vectors, exactly, by pivots and the triangle inequality (H6).

Vectors are scaled to length one, where a cosine above ``t`` is a distance below
``r = sqrt(2 - 2t)``. Every vector lives in the cell of its nearest pivot and also
visits the cells that its radius touches: those whose border (the plane halfway
between the two pivots) and whose farthest member are within ``r``. Two near
vectors therefore meet in the home cell of either. A vector may touch a good part
of all cells, so it is written once only, to a bounded block of cells (a crowded
cell fills several), and each task reads two blocks and finds there who visits whom.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import cut_lineage, share_package


def _unit(column, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten()).reshape(len(column), dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _apart(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))


def _touched(d: np.ndarray, own: np.ndarray, apart: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Which cells (columns) the vectors (rows) touch, by their distances to the cells' pivots and to
    their own one, and by how far apart those pivots are."""
    with np.errstate(divide="ignore", invalid="ignore"):
        border = np.where(apart > 0, (d * d - own * own) / (2 * apart), 0.0)
    return (border <= r + SLACK) & (d <= radius + r + SLACK)


#: Distances to pivots that a task holds at a time, and components of the rows that it hands on at a time.
MATRIX_CELLS, OUT_COMPONENTS = 1 << 20, 1 << 19
#: Rounding of distances, most where two pivots nearly coincide.
SLACK = 1e-6
#: The vectors fill so many blocks, or more: a block has at most so many components. Dimensions of the first, rough comparison.
BLOCKS, HELD_COMPONENTS, ROUGH = 8, 1 << 21, 15


def pieces(batches: Iterable[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows, so many at a time that a matrix of ``wide`` columns stays small."""
    rows = max(1, MATRIX_CELLS // max(1, wide))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def visits(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, r: float, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell that a vector belongs to or touches; ``between``: the
    pivots' distances, if they are at hand."""
    d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
    home = d.argmin(1)
    own = d[np.arange(len(x)), home][:, None]
    touched = _touched(d, own, (_apart(pivots) if between is None else between)[home], radius, r)
    touched[np.arange(len(x)), home] = True
    return np.nonzero(touched)


def copies(batches: Iterable[pa.RecordBatch], dims: int, pivots: np.ndarray, radius: np.ndarray, r: float) -> Iterator[pa.RecordBatch]:
    """(cell, home, id, v): each vector (id, v) once for every cell that it visits. A
    vector may visit many cells, so the copies leave in batches of bounded size
    (and drop_near_copies, which would have to write them, compares blocks instead)."""
    between, most = _apart(pivots), max(1, OUT_COMPONENTS // dims)
    for b in pieces(batches, len(pivots)):
        x = _unit(b.column("v"), dims)
        own = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0)).argmin(1)
        rows, cells = visits(x, pivots, radius, r, between)
        for start in range(0, len(rows), most):
            at, cell = rows[start:start + most], cells[start:start + most]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own[at] == cell), b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at))], ["cell", "home", "id", "v"])


def first_of_equals(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the rows with the smallest id among equal vectors."""
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
    return order[np.unique(raw, return_index=True)[1]]


def fill_blocks(members: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first, many, total): each cell's first block and the number of blocks that it is dealt
    over; a block has about ``held`` rows at most."""
    first, many, total, room = np.zeros(len(members), np.int64), np.ones(len(members), np.int64), 0, 0
    open_block = 0
    for c, n in enumerate(members):
        if n > held:
            first[c], many[c] = total, -(-n // held)
            total += int(many[c])
            continue
        if n > room or not total:
            open_block, room, total = total, held, total + 1
        first[c], room = open_block, room - n
    return first, many, total


def pivots_of(sample: list[list[float]]) -> np.ndarray:
    """The sample's directions, each once, without those whose length no double holds."""
    v = np.unique(np.array(sample) + 0.0, axis=0)
    with np.errstate(all="ignore"):
        v = v / np.sqrt((v * v).sum(1))[:, None]
        v = v[np.abs((v * v).sum(1) - 1) < 1e-9]
    return v if len(v) else np.eye(1, v.shape[1])


class Block:
    """A block's rows, in the order of their cells."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, x: np.ndarray, pivots: np.ndarray, basis: np.ndarray):
        self.ids, self.cells, self.x = ids, cells, x
        self.names, self.starts = np.unique(cells, return_index=True)
        self.own = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, pivots[cells]), 0))[:, None]
        self.radius = np.fmax.reduceat(self.own[:, 0], self.starts)
        # a few dimensions and the length of the others: their product is never below the cosine
        part = x @ basis
        self.rough = np.column_stack([part, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", part, part), 0))]).astype(np.float32)
        self.gone = np.zeros(len(ids), bool)


def mark_near(a: Block, b: Block, pivots: np.ndarray, threshold: float, block: int) -> None:
    """Marks who goes, of the members of a's cells and of the rows of b that visit them."""
    r = math.sqrt(max(2 - 2 * threshold, 0.0))
    ends, step = np.append(a.starts[1:], len(a.ids)), max(1, MATRIX_CELLS // max(1, len(b.ids)))
    between = np.sqrt(np.maximum(2 - 2 * pivots[b.names] @ pivots[a.names].T, 0))
    between[b.names[:, None] == a.names[None, :]] = 0
    home = np.searchsorted(b.names, b.cells)
    for at in range(0, len(a.names), step):
        names = a.names[at:at + step]
        d = np.sqrt(np.maximum(2 - 2 * b.x @ pivots[names].T, 0))
        touched = _touched(d, b.own, between[home, at:at + step], a.radius[at:at + step], r)
        for k in range(len(names)):
            guests = np.flatnonzero(touched[:, k])
            for g in range(0, len(guests), block):
                some = guests[g:g + block]
                rough = b.rough[some].T
                for m in range(a.starts[at + k], ends[at + k], 256):
                    s = a.rough[m:min(m + 256, ends[at + k])] @ rough
                    rows = np.flatnonzero(s.max(1) > threshold - 1e-5)
                    if len(rows):
                        p, q = m + rows, some[(s[rows] > threshold - 1e-5).any(0)]
                        near, mine, other = a.x[p] @ b.x[q].T > threshold, a.ids[p][:, None], b.ids[q][None, :]
                        b.gone[q[(near & (mine < other)).any(0)]] = True
                        a.gone[p[(near & (other < mine)).any(1)]] = True


def drop_near_copies(df: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = 512, max_pivots: int = 1024,
                     block: int = 2048, held: int | None = None) -> DataFrame:
    """Ids of the vectors that have no vector of a smaller id with a cosine above
    ``threshold``, even if that one goes too.

    Null, empty and zero vectors, and those with null or non-finite components, are near
    nothing and stay; vectors of different length are not compared. Of equal vectors
    the first is compared. At most ``max_pivots`` sampled pivots are held on the driver;
    a block has ``held`` rows, of which ``block`` are compared with members at a time.
    ``df`` is not kept: it is read for counts, for pivots, for the cells' sizes, to deal its
    rows to blocks and for the rows that are near nothing.
    """
    share_package(df.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    good = rows.where("fine and id is not null").select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dims"))
    rest = rows.where("not fine or id is null").select("id")
    kept, gone = [], []
    for dims, n in sorted(tuple(r) for r in good.groupBy("dims").count().collect()):
        mine = good.where(F.col("dims") == dims).select("id", "v")
        sample = mine.orderBy(F.xxhash64("id")).limit(min(max_pivots, -(-n // cell_rows))).collect()
        ids, near = _near(mine, dims, pivots_of([s.v for s in sample]), threshold, block, held or max(1, min(HELD_COMPONENTS // dims, max(block, -(-n // BLOCKS)))))
        kept.append(ids)
        gone.append(near)
    if not kept:
        return rest.withColumnRenamed("id", id_col)
    all_of = lambda parts: reduce(DataFrame.unionByName, parts)
    # equal rows can lie in two blocks if two pivots are as near as rounding tells
    stay = all_of(kept).join(all_of(gone).distinct(), "id", "left_anti").dropDuplicates(["id", "mixed"])
    return stay.select(F.col("id").cast(rest.schema["id"].dataType)).unionByName(rest).withColumnRenamed("id", id_col)


def _near(mine: DataFrame, dims: int, pivots: np.ndarray, threshold: float, block: int, held: int) -> tuple[DataFrame, DataFrame]:
    """(id, mixed) of the first of equal vectors, and ids that go."""

    def home(batches):
        for b in pieces(batches, len(pivots)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique((_unit(b.column("v"), dims) @ pivots.T).argmax(1), return_counts=True)], ["cell", "n"])

    members = np.zeros(len(pivots), np.int64)
    for c, n in mine.select("v").mapInArrow(home, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        members[c] = n
    first, many, total = fill_blocks(members, held)
    basis = np.linalg.svd(pivots, full_matrices=False)[2][:ROUGH].T

    def deal(batches):
        for whole in pieces(batches, MATRIX_CELLS * dims // OUT_COMPONENTS):
            v = np.asarray(whole.column("v").flatten()).reshape(whole.num_rows, dims) + 0.0
            one = first_of_equals(whole.column("id").to_numpy(), v)
            for b in pieces([whole.take(pa.array(one))], len(pivots)):
                cell = (_unit(b.column("v"), dims) @ pivots.T).argmax(1)
                mixed = b.column("mixed").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array((first[cell] + mixed % many[cell]).astype(np.int32)), pa.array(cell.astype(np.int32)), b.column("id"), b.column("mixed"), b.column("v")],
                                                 ["block", "cell", "id", "mixed", "v"])

    def pack(batches):
        t = pa.Table.from_batches(batches).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        ids, cells, mixed = (t.column(c).to_numpy() for c in ("id", "cell", "mixed"))
        one = first_of_equals(ids, np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(ids), dims) + 0.0)
        one = one[np.argsort(cells[one], kind="stable")]
        x = _unit(t.column("v").combine_chunks(), dims)[one]
        yield pa.RecordBatch.from_arrays([t.column("block").chunk(0)[:1], *(pa.array([c.tobytes()], pa.binary()) for c in (ids[one], mixed[one], cells[one], x))], ["block", "ids", "mixed", "cells", "x"])

    dealt = mine.withColumn("mixed", F.xxhash64("v")).mapInArrow(deal, "block int, cell int, id long, mixed long, v array<double>")
    packed = cut_lineage(dealt.repartitionById(total, "block").mapInArrow(pack, "block int, ids binary, mixed binary, cells binary, x binary"))

    def unpack(batches):
        for b in batches:
            for ids, mixed in zip(b.column("ids"), b.column("mixed"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c.as_buffer(), np.int64)) for c in (ids, mixed)], ["id", "mixed"])

    def compare(batches):
        def of(b, i, side):
            ids, cells, x = (np.frombuffer(b.column(side + c)[i].as_buffer(), kind) for c, kind in (("ids", np.int64), ("cells", np.int32), ("x", np.float64)))
            return Block(ids, cells, x.reshape(len(ids), dims), pivots, basis)

        for b in batches:
            for i in range(b.num_rows):
                x = of(b, i, "a_")
                y = x if b.column("a_block")[i] == b.column("b_block")[i] else of(b, i, "b_")
                mark_near(x, y, pivots, threshold, block)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([z.ids[z.gone] for z in ({x, y})]))], ["id"])

    side = lambda s: packed.select(*[F.col(c).alias(s + c) for c in ("block", "ids", "cells", "x")])
    # each task reads one block of either side from the checkpoint; nothing is shuffled
    pairs = side("a_").hint("shuffle_replicate_nl").join(side("b_"), F.col("a_block") <= F.col("b_block"))
    return packed.select("ids", "mixed").mapInArrow(unpack, "id long, mixed long"), pairs.mapInArrow(compare, "id long")
