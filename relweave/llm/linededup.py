"""Line dedup with sharded cuckoo filters over exact reference tables.

A line's key is a 128-bit digest. The exact tables say which documents hold a key
(``holds``) and how many, the smallest and the largest (``refs``). Keys are dealt to
shards by their leading bits. Each shard has two cuckoo filters: ``held`` over all its
keys and ``shared`` over those of more than one document. A filter has no false
negatives: a key that ``held`` doesn't show is new, and a line whose key ``shared``
doesn't show stays, both without a look into the exact tables; what a filter shows
is confirmed there.

Documents can be added (:meth:`LineIndex.insert`) and taken away again
(:meth:`LineIndex.delete`): a key leaves ``shared`` with its last but one holder and
``held`` with its last. The lines to drop always follow from the documents now in
the tables. The number of shards follows from the number of keys, so a shard, its
filters and the task that works on them stay the same size whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import pick, slices
from relweave.llm.cuckoo import CuckooFilter
from relweave.session import cut_lineage

_SPACE = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1  # stands for a null id: sorts after every other
_REFS = "k1 long, k2 long, refs long, owner long, last long"
_FILTERS = "shard int, n long, held binary, shared binary"


def line_key(line: str, least: int = 10) -> bytes | None:
    """Digest of the line without ASCII white space at its ends and with A-Z
    lower-cased; None for keys shorter than ``least`` code points."""
    s = line.strip(_SPACE)
    return xxhash.xxh3_128_digest(s.encode("utf-8").lower()) if len(s) >= least else None


def _as_longs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return a[:, 0].copy(), a[:, 1].copy()


def _shard(bits: int) -> Column:
    """The shard of column ``k1``: its leading ``bits`` bits."""
    return F.shiftrightunsigned("k1", 64 - bits).cast("int") if bits else F.lit(0)


def line_holds(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc, k1, k2): each row's distinct line keys."""
    def run(batches):
        for b in slices(batches):
            ids, keys = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                mine = {line_key(x, least) for x in (t or "").split("\n")}
                mine.discard(None)
                keys += mine
                ids += [_LAST if d is None else d] * len(mine)
            if keys:
                k1, k2 = _as_longs(keys)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k1), pa.array(k2)], ["doc", "k1", "k2"])

    return docs.mapInArrow(run, "doc long, k1 long, k2 long")


def reference_counts(holds: DataFrame) -> DataFrame:
    """(k1, k2, refs, owner, last): the exact table, grouped with a map-side
    combine, so a line in a third of all documents is one row per task."""
    return holds.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last"))


def build_filters(refs: DataFrame, bits: int) -> DataFrame:
    """(shard, n, held, shared): the filters of 2**bits shards over an exact table."""
    def run(key, mine):
        k, again = mine["k1"].to_numpy(), mine["again"].to_numpy()
        return pd.DataFrame({"shard": [key[0]], "n": [len(k)], "held": [CuckooFilter.of(k).dump()], "shared": [CuckooFilter.of(k[again]).dump()]})

    keys = refs.select(_shard(bits).alias("shard"), "k1", (F.col("owner") < F.col("last")).alias("again"))
    return keys.groupBy("shard").applyInPandas(run, _FILTERS)


def _changed(filters: DataFrame, changes: DataFrame, refs: DataFrame, bits: int) -> DataFrame:
    """The filters after ``changes`` (k1, held, shared: 1 for a key to add, -1 for one
    to take out). A filter that gets too full is built again, larger, from ``refs``."""
    def run(key, mine, old):
        k = mine["k1"].to_numpy()
        out = {"shard": [key[0]], "n": [(int(old["n"].iloc[0]) if len(old) else 0) + int(mine["held"].sum())]}
        for c in ("held", "shared"):
            f = CuckooFilter.load(old[c].iloc[0]) if len(old) else CuckooFilter.of(k[:0])
            way = mine[c].to_numpy()
            f.delete(k[way < 0])
            out[c] = [f.dump() if f.insert(k[way > 0]) else None]
        return pd.DataFrame(out)

    dealt = changes.select(_shard(bits).alias("shard"), "k1", "held", "shared")
    done = cut_lineage(dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, _FILTERS))
    fits = F.col("held").isNotNull() & F.col("shared").isNotNull()
    again = refs.withColumn("shard", _shard(bits)).join(done.where(~fits).select("shard"), "shard", "left_semi")
    return cut_lineage(done.where(fits).unionByName(build_filters(again, bits)))


@dataclass
class LineIndex:
    """The lasting state: the exact tables, and the filters of 2**bits shards."""

    holds: DataFrame
    refs: DataFrame
    filters: DataFrame
    keys: int = 0
    bits: int = 0
    least: int = 10
    per_shard: int = 1 << 12

    @classmethod
    def empty(cls, spark, least: int = 10, per_shard: int = 1 << 12) -> LineIndex:
        """An index of no documents; ``per_shard``: keys that a shard holds at most on average."""
        return cls(spark.createDataFrame([], "doc long, k1 long, k2 long"), spark.createDataFrame([], _REFS),
                   spark.createDataFrame([], _FILTERS), least=least, per_shard=per_shard)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Adds documents. A key that its shard's filter doesn't show goes straight
        into the exact table; the others are merged with what is there. Rows that
        repeat an id add one reference each; a deletion takes them all."""
        new = cut_lineage(line_holds(pick(docs, id_col, text_col), self.least))
        batch = cut_lineage(reference_counts(new))
        added = batch.count()
        bits = max(self.bits, int(np.ceil(np.log2(max(1, (self.keys + added) / self.per_shard)))))
        if not self.keys:  # every key is new
            return replace(self, holds=new, refs=batch, filters=cut_lineage(build_filters(batch, bits)), keys=added, bits=bits)
        filters = self.filters if bits == self.bits else cut_lineage(build_filters(self.refs, bits))

        def look(key, mine, old):
            shown = CuckooFilter.load(old["held"].iloc[0]).contains(mine["k1"].to_numpy()) if len(old) else False
            return mine.assign(shown=shown)[["k1", "k2", "refs", "owner", "last", "shown"]]

        seen = cut_lineage(batch.withColumn("shard", _shard(bits)).groupBy("shard").cogroup(filters.groupBy("shard"))
                           .applyInPandas(look, _REFS + ", shown boolean"))
        shown = seen.where("shown").drop("shown")
        fresh = seen.where("NOT shown").drop("shown")
        merged = cut_lineage(
            self.refs.selectExpr("*", "true AS old", "owner < last AS again", "false AS touched")
            .unionByName(shown.selectExpr("*", "false AS old", "false AS again", "true AS touched"))
            .groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.min("owner").alias("owner"), F.max("last").alias("last"),
                                     *[F.max(c).alias(c) for c in ("old", "again", "touched")]))
        changes = (merged.where("touched").selectExpr("k1", "int(NOT old) AS held", "int(owner < last AND NOT again) AS shared")
                   .unionByName(fresh.selectExpr("k1", "1 AS held", "int(owner < last) AS shared")))
        refs = cut_lineage(merged.select(*batch.columns).unionByName(fresh))
        unchanged = filters.join(seen.select(_shard(bits).alias("shard")).distinct(), "shard", "left_anti")
        return replace(self, holds=cut_lineage(self.holds.unionByName(new)), refs=refs, keys=refs.count(), bits=bits,
                       filters=cut_lineage(unchanged.unionByName(_changed(filters.join(unchanged.select("shard"), "shard", "left_anti"), changes, refs, bits))))

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Takes documents away, with their references and, where these end, the marks
        of their keys in the filters."""
        gone = doc_ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc")).distinct()
        touched = cut_lineage(self.holds.join(gone, "doc", "left_semi").select("k1", "k2").distinct())
        left = cut_lineage(self.holds.join(gone, "doc", "left_anti"))
        now = cut_lineage(reference_counts(left.join(touched, ["k1", "k2"], "left_semi")))
        before = self.refs.join(touched, ["k1", "k2"], "left_semi").selectExpr("k1", "k2", "owner < last AS again")
        changes = cut_lineage(before.join(now, ["k1", "k2"], "left").selectExpr(
            "k1", "int(refs IS NULL) * -1 AS held", "int(again AND NOT coalesce(owner < last, false)) * -1 AS shared"))
        refs = cut_lineage(self.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(now))
        apart = changes.select(_shard(self.bits).alias("shard")).distinct()
        filters = (self.filters.join(apart, "shard", "left_anti")
                   .unionByName(_changed(self.filters.join(apart, "shard", "left_semi"), changes, refs, self.bits)))
        return replace(self, holds=left, refs=refs, filters=cut_lineage(filters), keys=refs.count())

    def drops(self, piece_rows: int = 1 << 14) -> DataFrame:
        """(doc, k1, k2): keys that a document loses, because a smaller id holds them.

        Rows of ``holds`` go to their shard, where its filter of shared keys stands; what it
        shows is confirmed in the shard's exact table. A shard of more than ``piece_rows``
        rows (a line that many documents hold) is cut into pieces of about that size, each
        with its copy of the shard's filter and table."""
        shard = _shard(self.bits)
        sizes = (self.refs.groupBy(shard.alias("shard")).agg(F.sum("refs").alias("rows"))
                 .select("shard", F.ceil(F.col("rows") / piece_rows).cast("int").alias("pieces")).where("pieces > 1"))
        sizes = cut_lineage(sizes)
        if sizes.count() <= 200_000:  # 8 bytes a row
            sizes = F.broadcast(sizes)

        def pieces(df: DataFrame) -> DataFrame:
            return df.join(sizes, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))

        rows = (pieces(self.holds.select(shard.alias("shard"), *[F.col(c).alias(c) for c in ("doc", "k1", "k2")]))
                .withColumn("piece", F.pmod(F.xxhash64("doc", F.monotonically_increasing_id()), F.col("pieces")).cast("int")).drop("pieces"))
        table = (self.refs.where("owner < last").select(shard.alias("shard"), "k1", "k2", "owner", F.lit(None).cast("binary").alias("shared"))
                 .unionByName(self.filters.select("shard", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("owner"), "shared")))
        table = pieces(table).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

        def run(mine, state):
            marks = state["shared"].notna()
            exact = state.loc[~marks, ["k1", "k2", "owner"]]
            if not len(mine) or not len(exact):
                return mine[["doc", "k1", "k2"]].iloc[:0]
            shown = mine[CuckooFilter.load(state.loc[marks, "shared"].iloc[0]).contains(mine["k1"].to_numpy())]
            both = shown.merge(exact, on=["k1", "k2"])
            return both.loc[both["doc"] > both["owner"], ["doc", "k1", "k2"]]

        return rows.groupBy("shard", "piece").cogroup(table.groupBy("shard", "piece")).applyInPandas(run, "doc long, k1 long, k2 long")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, per_shard: int = 1 << 12,
                piece_rows: int = 1 << 14, index: LineIndex | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each document's text without the lines
    whose key (of at least ``least`` code points) a smaller doc_id holds too.

    The documents are inserted into an empty :class:`LineIndex`, and its drops are
    applied; with ``index`` the decisions come from that state instead. Inside the
    document that keeps a key all its lines stay. Null and empty texts are one empty
    line. A null id sorts after all others. Rows that repeat an id count as one
    document for a key, and each is rewritten. An empty table gives no rows; extra
    columns are ignored.
    """
    docs = pick(df, id_col, text_col)
    return _rewritten(docs, _gone(docs, least, per_shard, piece_rows, index), least)


def dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, per_shard: int = 1 << 12,
               piece_rows: int = 1 << 14) -> DataFrame:
    """The rows with all their columns and ``text_col`` rewritten as in
    :func:`dedup_lines`; rows that lost all their lines go."""
    gone = _gone(pick(df, id_col, text_col), least, per_shard, piece_rows, None)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _rewritten(packed, gone, least).where("n_dropped < n_lines")
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"record.`{c}`") for c in df.columns])


def _gone(docs: DataFrame, least: int, per_shard: int, piece_rows: int, index: LineIndex | None) -> DataFrame:
    if index is None:
        index = LineIndex.empty(docs.sparkSession, least, per_shard).insert(docs)
    drops = index.drops(piece_rows)
    # bounded by one document's own lines
    return drops.groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("gone"))


def _rewritten(docs: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_dropped and kept in place of text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    joined = (docs.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
              .join(gone, "doc", "left").select(*others, "doc_id", "text", "gone.k1", "gone.k2"))

    def run(batches):
        for b in slices(batches):
            lines, dropped, kept = [], [], []
            for t, k1, k2 in zip(b.column("text").to_pylist(), b.column("k1").to_pylist(), b.column("k2").to_pylist()):
                ls = (t or "").split("\n")
                out = ls
                if k1:
                    a = np.array([k1, k2], np.int64).T.tobytes()
                    drop = {a[i:i + 16] for i in range(0, len(a), 16)}
                    out = [x for x in ls if line_key(x, least) not in drop]
                lines.append(len(ls))
                dropped.append(len(ls) - len(out))
                kept.append("\n".join(out))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], b.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                             [*others, "doc_id", "n_lines", "n_dropped", "kept"])

    schema = T.StructType([docs.schema[c] for c in others]).add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return joined.mapInArrow(run, schema)
