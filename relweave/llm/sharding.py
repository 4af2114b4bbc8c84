"""Sharding by sampled splitters.

Records are ordered by a key (hash of the text, id, row number). A sample whose
inclusion probability grows with the record's size gives weighted quantiles of
that order; they cut the records into key ranges. The exact bytes of every
range are then counted, and a range that is overfull is cut again from a fresh
sample of its own records. Ranges are laid end to end, so a record's byte offset
is its range's offset plus the running size inside the range, and shard *i*
takes the *i*-th equal part of all bytes.

Copies of a text lie next to each other in the key order, so a group of equal
texts is cut only where a shard boundary falls into it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.session import cut_lineage

KEY = ["h", "id", "rn"]


def _ranks(cuts: np.ndarray, h, i, r) -> np.ndarray:
    """For every key the number of cuts at or below it. ``cuts``: sorted rows (h, id, rn)."""
    m, n = len(cuts), len(h)
    keys = [np.concatenate([cuts[:, k], v]) for k, v in enumerate((h, i, r))]
    order = np.lexsort((np.arange(m + n) >= m, keys[2], keys[1], keys[0]))
    is_cut = order < m
    out = np.empty(m + n, np.int64)
    out[order] = np.cumsum(is_cut)
    return out[m:]


def _with_range(df: DataFrame, cuts: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def rank(h: pd.Series, i: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(_ranks(cuts, h.to_numpy(), i.to_numpy(), r.to_numpy()).astype(np.int32))

    return df.withColumn("rng", rank("h", "id", "rn"))


def _quantile_cuts(sample: pd.DataFrame, total: float, parts: int) -> np.ndarray:
    """Keys at the weighted quantiles 1/parts, 2/parts, ..."""
    s = sample.sort_values(KEY)
    done = np.cumsum(s["w"].to_numpy())
    at = np.searchsorted(done, done[-1] * np.arange(1, parts) / parts) if len(s) else []
    return np.unique(s[KEY].to_numpy(np.int64)[np.minimum(at, len(s) - 1)], axis=0) if len(s) else np.empty((0, 3), np.int64)


def _sample(df: DataFrame, total: int, draws: int, seed: int) -> pd.DataFrame:
    """Size-weighted sample: a record enters with probability min(1, draws*size/total)
    and carries the weight size/probability. About ``draws`` rows reach the driver."""
    u = F.pmod(F.xxhash64("h", "id", "rn", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    step = total / draws
    return (df.where(u < F.col("size") / F.lit(step))
              .select(*KEY, F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w")).toPandas())


def shard_by_bytes(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 16, ranges_per_shard: int = 8, rows_per_range: int = 500_000,
                   draws_per_range: int = 32, carry: bool = False) -> DataFrame:
    """Shards of near equal bytes: (doc_id, size, text_crc32, law, shard, slot,
    grown_shard[, record]). ``carry`` keeps the whole record as a struct.

    A record's size is the UTF-8 bytes of its text plus ``overhead``. Each shard
    takes the records whose middle byte lies in its part, so a shard's bytes
    differ from total/n by at most the largest record. Slots number a shard's
    records from 0 in key order. The driver sees only ``draws_per_range`` sampled
    keys and one count per range; the number of ranges is ``n_shards *
    ranges_per_shard``, or one per ``rows_per_range`` rows if that is more.

    A null text counts as empty. Null ids sort first. Repeated rows are separate
    records. An empty table gives no rows; with fewer records than shards some
    shards stay empty. Extra columns are ignored (or carried inside ``record``).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("long")
    keyed = df.select(doc.alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
                      F.coalesce(doc, F.lit(-(1 << 63))).alias("id"),
                      *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")] if carry else []))
    # The row number makes every key distinct, so any range can be subdivided;
    # it must not change when a task is run again, hence the checkpoint.
    keyed = cut_lineage(keyed.withColumn("rn", F.monotonically_increasing_id()))
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total = int(total)
    n_ranges = max(n_shards * ranges_per_shard, -(-rows // rows_per_range))

    cuts = np.empty((0, 3), np.int64)
    if rows:
        cuts = _quantile_cuts(_sample(keyed, total, n_ranges * draws_per_range, 1), total, n_ranges)
    most = 2 * max(1, total // n_ranges)
    seed = 1
    while True:
        ranged = _with_range(keyed, cuts)
        stats = (ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                                           F.max(F.struct(*KEY)).alias("last"))
                 .select("rng", "bytes", "n", *[F.col(f"last.{k}") for k in KEY]).toPandas().sort_values("rng"))
        over = stats[((stats["bytes"] > most) | (stats["n"] > 2 * rows_per_range)) & (stats["n"] > 1)]
        if over.empty:
            break
        seed += 1
        parts = {int(r.rng): int(max(2, -(-r.bytes // most) * 2, -(-r.n // rows_per_range))) for r in over.itertuples()}
        inside = ranged.where(F.col("rng").isin(list(parts)))
        picked = _sample(inside, int(over["bytes"].sum()), draws_per_range * sum(parts.values()), seed)
        rng = _ranks(cuts, *(picked[k].to_numpy(np.int64) for k in KEY)) if len(picked) else np.empty(0, np.int64)
        new = [_quantile_cuts(picked[rng == k], 0, p) for k, p in parts.items()]
        # The last key of an overfull range always cuts off at least one record.
        new.append(over[KEY].to_numpy(np.int64))
        grown = np.unique(np.concatenate([cuts, *new]), axis=0)
        if len(grown) == len(cuts):  # single records larger than a range
            break
        cuts = grown

    before = stats.assign(bytes_before=stats["bytes"].cumsum() - stats["bytes"], rows_before=stats["n"].cumsum() - stats["n"])
    offsets = keyed.sparkSession.createDataFrame(
        [(int(r.rng), int(r.bytes_before), int(r.rows_before)) for r in before.itertuples()],
        "rng int, bytes_before long, rows_before long")
    w = Window.partitionBy("rng").orderBy(*KEY)
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("bytes_before")
    # one row per range, at most a few thousand: a broadcast of known size
    placed = (ranged.join(F.broadcast(offsets), "rng")
              .withColumn("middle", 2 * end - F.col("size"))
              .withColumn("at", F.row_number().over(w) - 1 + F.col("rows_before"))
              .withColumn("shard", F.least(F.lit(n_shards - 1),
                                           F.expr(f"middle * {n_shards} div {2 * max(total, 1)}")).cast("int")))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("at") - F.col("first")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), *(["record"] if carry else [])))


def write_shards(df: DataFrame, path: str, n_shards: int = 40, **kw) -> None:
    """Writes the records themselves, one folder per shard, in slot order."""
    out = shard_by_bytes(df, n_shards, carry=True, **kw).select("shard", "slot", "record.*")
    out.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
