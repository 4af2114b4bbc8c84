"""Which of many passages occur in which texts.

Passages come in blocks of bounded size. A block is handed to every task, which
builds one automaton of it and runs each text through it once, so texts stay
where they are and only hits move.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.operators.joins import union_results
from relweave.session import share_package

#: Characters of the passages that are looked up in one pass over the texts.
BLOCK_CHARS = 4 << 20


def automaton(passages: list[str]) -> ahocorasick.Automaton:
    """Finds positions in ``passages``, which are different and not empty."""
    out = ahocorasick.Automaton()
    for i, p in enumerate(passages):
        out.add_word(p, i)
    out.make_automaton()
    return out


def _blocks(patterns: DataFrame, most: int) -> Iterator[list[str]]:
    block, size = [], 0
    for r in patterns.toLocalIterator():
        if block and size + len(r.p) > most:
            yield block
            block, size = [], 0
        block.append(r.p)
        size += len(r.p)
    if block:
        yield block


def contained(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage_id: str, passage: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(text_id, passage_id): each passage that occurs in a text, once, compared in
    lower case. An empty passage occurs in every text that isn't null; null texts and passages in none.

    Different passages are looked up in blocks of at most ``block_chars`` characters (one longer
    passage is a block), one pass over the texts for each.
    """
    spark = share_package(texts.sparkSession)
    t = texts.select(F.col(text_id).alias("t"), F.lower(text).alias("lt")).where(F.col("lt").isNotNull())
    p = passages.select(F.col(passage_id).alias("i"), F.lower(passage).alias("p")).where(F.col("p").isNotNull())
    kind = t.schema["t"].dataType.simpleString()
    hits = [t.crossJoin(p.where("p = ''").select("p").limit(1)).select("t", "p")]
    for block in _blocks(p.where("p <> ''").select("p").distinct(), block_chars):
        shared = spark.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            words = shared.value
            search = automaton(words)
            for b in batches:
                ids, found = [], []
                for k, s in enumerate(b.column("lt")):
                    seen = {w for _, w in search.iter(s.as_py())}
                    ids += [k] * len(seen)
                    found += [words[w] for w in seen]
                yield pa.RecordBatch.from_arrays([b.column("t").take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], ["t", "p"])

        hits.append(t.mapInArrow(find, f"t {kind}, p string"))
    # equal passages share their hits; a repeated text id counts once
    return (union_results(hits).join(p, "p").select(F.col("t").alias(text_id), F.col("i").alias(passage_id)).distinct())
