"""Token counts without token ids.

Each task splits its documents into pre-tokens and keeps, for a block of
documents, the block's different pre-tokens and each document's frequencies of
them; pre-tokens that are one piece of the vocabulary are counted at once. The
other different pre-tokens go to the task that owns their hash, where the
pieces of each are counted once; the piece counts return to the blocks that
hold the pre-token, are joined to the documents' frequencies and summed.
A frequent pre-token is one row per block, so it makes no hot task.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.bpe import byte_chars
from relweave.llm.common import pick, shuffle_partitions, slices

_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


class PieceCounter:
    """Splits texts and counts pieces as the tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = set(added)
        self.splitter = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        # fixed value: the file's own pattern of pre-tokens
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # the same pre-tokens for lower-cased texts of ASCII and Latin letters
        latin = "a-zA-ZÀ-ÖØ-öø-ɏ"
        self.latin = re.compile(rf"[{latin}]++|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{latin}0-9]++")
        self.not_latin = re.compile(rf"[^\t\n\x0b\x0c\r -~{latin}]")
        self.chars = byte_chars()
        # words that are one piece of the vocabulary (a table of the vocabulary's size)
        back = {c: b for b, c in self.chars.items()}
        ends = [w[:-4] for w in self.tok.get_vocab(False) if w.endswith("</w>") and w not in self.special]
        self.single = {w for w in (bytes(back[c] for c in x).decode("utf-8", "replace") for x in ends) if self.pieces(w) == 1}

    def _find(self, text: str) -> list[str]:
        if not self.not_latin.search(text):
            low = text.lower()
            if "i̇" not in low:
                return self.latin.findall(low)
        if _BEYOND_LATIN.search(text):  # rarer scripts: the library's own lower-casing
            return self.pattern.findall(self.tok.normalizer.normalize_str(text))
        return self.pattern.findall(unicodedata.normalize("NFC", text).lower())

    def split(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self._find(text)
        out: list[str] = []
        for i, part in enumerate(self.splitter.split(text)):
            out += [part] if i % 2 else self._find(part)
        return out

    def pieces(self, word: str) -> int:
        if word in self.special:
            return 1
        return len(self.tok.model.tokenize("".join(map(self.chars.__getitem__, word.encode("utf-8")))))


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


_ROW = "block long, code int, word string, data binary"
_NAMES = ["block", "code", "word", "data"]
_HEAD = struct.Struct("<qqq?H")  # id, bytes, tokens of single pieces, whether the id is null, parts


def pack(doc: int | None, n_bytes: int, base: int, codes: np.ndarray) -> bytes:
    """A document's code frequencies: codes cut into 16-bit parts and their sorted low
    halves, frequencies as bytes (a larger one repeats its code)."""
    kinds, freq = np.unique(codes, return_counts=True)
    if len(freq) and freq.max() > 255:
        n = -(-freq // 255)
        last = np.cumsum(n) - 1
        rest = freq - 255 * (n - 1)
        kinds = np.repeat(kinds, n)
        freq = np.full(len(kinds), 255)
        freq[last] = rest
    parts = np.bincount(kinds >> 16).astype("<u4") if len(kinds) else np.empty(0, "<u4")
    return b"".join([_HEAD.pack(doc or 0, n_bytes, base, doc is None, len(parts)), parts.tobytes(), (kinds & 0xFFFF).astype("<u2").tobytes(), freq.astype("u1").tobytes()])


def unpack(data: bytes) -> tuple[int | None, int, int, np.ndarray, np.ndarray]:
    """(doc, bytes, base, codes, frequencies)."""
    doc, n_bytes, base, null, n = _HEAD.unpack_from(data)
    at = _HEAD.size
    parts = np.frombuffer(data, "<u4", n, at)
    total = int(parts.sum())
    at += 4 * n
    codes = np.frombuffer(data, "<u2", total, at).astype(np.int64) | np.repeat(np.arange(n) << 16, parts)
    return None if null else doc, n_bytes, base, codes, np.frombuffer(data, "u1", total, at + 2 * total)


def _frequencies(path: str, block_bytes: int):
    """Tasks' rows: per block its different pre-tokens of more than one piece, and
    per document its frequencies of them."""
    def run(batches):
        c = counter(path)
        single = c.single
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        seen: dict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        block, size = part, 0

        def words():
            ws = list(seen)
            for i in range(0, len(ws), 50_000):
                w = ws[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(w), block)), pa.array(np.arange(i, i + len(w), dtype=np.int32)), pa.array(w, pa.string()), pa.nulls(len(w), pa.binary())], _NAMES)

        for b in slices(batches):
            rows = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = t or ""
                ws = c.split(t)
                codes = np.array([seen[w] for w in ws if w not in single], np.int64)
                n = len(t) if t.isascii() else len(t.encode("utf-8"))
                size += n
                rows.append(pack(doc, n, len(ws) - len(codes), codes))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.string()), pa.array(rows, pa.binary())], _NAMES)
            if size >= block_bytes:
                yield from words()
                seen.clear()
                block, size = block + 1, 0
        yield from words()

    return run


def _count_pieces(path: str, flush: int = 1_000_000):
    """Sorted by pre-token: pieces of each counted once, sent to every block that
    holds it as (code, pieces) pairs packed by block. Document rows pass through."""
    def run(batches):
        c = counter(path)
        last, pieces = None, 0
        held: dict[int, tuple[list, list]] = {}
        n_held = 0

        def packed():
            ks = list(held)
            data = [np.array(held[k], np.int32).tobytes() for k in ks]
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(np.full(len(ks), -1, np.int32)), pa.nulls(len(ks), pa.string()), pa.array(data, pa.binary())], _NAMES)

        for b in batches:
            docs = b.column("word").is_null()
            if docs.true_count:
                yield b.filter(docs)
            if docs.true_count == b.num_rows:
                continue
            mine = b.filter(pc.invert(docs))
            for w, block, code in zip(mine.column("word").to_pylist(), mine.column("block").to_pylist(), mine.column("code").to_pylist()):
                if w != last:
                    last, pieces = w, c.pieces(w)
                codes, ps = held.setdefault(block, ([], []))
                codes.append(code)
                ps.append(pieces)
            n_held += mine.num_rows
            if n_held > flush:
                yield packed()
                held, n_held = {}, 0
        if held:
            yield packed()

    return run


def _sum_documents(batches):
    """Sorted by block, piece counts (code -1) before documents (code null, last):
    sums frequency times pieces."""
    block, parts, pieces = None, [], None
    for b in batches:
        out = []
        for k, code, data in zip(*(b.column(c).to_pylist() for c in ("block", "code", "data"))):
            if k != block:
                block, parts, pieces = k, [], None
            if code is not None:
                parts.append(np.frombuffer(data, np.int32).reshape(2, -1))
                continue
            if pieces is None:
                both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int32)
                pieces = np.zeros(int(both[0].max()) + 1 if both.shape[1] else 0, np.int64)
                pieces[both[0]] = both[1]
                parts = []
            doc, n_bytes, base, codes, freq = unpack(data)
            out.append((doc, n_bytes, base + int((pieces[codes] * freq).sum())))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 block_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, over the whole text.

    ``block_bytes`` of text make a block; a block's different pre-tokens are what
    a task holds in memory. Null texts count as empty and have no tokens; special
    tokens written inside a text count as one each. Repeated rows are counted one
    by one; an empty table gives no rows; extra columns are ignored.
    """
    n = shuffle_partitions(df.sparkSession)
    rows = pick(df, id_col, text_col).mapInArrow(_frequencies(path, block_bytes), _ROW)
    to = F.coalesce("word", F.col("block").cast("string"))
    back = rows.repartition(n, to).sortWithinPartitions("word").mapInArrow(_count_pieces(path), _ROW)
    sums = back.repartition(n, "block").sortWithinPartitions("block", F.col("code").asc_nulls_last()).mapInArrow(_sum_documents, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
