"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

Pre-tokens are counted over the whole corpus; the frequent ones, with the ids
that the merges give them, are compiled into a minimal acyclic automaton whose
states share suffixes. Each arc carries the number of words that come before it
from its state, so the arc numbers along a word add up to the word's rank, which
indexes the id outputs. The compiled arrays are one file that Spark hands to the
executors, and tasks memory-map it. A task looks all different pre-tokens of a
slice up at once, byte by byte with array operations; those that the lexicon
lacks are merged exactly.
"""

from __future__ import annotations

import itertools
import json
import math
import mmap
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import pick, publish, ragged, slices
from relweave.session import cut_lineage


#: Fixed value: the byte-level pattern of pre-tokens.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pre-tokens for texts of ASCII and Latin letters only, in plain classes.
#: Text bytes encoded at a time, and words that a task counts or keeps ids of: its memory.
SLICE, KEPT_WORDS = 1 << 20, 100_000
_LATIN = "a-zA-ZÀ-ÖØ-öø-ɏ"
_LATIN_LEVEL = re.compile(rf" ?[{_LATIN}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{_LATIN}0-9]++|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile(rf"[^\t\n\x0b\x0c\r -~{_LATIN}]")


def byte_chars() -> dict[int, str]:
    """The fixed map of byte-level vocabularies from bytes to printable characters:
    printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """A byte-level BPE read from a tokenizer file."""

    pattern: object
    specials: dict[str, int]
    splitter: object
    ids: dict[bytes, int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    pieces: list[bytes]

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        ranks = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            ranks[ids[a], ids[b]] = (rank, ids[a + b])
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (1 + max([*ids.values(), *specials.values()]))
        for k, v in ids.items():
            pieces[v] = k
        for k, v in specials.items():
            pieces[v] = k.encode()
        by_length = sorted(specials, key=len, reverse=True)
        splitter = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if specials else None
        return cls(regex.compile(pattern), specials, splitter, ids, ranks, pieces).tables()

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens inside the text are pre-tokens of their own."""
        find = self.pattern.findall
        if self.pattern.pattern == BYTE_LEVEL and not _NOT_LATIN.search(text):
            find = _LATIN_LEVEL.findall
        if self.splitter is None or not any(s in text for s in self.specials):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(self.splitter.split(text)):
            out += [part] if i % 2 else find(part)
        return out

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token: the pair of lowest rank is merged, leftmost
        first, until no pair has a rank."""
        if word in self.specials:
            return (self.specials[word],)
        data = word.encode("utf-8")
        whole = [self.ids[data[i:i + 1]] for i in range(len(data))]
        if len(whole) > 64:
            return tuple(_merge_long(whole, self.ranks))
        ranks = self.ranks
        while len(whole) > 1:
            found = [ranks[p] for p in zip(whole, whole[1:]) if p in ranks]
            if not found:
                break
            best, new = min(found)
            out, i, n = [], 0, len(whole)
            while i < n:
                if i + 1 < n and (r := ranks.get((whole[i], whole[i + 1]))) is not None and r[0] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(whole[i])
                    i += 1
            whole = out
        return tuple(whole)


    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of many pre-tokens, none of them special: words of one length
        are rows of a matrix, and every step merges each row's best pair."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if n > 64:
                for i in at.tolist():
                    out[i] = _merge_long(self.first[np.frombuffer(words[i], np.uint8)].tolist(), self.ranks)
                continue
            ids = self.first[np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, n)]
            length, pair = np.full(len(at), n), self._pair(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(at)) if n > 1 else np.empty(0, np.int64)
            while len(live):
                rank = self.pair_rank[pair[live]]
                best = rank.argmin(1)
                hit = rank[np.arange(len(live)), best] < _NEVER
                live, best = live[hit], best[hit]
                if not len(live):
                    break
                row, k = np.arange(len(live)), np.arange(n)
                moved = ids[live[:, None], np.minimum(k + (k > best[:, None]), n - 1)]
                moved[row, best] = self.pair_id[pair[live, best]]
                length[live] -= 1
                moved[k >= length[live][:, None]] = -1
                ids[live] = moved
                k = np.arange(n - 1)
                pairs = pair[live[:, None], np.minimum(k + (k > best[:, None]), n - 2)]
                pairs[k >= length[live][:, None] - 1] = len(self.pair_id)
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < length[live] - 1)
                pairs[left, best[left] - 1] = self._pair(moved[left, best[left] - 1], moved[left, best[left]])
                pairs[right, best[right]] = self._pair(moved[right, best[right]], moved[right, best[right] + 1])
                pair[live] = pairs
            for i, x, m in zip(at.tolist(), ids.tolist(), length.tolist()):
                out[i] = x[:m]
        return (np.fromiter(itertools.chain.from_iterable(out), np.int64), np.cumsum(np.fromiter(map(len, out), np.int64, len(out))))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of pairs in the merge table; one past its end if there is no merge."""
        key = a * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, at, len(self.pair_keys))

    def tables(self) -> Vocabulary:
        """Fills the sorted merge table."""
        n = len(self.pieces)
        rows = sorted((a * n + b, rank, new) for (a, b), (rank, new) in self.ranks.items())
        self.pair_keys = np.array([r[0] for r in rows], np.int64)
        self.pair_rank = np.array([r[1] for r in rows] + [_NEVER], np.int64)
        self.pair_id = np.array([r[2] for r in rows], np.int64)
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        return self


_NEVER = 1 << 40


def _merge_long(ids: list[int], ranks: dict) -> list[int]:
    """The same merges with a heap over a linked list, for very long pre-tokens."""
    import heapq

    n = len(ids)
    ids, nxt, prev, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i], alive[j], nxt[i] = ranks[pair][1], False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            if (p := (ids[i], ids[nxt[i]])) in ranks:
                heapq.heappush(heap, (ranks[p][0], i, p))
        if prev[i] >= 0 and (p := (ids[prev[i]], ids[i])) in ranks:
            heapq.heappush(heap, (ranks[p][0], prev[i], p))
    return [x for x, a in zip(ids, alive) if a]


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary.load(path, pattern)


# ---------------------------------------------------------------- transducer

def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal acyclic automaton of the words with ranked id outputs, as one
    block of bytes. Words are added in sorted order; when the next word leaves a
    branch, the branch's states are replaced by equal ones seen before."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, dict[int, int]]] = []  # final, byte -> state
    path: list[list] = [[False, {}]]  # open states of the last word
    last = b""

    def close(to: int) -> None:
        for depth in range(len(path) - 1, to, -1):
            final, arcs = path.pop()
            key = (final, tuple(arcs.items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append((final, arcs))
            path[-1][1][last[depth - 1]] = state

    ordered = sorted(words)
    for w in ordered:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        for _ in w[common:]:
            path.append([False, {}])
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], path[0][1]))
    below = [0] * len(states)  # words from each state; arcs lead to earlier states
    keys, targets, skips = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, to in sorted(arcs.items()):
            keys.append(s << 8 | byte)
            targets.append(to)
            skips.append(n)
            n += below[to]
        below[s] = n
    outputs = [words[w] for w in ordered]
    ends = np.cumsum([0, *map(len, outputs)]).astype(np.int64)
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64),
              np.array([f for f, _ in states], np.int64), ends, np.array([i for o in outputs for i in o], np.int64)]
    head = np.array([len(a) for a in arrays], np.int64)
    return b"".join(a.tobytes() for a in [head, *arrays])


class Lexicon:
    """A compiled lexicon over a buffer, such as a memory map."""

    def __init__(self, data):
        a = np.frombuffer(data, np.int64)
        parts, at = [], 6
        for n in a[:6].tolist():
            parts.append(a[at:at + n])
            at += n
        self.keys, self.targets, self.skips, self.final, self.ends, self.ids = parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 for words that aren't in the lexicon."""
        n = len(words)
        rank = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return rank
        size = np.fromiter(map(len, words), np.int64, n)
        at = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.flatnonzero(size)
        state, total = np.full(len(live), len(self.final) - 1), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[at[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, total = self.targets[arc], total[ok] + self.skips[arc]
            step += 1
            ended = size[live] == step
            done = ended & (self.final[state] == 1)
            rank[live[done]] = total[done]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return rank


# ---------------------------------------------------------------- corpus

def pretoken_counts(docs: DataFrame, path: str, pattern: str, flush: int = KEPT_WORDS) -> DataFrame:
    """(word, n) over the whole texts; tasks add up what they see before the shuffle."""
    def rows(c: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    def run(batches):
        v = vocabulary(path, pattern)
        c: Counter = Counter()
        for b in slices(batches, most=SLICE):
            for t in b.column("text").to_pylist():
                if t:
                    c.update(v.split(t))
            if len(c) > flush:
                yield rows(c)
                c = Counter()
        yield rows(c)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, pattern: str, size: int, longest: int = 64) -> bytes:
    """Frequent pre-tokens of at most ``longest`` bytes, compiled: all whose count
    reaches the lowest step of a logarithmic scale that no more than ``size``
    pre-tokens reach. ``size`` bounds what the driver gathers and the executors map."""
    v = vocabulary(path, pattern)
    counts = cut_lineage(pretoken_counts(docs, path, pattern).where((F.col("n") > 1) & (F.octet_length("word") <= longest))
                         .withColumn("step", F.floor(F.log(F.col("n").cast("double")) * 32).cast("int")))
    steps = sorted(((r.step, r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True)  # some hundred rows
    total, least = 0, math.inf
    for step, n in steps:
        total += n
        if total > size:
            break
        least = step
    words = sorted(r.word for r in counts.where(F.col("step") >= least).select("word").collect()) if least < math.inf else []
    plain = [w.encode("utf-8") for w in words if w not in v.specials]
    ids, ends = v.merge_many(plain)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if plain else []
    lexicon = {w: tuple(ids[a:z].tolist()) for w, a, z in zip(plain, starts, ends)}
    return compile_lexicon(lexicon | {w.encode("utf-8"): v.merge(w) for w in words if w in v.specials})


@lru_cache(2)
def _mapped(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """Encodes slices of texts with a lexicon. A word's ids are looked up or merged
    once and kept for later slices; beyond ``most`` words the encoder starts anew."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, most: int = KEPT_WORDS):
        self.vocab, self.lexicon, self.most = vocab, lexicon, most
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.start = self.size = np.empty(0, np.int64)
        self.pool = np.array(self.lexicon.ids)

    def _learn(self, words: list[str]) -> None:
        """Starts and sizes in the pool for words new to this encoder."""
        data = [w.encode("utf-8") for w in words]
        rank = self.lexicon.ranks(data)
        hit = rank >= 0
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[hit] = self.lexicon.ends[rank[hit]]
        size[hit] = self.lexicon.ends[rank[hit] + 1] - start[hit]
        special = np.array([w in self.vocab.specials for w in words], bool) & ~hit
        plain = np.flatnonzero(~hit & ~special)
        ids, ends = self.vocab.merge_many([data[i] for i in plain.tolist()])
        size[plain] = np.diff(ends, prepend=0)
        start[plain] = len(self.pool) + ends - size[plain]
        more = [self.vocab.specials[words[i]] for i in np.flatnonzero(special).tolist()]
        start[special], size[special] = len(self.pool) + len(ids) + np.arange(len(more)), 1
        self.pool = np.concatenate([self.pool, ids, np.array(more, np.int64)])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all texts' ids one after the other, and where each text ends."""
        if len(self.codes) > self.most:
            self._forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                got = self.vocab.split(t)
                counts[i] = len(got)
                words += got
        known = len(self.codes)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if len(self.codes) > known:
            self._learn(list(itertools.islice(self.codes, known, None)))
        per = self.size[codes]
        ends = np.concatenate([[0], np.cumsum(per)])[np.cumsum(counts)]
        return self.pool[ragged(self.start[codes], per)], ends


class Decoder:
    """Ids back to text: the pieces' bytes one after the other, read as UTF-8."""

    def __init__(self, vocab: Vocabulary):
        self.pieces = vocab.pieces

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     lexicon_size: int = 65_536, lexicon: bytes | None = None) -> DataFrame:
    """(doc_id, n_tokens, decoded, ids array<int>) for every row: the ids of the whole text
    and the text that decoding the ids gives.

    Special tokens written inside a text are taken as such, none are added. Null
    texts count as empty; empty texts have no ids. Repeated rows are encoded one
    by one; an empty table gives no rows; extra columns are ignored.
    """
    return _tasks(df, path, pattern, id_col, text_col, lexicon_size, lexicon, False, True)


def token_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  lexicon_size: int = 65_536, lexicon: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of the same ids and
    decoded texts, made in the task that encodes them. Cases as in
    :func:`encode_documents`."""
    return _tasks(df, path, pattern, id_col, text_col, lexicon_size, lexicon, True, with_ids)


def _tasks(df, path, pattern, id_col, text_col, lexicon_size, lexicon, digests, with_ids) -> DataFrame:
    docs = pick(df, id_col, text_col)
    spark: SparkSession = df.sparkSession
    file = publish(spark, lexicon or build_lexicon(docs, path, pattern, lexicon_size), "lexicon")

    def run(batches):
        v = vocabulary(path, pattern)
        encoder, decoder = Encoder(v, _mapped(file)), Decoder(v)
        numbers = [str(i) for i in range(len(v.pieces))]
        for b in slices(batches, most=SLICE):
            ids, ends = encoder.encode(b.column("text").to_pylist())
            starts = np.concatenate([[0], ends[:-1]])
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(ends - starts, pa.int64())}
            first, second = [], []
            for a, z in zip(starts.tolist(), ends.tolist()):  # one text's ids at a time
                x = ids[a:z].tolist()
                text = decoder.decode(x)
                if digests:
                    first.append(sha256(",".join([numbers[i] for i in x]).encode()).hexdigest())
                    second.append(sha256(text.encode("utf-8")).hexdigest())
                else:
                    first.append(text)
            for name, values in zip(names[2:], (first, second)):
                if len(values) == b.num_rows:
                    cols[name] = pa.array(values, pa.string())
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict({k: cols[k] for k in names})

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["decoded"]), *(["ids"] if with_ids else [])]
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>"}
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))
