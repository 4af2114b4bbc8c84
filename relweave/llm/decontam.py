"""Benchmark decontamination through the CGK embedding.

Texts are compared as sequences of words. The embedding walks along a sequence
with random steps: at each step it writes the word it stands on and moves on or
stays, as a random bit of (step, word) says. Sequences at small edit distance
fall back into step with each other, so they agree on most of what is written:
edit distance becomes Hamming distance.

Bit sampling reads the embedding at a few random steps. A window of a document,
starting at any word and as long as an item, is a candidate for the items that
agree with it on all sampled steps; that is repeated with new walks and new
steps until items with as many edits as are allowed are found with the target
probability, whatever their length. The number of repetitions follows from trial
edits of all items. Long items enter at several starting points, which costs a
window nothing. Items of lengths still below the target after the last round are
also looked up by pieces: of one piece more than edits are allowed, one is
unchanged, so nothing of them is missed. Candidates are verified by exact edit
distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import pick, ragged, slices

_BASES = (12, 6, 3, 1)  # window classes: words that the sampled steps reach
_PUNCTUATION = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII characters other than letters and digits separate them."""
    return (text or "").lower().encode("utf-8").translate(_PUNCTUATION).split()


@dataclass
class Walk:
    """One repetition for one window class: the sampled steps, the walk's bits for
    every step and word, and what the items' starting points read there."""

    steps: list[int]
    bits: np.ndarray  # [step, word] 0/1
    first: np.ndarray  # [word] whether any entry reads it at the first sampled step
    keys: list[np.ndarray]  # sorted: readings so far, after each sampled step
    entries: np.ndarray  # entry of each last reading


def _read(codes: np.ndarray, starts: np.ndarray, last: np.ndarray, walk_bits: np.ndarray, steps: list[int]) -> np.ndarray:
    """What a walk from each start writes at the given steps; 0 beyond the text's
    end, whose zero stands at ``last``."""
    pos = starts.copy()
    out = np.empty((len(starts), len(steps)), np.int64)
    j = 0
    for k, s in enumerate(steps):
        while j < s:
            pos += walk_bits[j][codes[np.minimum(pos, last)]]
            j += 1
        out[:, k] = codes[np.minimum(pos, last)]
    return out


class Searcher:
    """All items of one block of the benchmark, ready to look documents up."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float = 0.2,
                 target: float = 0.95, samples: int = 4, seed: int = 1, most_rounds: int = 64):
        self.max_rate = max_rate
        texts = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in texts if w]
        self.vocab: dict[bytes, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)  # 0: a word of no item
        self.codes = [np.array([self.vocab[x] for x in w], np.int64) for _, w in self.items]
        rng = np.random.default_rng(seed)
        self.walks: list[Walk] = []
        self.entries: list[tuple[int, int]] = []  # item position, offset in the item
        for base in _BASES:
            mine = [k for k, c in enumerate(self.codes) if len(c) >= base and (base == _BASES[0] or len(c) < _BASES[_BASES.index(base) - 1])]
            if mine:
                self._add_class(mine, base, target, min(samples, base), rng, most_rounds)

    def _add_class(self, mine, base, target, samples, rng, most_rounds):
        # a walk of 2*base-1 steps stays within about base words
        span = 2 * base - 1
        by_length: dict[int, list[int]] = {}
        for k in mine:
            by_length.setdefault(len(self.codes[k]), []).append(k)
        trials = {n: self._trials(ks, rng) for n, ks in by_length.items()}
        for _ in range(most_rounds):
            if not trials:
                return
            # starting points about a window apart; the last one reaches the item's end
            places = [(k, off) for n in trials for off in sorted({*range(0, n - base + 1, base), n - base}) for k in by_length[n]]
            # the first sampled step is an early one: it sorts out most windows cheaply
            early = int(rng.integers(0, max(1, span // 4)))
            later = rng.choice(np.arange(early + 1, span), samples - 1, replace=False) if samples > 1 else []
            bits = rng.integers(0, 2, (span, len(self.vocab) + 1)).astype(np.int8)
            bits[:, 0] = 1  # no item has this word: go past it
            walk = self._walk(places, sorted([early, *map(int, later)]), bits)
            # a length leaves the later rounds when it meets the target
            trials = {n: t for n, t in trials.items() if self._missed(t, walk) > 1 - target}
        for n in trials:
            self._add_pieces(by_length[n])

    def _walk(self, places: list[tuple[int, int]], steps: list[int], bits: np.ndarray) -> Walk:
        """The walk, added to the search, with what (item, offset) places read on it."""
        begin = len(self.entries)
        self.entries += places
        used = sorted({k for k, _ in places})
        ends = dict(zip(used, np.cumsum([len(self.codes[k]) + 1 for k in used]).tolist()))
        last = np.array([ends[k] - 1 for k, _ in places])
        starts = np.array([ends[k] - 1 - len(self.codes[k]) + off for k, off in places])
        got = _read(np.concatenate([np.append(self.codes[k], 0) for k in used]), starts, last, bits, steps)
        keys, h = [], np.zeros(len(got), np.uint64)
        for k in range(len(steps)):
            h = _mix(h, got[:, k])
            keys.append(h)
        order = np.argsort(keys[-1], kind="stable")
        first = np.zeros(len(self.vocab) + 1, bool)
        first[got[:, 0]] = True
        first[0] = False
        walk = Walk(steps, bits, first, [np.unique(k) for k in keys[:-1]] + [keys[-1][order]], begin + order)
        self.walks.append(walk)
        return walk

    def _add_pieces(self, items: list[int]) -> None:
        """The items' pieces, as walks that move on at every step."""
        places: dict[int, list[tuple[int, int]]] = {}
        for k in items:
            n = len(self.codes[k])
            pieces = int(self.max_rate * n) + 1
            at = [i * n // pieces for i in range(pieces + 1)]
            for a, b in zip(at, at[1:]):
                places.setdefault(b - a, []).append((k, a))
        for width, mine in places.items():
            self._walk(mine, list(range(width)), np.ones((width, len(self.vocab) + 1), np.int8))

    def _trials(self, mine: list[int], rng, per_item: int = 8, least: int = 400, slice_words: int = 1 << 18):
        """Copies of all the items, which have one length, with as many edits as are
        allowed: words replaced, left out or put in, half of the new words unknown
        and half the items' own, between other such words. In slices (codes, ends,
        item, begin and end of the copy, whether it was found)."""
        n = len(self.codes[mine[0]])
        edits = int(self.max_rate * n)
        words = lambda m: np.where(rng.random(m) < 0.5, 0, rng.integers(1, len(self.vocab) + 1, m))
        out, parts, rows, size = [], [], [], 0
        for k in np.repeat(mine, max(per_item if edits else 1, -(-least // len(mine)) if edits else 1)).tolist():
            new = [[x] for x in self.codes[k].tolist()]
            for p, kind, x in zip(rng.permutation(n)[:edits].tolist(), rng.integers(0, 3, edits).tolist(), words(edits).tolist()):
                new[p] = [[], [x], [x, *new[p]]][kind]
            copy = [x for w in new for x in w]
            around = words(24).tolist()
            rows.append((k, size + 12, size + 12 + len(copy)))
            parts += [*around[:12], *copy, *around[12:], 0]
            size += len(copy) + 25
            if size > slice_words:
                out.append(self._trial_slice(parts, rows))
                parts, rows, size = [], [], 0
        if rows:
            out.append(self._trial_slice(parts, rows))
        return out

    @staticmethod
    def _trial_slice(parts, rows):
        rows = np.array(rows, np.int64)
        return np.array(parts, np.int64), rows[:, 2] + 13, rows, np.zeros(len(rows), bool)

    def _missed(self, trials, walk: Walk) -> float:
        """Share of the trials that no walk so far has found."""
        place = np.array(self.entries, np.int64).reshape(-1, 2)
        for codes, ends, rows, found in trials:
            starts = np.flatnonzero(codes)
            of = np.searchsorted(ends, starts, "right")
            starts, of = starts[~found[of]], of[~found[of]]
            entry, at = self._look(codes, starts, ends[of] - 1, walk)
            t = np.searchsorted(ends, at, "right")
            item, begin = place[entry, 0], at - place[entry, 1]
            n = len(self.codes[rows[0, 0]])
            most = int(self.max_rate * n)
            # what is verified must hold the copy
            ok = (item == rows[t, 0]) & (begin - most <= rows[t, 1]) & (rows[t, 2] <= begin + n + most)
            found[t[ok]] = True
        return 1 - sum(x[3].sum() for x in trials) / sum(len(x[3]) for x in trials)

    def _look(self, codes: np.ndarray, starts: np.ndarray, last: np.ndarray, walk: Walk) -> tuple[np.ndarray, np.ndarray]:
        """(entries, starts): windows that agree with an entry on all sampled steps.
        ``last``: where the zero after each start's text stands; a walk ends there."""
        pos, at = starts.copy(), starts
        h = None
        j = 0
        for k, s in enumerate(walk.steps):
            while j < s:
                pos += walk.bits[j][codes[np.minimum(pos, last)]]
                j += 1
            word = codes[np.minimum(pos, last)]
            if k == 0:
                ok = walk.first[word]
                pos, at, last, word = pos[ok], at[ok], last[ok], word[ok]
                h = np.zeros(len(at), np.uint64)
            h = _mix(h, word)
            if k < len(walk.steps) - 1:
                if k:
                    ok = _member(walk.keys[k], h)
                    pos, at, last, h = pos[ok], at[ok], last[ok], h[ok]
                if not len(at):
                    return np.empty(0, np.int64), at
        lo, hi = np.searchsorted(walk.keys[-1], h, "left"), np.searchsorted(walk.keys[-1], h, "right")
        n = hi - lo
        return walk.entries[ragged(lo, n)], np.repeat(at, n)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item id, edits, first word, words, item words): for each text and
        item the best verified window."""
        get = self.vocab.get
        parts, ends = [], []
        total = 0
        for t in texts:
            # a zero after each text, where its windows end
            c = [get(w, 0) for w in words_of(t)]
            c.append(0)
            parts += c
            total += len(c)
            ends.append(total)
        codes = np.array(parts, np.int64)
        ends = np.array(ends, np.int64)
        starts = np.flatnonzero(codes)
        last = ends[np.searchsorted(ends, starts, "right")] - 1
        got = [self._look(codes, starts, last, walk) for walk in self.walks]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if got:
            place = np.array(self.entries, np.int64).reshape(-1, 2)[np.concatenate([e for e, _ in got])]
            found = np.concatenate([p for _, p in got])
            # item, assumed beginning of the item, and the text that holds the window
            pairs = np.unique(np.stack([place[:, 0], found - place[:, 1], np.searchsorted(ends, found, "right")], 1), axis=0)
            cut = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            for mine in np.split(pairs, cut) if len(pairs) else []:
                self._verify(int(mine[0, 0]), mine[:, 1], mine[:, 2], codes, ends, best)
        return [(d, self.items[k][0], e, a, n, len(self.codes[k])) for (d, k), (e, a, n) in best.items()]

    def _verify(self, k: int, begins: np.ndarray, texts: np.ndarray, codes: np.ndarray, ends: np.ndarray, best: dict) -> None:
        item = self.codes[k]
        n, most = len(item), int(self.max_rate * len(item))
        words, times = np.unique(item, return_counts=True)
        for i in range(0, len(begins), 4096):
            at, of = begins[i:i + 4096], texts[i:i + 4096]
            window = codes[np.clip(at[:, None] + np.arange(-most, n + most), 0, len(codes) - 1)]
            # item words that the window lacks altogether must be edited
            present = sum(t * (window == w).any(1) for w, t in zip(words, times))
            near = present >= n - most
            for p, d in zip(at[near].tolist(), of[near].tolist()):
                begin, end = (int(ends[d - 1]) if d else 0), int(ends[d]) - 1
                lo, hi = max(begin, p - most), min(end, p + n + most)
                got = edits_within(item, codes[lo:hi], most) if hi > lo else None
                if got is not None:
                    new = (got[0], lo + got[1] - begin, got[2] - got[1])
                    if (d, k) not in best or new < best[d, k]:
                        best[d, k] = new


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _member(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def edits_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` nearest to ``item`` by edit
    distance, the leftmost shortest of equals; None if it is over ``most``."""
    n, m = len(item), len(text)
    for s in range(m - n + 1):  # the usual case: unchanged
        if text[s] == item[0] and np.array_equal(text[s:s + n], item):
            return 0, s, s + n
    if np.isin(item, text).sum() < n - most:
        return None
    row = np.zeros(m + 1, np.int64)
    start = np.arange(m + 1)
    idx = np.arange(m + 1)
    for x in item:
        diag = row[:-1] + (text != x)
        up = row[1:] + 1
        new, frm = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], frm[0] = row[0] + 1, start[0]
        take = diag <= up
        new[1:], frm[1:] = np.where(take, diag, up), np.where(take, start[:-1], start[1:])
        # insertions of text words: running minimum of new[j] - j
        low = np.minimum.accumulate(new - idx)
        better = low + idx < new
        if better.any():
            src = np.maximum.accumulate(np.where(new - idx == low, idx, 0))
            frm = np.where(better, frm[src], frm)
            new = np.where(better, low + idx, new)
        row, start = new, frm
    j = int(row.argmin())
    return (int(row[j]), int(start[j]), j) if row[j] <= most else None


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", block_bytes: int = 8 << 20, **search) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words, item_words): one row for each
    row of documents and item with a passage within ``max_rate`` of the item's
    words in edits (default a fifth), with the nearest passage found.

    The benchmark is taken in blocks of about ``block_bytes`` of text, one search
    over the documents each, so what a task receives is bounded. Null or empty
    texts and items without words match nothing; a null item id counts as an id.
    Items of equal text are all reported, a repeated item row once. Repeated
    document rows are reported row by row. Empty tables give no rows; extra
    columns are ignored.
    """
    docs = pick(df, id_col, text_col)
    out = None
    for sent in _searchers(benchmark, item_col, item_text_col, block_bytes, search):
        def run(batches, sent=sent):
            for b in slices(batches):
                got = sorted(sent.value.find(b.column("text").to_pylist()), key=lambda x: x[:1] + x[2:])
                if got:
                    cols = list(zip(*got))
                    ids = b.column("doc_id").take(pa.array(cols[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                                     ["doc_id", "item_id", "edits", "first_word", "n_words", "item_words"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, edits long, first_word long, n_words long, item_words long")
        out = part if out is None else out.unionByName(part)
    return out


def clean_rows(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               block_bytes: int = 8 << 20, **search) -> DataFrame:
    """The rows, all columns kept, that hold no passage of the benchmark; each row is
    judged where it is, without a shuffle. Cases as in :func:`contaminated`; a row
    with a null id is judged like any other."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), F.col(text_col).cast("string").alias("text"))
    for sent in _searchers(benchmark, item_col, item_text_col, block_bytes, search):
        def run(batches, sent=sent):
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in sent.value.find(b.column("text").to_pylist())]] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[F.col(f"record.`{c}`") for c in df.columns])


def _searchers(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int, search: dict):
    """A broadcast searcher for each block of the benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        block = sorted(((r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()),
                       key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        yield spark.sparkContext.broadcast(Searcher(block, **search))
