"""Scores of all noisy variants of an entry by what changed.

An entry's variants differ in some sentences only. What a sentence contributes to a
database's scores -- the truth values that its cells cover, the columns they sit
in, keys, cells of a wrong type -- is worked out once for each different sentence
and kept as bit masks over the truth; a variant's scores combine the masks of its
sentences. Only the joined text of a database, in which a value may run over two
cells, is looked at again, and only for values that no single cell holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from relweave.functions.text import NULL_WORDS, NUMBER_RE
from relweave.operators.coverage import CC_T, TC_T
from relweave.operators.similarity import N_GRAM
from relweave.session import share_package

_LONG = re.compile(r"\s*[+-]?[0-9]+\s*\Z")
_DOUBLE = re.compile(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?\s*\Z|\s*(?:[+-]?inf(?:inity)?|nan)\s*\Z", re.IGNORECASE)
_END_NUMBER = re.compile(r"([0-9]+)\Z")

#: Entries that a task holds as Python objects at a time, and strings whose grams and
#: numbers it keeps: its memory doesn't depend on the rows of an Arrow batch or of a partition.
PIECE_ENTRIES = 256
KEPT_STRINGS = 4096


@dataclass(frozen=True)
class Method:
    """How a database is read from facts: ``bound`` to known tables, ``typed`` to the
    schema's columns and types, or ``wide`` with values up to the first period; its foreign keys
    (child column, parent column, whose trailing number is the key); and its primary keys (attribute
    prefix of a table, key column), which every row of the table must have and none may repeat."""

    name: str
    bound: bool
    typed: bool
    wide: bool
    fks: tuple[tuple[str, str], ...]
    keys: tuple[tuple[str, str], ...] = ()


def _long(v: str) -> int | None:
    n = int(v) if _LONG.match(v) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def fits(kind: str | None, v: str) -> bool:
    """Whether a cell can be cast to its column's type."""
    return True if kind is None else _long(v) is not None if kind == "bigint" else bool(_DOUBLE.match(v))


@lru_cache(KEPT_STRINGS)
def grams(s: str) -> tuple[Counter, float]:
    p = f" {s.lower()} "
    c = Counter(p[i:i + N_GRAM] for i in range(len(p) - N_GRAM + 1))
    return c, math.sqrt(sum(n * n for n in c.values()))


def cosine(a: str, b: str) -> float:
    (x, na), (y, nb) = grams(a), grams(b)
    if len(x) > len(y):
        x, y = y, x
    return sum(n * y[g] for g, n in x.items() if g in y) / (na * nb) if na > 0 and nb > 0 else 0.0


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ENTRIES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, at most ``rows`` at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def facts(sentence: str) -> list[tuple[str, str]]:
    """(attribute, value) of every ``attribute is value`` item."""
    items = (x.split(" is ", 1) for x in re.sub(r"\.\Z", "", sentence).split(", ") if " is " in x)
    return [(a, v) for a, v in items]


class _Part:
    """What some cells add to a database."""

    __slots__ = ("cells", "covered", "inside", "equal", "equal_close", "part_close", "keys", "bad")

    def __init__(self):
        self.cells: list[tuple[str, str]] = []
        self.covered = self.inside = self.equal = self.equal_close = self.part_close = 0
        self.keys: list[tuple[str, str]] = []
        self.bad = False


class EntryScores:
    """One entry's truth and what its sentences contribute."""

    def __init__(self, truth: list[tuple[str, str, str]], methods: tuple[Method, ...], prefixes: tuple[str, ...], columns: frozenset[str], types: dict[str, str]):
        self.methods, self.prefixes, self.columns, self.types = methods, prefixes, columns, types
        both = [(a, v) for a, r, value in truth for v in (r, value) if v != "" and v.lower() not in NULL_WORDS]
        self.values = list(Counter(v for _, v in both).items())
        self.lowered = [v.lower() for v, _ in self.values]
        self.pairs = list(Counter((a, v.lower()) for a, v in both).items())
        self.key_columns = {c for m in methods for fk in m.fks for c in fk}
        self.parts: dict[tuple, _Part] = {}
        self.by_value: dict[str, tuple[int, int]] = {}
        self.by_cell: dict[tuple[str, str], tuple[int, int, int]] = {}
        self.by_column: dict[str, int] = {}
        # truth values by gram, so that a cell meets only those it shares one with
        self.holders: dict[str, list[tuple[int, int]]] = {}
        for i, (v, _) in enumerate(self.values):
            for g, n in grams(v)[0].items():
                self.holders.setdefault(g, []).append((i, n))

    def _covered(self, v: str) -> int:
        c, norm = grams(v)
        dots: dict[int, int] = {}
        for g, n in c.items():
            for i, m in self.holders.get(g, ()):
                dots[i] = dots.get(i, 0) + n * m
        return sum(1 << i for i, dot in dots.items() if dot / (grams(self.values[i][0])[1] * norm) >= TC_T)

    def _close(self, column: str) -> int:
        """The truth pairs whose attribute is close to a column's name."""
        got = self.by_column.get(column)
        if got is None:
            near = {a for a in {a for (a, _), _ in self.pairs} if cosine(a, column) >= CC_T}
            got = self.by_column[column] = sum(1 << i for i, ((a, _), _) in enumerate(self.pairs) if a in near)
        return got

    def _value_masks(self, v: str) -> tuple[int, int]:
        got = self.by_value.get(v)
        if got is None:
            low = v.lower()
            covered = self._covered(v)
            inside = sum(1 << i for i, t in enumerate(self.lowered) if t in low)
            got = self.by_value[v] = covered, inside
        return got

    def _cell_masks(self, column: str, low: str) -> tuple[int, int, int]:
        got = self.by_cell.get((column, low))
        if got is None:
            close, equal, part = self._close(column), 0, 0
            for i, ((_, q), _) in enumerate(self.pairs):
                if q in low or low in q:
                    part |= 1 << i
                    if q == low:
                        equal |= 1 << i
            got = self.by_cell[column, low] = equal, equal & close, part & close
        return got

    def _part(self, cells: list[tuple[str, str]]) -> _Part:
        p = _Part()
        p.cells = cells
        for column, v in cells:
            covered, inside = self._value_masks(v)
            equal, equal_close, part_close = self._cell_masks(column, v.lower())
            p.covered |= covered
            p.inside |= inside
            p.equal |= equal
            p.equal_close |= equal_close
            p.part_close |= part_close
            if column in self.key_columns:
                p.keys.append((column, v))
            p.bad = p.bad or not fits(self.types.get(column), v)
        return p

    def sentence(self, sentence: str, m: Method) -> _Part:
        got = self.parts.get((sentence, m.name))
        if got is None:
            cells = facts(sentence)
            if m.bound:
                cells = [(a, v) for a, v in cells if a.startswith(self.prefixes)]
            if m.typed:
                cells = [(a, v) for a, v in cells if a in self.columns and fits(self.types.get(a), v)]
            if m.wide:
                cells = [(a, v.split(".", 1)[0]) for a, v in cells]
            got = self.parts[sentence, m.name] = self._part(cells)
        return got

    def row_id(self, pos: int) -> _Part:
        got = self.parts.get((pos,))
        if got is None:
            got = self.parts[pos,] = self._part([("id", str(pos + 1))])
        return got

    @staticmethod
    def _share(counted: list, mask: int) -> float:
        of = sum(n for _, n in counted)
        return sum(n for i, (_, n) in enumerate(counted) if mask >> i & 1) / of if of else 0.0

    def score(self, sentences: list[str], m: Method) -> tuple[float, float, float, float, float, int]:
        """(tc, vc, cc, ri, ex, declared foreign keys) of one database."""
        covered = inside = equal = equal_close = part_close = 0
        line, keys, bad, seen = [], [], False, set()
        for pos, s in enumerate(sentences):
            own = self.sentence(s, m)
            if not own.cells:
                continue
            for prefix, column in m.keys:
                mine = [(column, v) for c, v in own.cells if c == column]
                bad = bad or len(mine) > 1 or not seen.isdisjoint(mine) or (not mine and any(c.startswith(prefix) for c, _ in own.cells))
                seen.update(mine)
            for p in (own, self.row_id(pos)):
                covered |= p.covered
                inside |= p.inside
                equal |= p.equal
                equal_close |= p.equal_close
                part_close |= p.part_close
                keys += p.keys
                bad = bad or p.bad
                line += [(pos, c, v.lower()) for c, v in p.cells]
        if not line:
            return 0.0, 0.0, 0.0, 0.0 if m.fks else 1.0, 0.0, len(m.fks)
        if inside != (1 << len(self.values)) - 1:
            joined = " | ".join(v for _, _, v in sorted(line))
            inside |= sum(1 << i for i, t in enumerate(self.lowered) if not inside >> i & 1 and t in joined)
        close = (equal & equal_close) | (~equal & part_close)
        return (self._share(self.values, covered), self._share(self.values, inside), self._share(self.pairs, close), self._integrity(keys, m.fks),
                0.0 if bad else 1.0, len(m.fks))

    @staticmethod
    def _integrity(keys: list[tuple[str, str]], fks: tuple[tuple[str, str], ...]) -> float:
        """Mean share of child keys found among the parent's; 1 where none is declared."""
        shares = []
        for child, parent in fks:
            kids = [k for k in (_long(v) for c, v in keys if c == child) if k is not None]
            there = {_long(n[1]) for c, v in keys if c == parent and (n := _END_NUMBER.search(v))}
            shares.append(sum(k in there for k in kids) / len(kids) if kids else 1.0)
        return sum(shares) / len(shares) if shares else 1.0


def score_variants(entries: DataFrame, variants: list[str], methods: list[Method], prefixes: list[str], columns: list[str], types: dict[str, str]) -> DataFrame:
    """(entry_id, variant, method, tc, vc, cc, ri, ex, n_fk) of entries (entry_id, truth
    array<struct<attr, row_id, value>>, texts array<array<string>>, the sentences of each variant
    in order)."""
    share_package(entries.sparkSession)
    ways, starts, known = tuple(methods), tuple(prefixes), frozenset(columns)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for entry, truth, texts in zip(*(b.column(c).to_pylist() for c in ("entry_id", "truth", "texts"))):
                e = EntryScores([(t["attr"], t["row_id"], t["value"]) for t in truth], ways, starts, known, types)
                out += [(entry, v, m.name, *e.score(s, m)) for v, s in zip(variants, texts) for m in ways]
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 5, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["entry_id", "variant", "method", "tc", "vc", "cc", "ri", "ex", "n_fk"])

    return entries.select("entry_id", "truth", "texts").mapInArrow(run, "entry_id long, variant string, method string, tc double, vc double, cc double, ri double, ex double, n_fk int")


# Fixed value: numbers with a sign, a dollar sign and thousands commas.
_NUMBER = re.compile(NUMBER_RE)


@lru_cache(KEPT_STRINGS)
def number(s: str) -> float | None:
    t = s.strip(" ")
    return float(t.replace("$", "").replace(",", "")) if _NUMBER.match(t) else None


def same_value(truth: str, cell: str, least: float) -> bool:
    """H1: a numeric truth needs a numeric cell within 0.01, any other one a similar text."""
    t = number(truth)
    if t is not None:
        c = number(cell)
        return c is not None and abs(t - c) < 0.01
    return (cosine(truth, cell) + 1.0) / 2.0 >= least


def row_scores(truth: list[tuple[str, str, str]], cells: list[tuple[int, str, str]], value_t: float, column_t: float, like: dict, named: dict) -> tuple[float, float, float]:
    """(row accuracy, match accuracy, match in the right column) of one database (C7,
    H4); -1 for all three without cells or truth. A truth item looks into the rows whose id cell is
    its row id, else into the row at its position and every fifth after it. ``like`` and ``named`` keep
    the pairs that were compared."""
    if not cells or not truth:
        return -1.0, -1.0, -1.0
    rows: dict[int, list[tuple[str, str]]] = {}
    by_id: dict[str, set[int]] = {}
    for pos, column, value in cells:
        rows.setdefault(pos, []).append((column, value))
        if column == "id":
            by_id.setdefault(value, set()).add(pos)
    found: dict[str, list[int]] = {}
    ids: dict[str, set[str]] = {}
    hits = right = 0
    for attr, row, value in truth:
        start = int(row) - 1
        where = by_id.get(row) or [p for p in rows if p >= start and (p - start) % 5 == 0]
        found.setdefault(attr, []).append(bool(where))
        ids.setdefault(attr, set()).add(row)
        hit = close = False
        for p in where:
            for column, v in rows[p]:
                if (value, v) not in like:
                    like[value, v] = same_value(value, v, value_t)
                if like[value, v]:
                    hit = True
                    if (attr, column) not in named:
                        named[attr, column] = (cosine(attr, column) + 1.0) / 2.0 >= column_t
                    close = close or named[attr, column]
        hits += hit
        right += close
    return sum(sum(f) / len(ids[a]) for a, f in found.items()) / len(found), hits / len(truth), right / len(truth)


def match_rows(entries: DataFrame, methods: list[str], value_t: float, column_t: float) -> DataFrame:
    """(method, entry_id, domain, avg_row_accuracy, match_accuracy,
    match_in_right_column_accuracy) of entries (entry_id, domain, truth array<struct<attr, row_id,
    value>>, pred array<struct<method, row_pos, id_val, column_name, value>>). Strings of an entry
    are compared when rows meet, once for all its databases."""
    share_package(entries.sparkSession)
    names = ["method", "entry_id", "domain", "avg_row_accuracy", "match_accuracy", "match_in_right_column_accuracy"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for entry, domain, truth, pred in zip(*(b.column(c).to_pylist() for c in ("entry_id", "domain", "truth", "pred"))):
                items, like, named = [(t["attr"], t["row_id"], t["value"]) for t in truth], {}, {}
                for m in methods:
                    mine = [c for c in pred if c["method"] == m]
                    cells = [(c["row_pos"], c["column_name"], c["value"]) for c in mine] + [(p, "id", v) for p, v in {(c["row_pos"], c["id_val"]) for c in mine}]
                    out.append((m, entry, domain, *row_scores(items, cells, value_t, column_t, like, named)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return entries.select("entry_id", "domain", "truth", "pred").mapInArrow(run, "method string, entry_id long, domain string, " + ", ".join(f"{c} double" for c in names[3:]))
