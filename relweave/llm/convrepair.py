"""Repair of a conversation's structure, with an audit of the edits.

Rows are read in order of their turn. Each is kept, given the other role or
deleted, and empty turns may be put in, so that the roles become an optional
system turn and then pairs of user and assistant, at the least cost. Among the
cheapest audits (the edits' initials) the least in ASCII counts.

The audits of all states grow as linked nodes that share their prefixes. A node
has its 2^k-th ancestors and a rolling hash of its whole prefix; two audits of
equal cost are compared by a search for their longest common prefix over the
ancestors' hashes, and equal hashes of different nodes are verified edit by edit.
Equal cost never makes one audit a prefix of the other: they would differ by
inserts, which cost. What all live audits share is final; it's handed out and
its nodes are dropped, so memory follows the length on which they still differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import shuffle_partitions

REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
_PRIME, _BASE = (1 << 61) - 1, 0x5DEECE66D
#: Where a turn of that initial leads: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FOLLOWS = {"su", "ua", "au"}
_FILLED = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


class Edits:
    """Edit strings as nodes of a tree; node 0 is what all of them begin with."""

    def __init__(self):
        self.char, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, char: str) -> int:
        ups, k = [parent], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.char.append(char)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(char)) % _PRIME)
        self.up.append(ups)
        return len(self.char) - 1

    def string(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            ups = self.up[node]
            node = ups[min((self.depth[node] - depth).bit_length(), len(ups)) - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Equal hashes are verified: along the nodes until the two meet."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.char[a] != self.char[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the edits at ``a`` and then ``x`` come before those at ``b`` and then ``y``."""
        if a == b:
            return x < y
        depth = min(self.depth[a], self.depth[b])
        p, q = self.ancestor(a, depth), self.ancestor(b, depth)
        if self._same(p, q):
            c = x if self.depth[a] == depth else self.char[self.ancestor(a, depth + 1)]
            d = y if self.depth[b] == depth else self.char[self.ancestor(b, depth + 1)]
            return (c, self.depth[a]) < (d, self.depth[b])
        for k in range(len(self.up[p]) - 1, -1, -1):
            if k < len(self.up[p]) and self.hash[self.up[p][k]] != self.hash[self.up[q][k]]:
                p, q = self.up[p][k], self.up[q][k]
        if not self._same(self.up[p][0], self.up[q][0]):
            return self.string(a) + x < self.string(b) + y  # hashes met by chance
        return self.char[p] < self.char[q]

    def common(self, nodes: list[int]) -> int:
        """The last node that lies on all paths; a parent's number is always smaller."""
        left = set(nodes)
        while len(left) > 1:
            top = max(left)
            left.remove(top)
            left.add(self.up[top][0])
        return left.pop()

    def rooted(self, nodes: list[int], root: int) -> tuple[Edits, dict[int, int]]:
        """The same paths below ``root`` alone, and the nodes' new numbers."""
        paths = set()
        for n in nodes:
            while n != root and n not in paths:
                paths.add(n)
                n = self.up[n][0]
        out, new = Edits(), {root: 0}
        for n in sorted(paths):
            new[n] = out.add(new[self.up[n][0]], self.char[n])
        return out, new


class Audit:
    """The cheapest audits of one conversation, row by row."""

    def __init__(self):
        self.edits = Edits()
        self.heads: dict[int, tuple[int, int]] = {0: (0, 0)}
        self._inserts()

    def _better(self, old, new):
        """Candidates are (cost, parent node, edit)."""
        if old is None or new[0] != old[0]:
            return new if old is None or new[0] < old[0] else old
        return new if self.edits.less(new[1], new[2], old[1], old[2]) else old

    def _inserts(self) -> None:
        for state, sources in ((2, (0, 1, 3)), (3, (2,))):
            best = None
            for s in sources:
                if s in self.heads:
                    best = self._better(best, (self.heads[s][0] + INSERT, self.heads[s][1], "I"))
            own = self.heads.get(state)
            if best is None or (own is not None and own[0] < best[0]):
                continue
            if own is not None and own[0] == best[0]:
                mine = (own[0], self.edits.up[own[1]][0], self.edits.char[own[1]]) if own[1] else None
                if mine is None or self._better(mine, best) is mine:
                    continue
            self.heads[state] = (best[0], self.edits.add(best[1], best[2]))
        # from state 3 all is open that is from 1, and all but one system turn (at most one deletion) that is from 0
        most = self.heads[3][0] if 3 in self.heads else None
        for state, slack in ((0, DELETE), (1, 0)):
            if most is not None and state in self.heads and self.heads[state][0] > most + slack:
                del self.heads[state]

    def push(self, initial: str, must_go: bool, unfinished: bool) -> None:
        best: dict[int, tuple] = {}
        extra = UNFINISHED if unfinished else 0
        for state, (cost, node) in self.heads.items():
            best[state] = self._better(best.get(state), (cost + DELETE, node, "D"))
            if must_go:
                continue
            to = _AFTER.get(initial, {}).get(state)
            if to is not None:
                best[to] = self._better(best.get(to), (cost + extra, node, "K"))
            to = 3 if state == 2 else 2
            best[to] = self._better(best.get(to), (cost + REROLE + extra, node, "R"))
        self.heads = {state: (cost, self.edits.add(node, edit)) for state, (cost, node, edit) in best.items()}
        self._inserts()

    def final(self) -> str:
        """The edits that no later row can change and that weren't handed out yet."""
        nodes = [n for _, n in self.heads.values()]
        root = self.edits.common(nodes)
        out = self.edits.string(root)
        self.edits, new = self.edits.rooted(nodes, root)
        self.heads = {s: (c, new[n]) for s, (c, n) in self.heads.items()}
        return out

    def finish(self) -> str:
        best = None
        for state in (0, 3):
            if state in self.heads:
                cost, node = self.heads[state]
                best = self._better(best, (cost, node, ""))
        return self.edits.string(best[1])


def fault(role: str, text: str, repeated: bool) -> str | None:
    """A row's first fault."""
    if not _FILLED.search(text):
        return "blank"
    if repeated:
        return "duplicate"
    return None if _LAST.search(text)[1] in ".!?" else "truncated"


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32 of ``conv_id:turn``
    modulo 20. 0 drops the row (``gone``, so that its conversation isn't lost), 1
    empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role
    user. Null roles, texts and parts of the key count as one space; ids and turns
    stay null."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = df.select(conv.alias("conv_id"), turn.alias("turn"), blank(F.col(role_col)).alias("role"), blank(F.col(text_col)).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
                        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy"))


_PIECES = "conv_id long, seq long, last boolean, edit string, turn long, role string, text string, fault string, illegal boolean"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]


class _Conversation:
    """One conversation on its way through: rows wait for their edits to be final."""

    def __init__(self, conv):
        self.conv, self.audit, self.rows, self.at = conv, Audit(), [], 0
        self.state, self.seq, self.before, self.waiting = 0, 0, None, 0

    def push(self, turn, role, text, later):
        same = self.before == (turn, role, text)
        f = fault(role, text, later or same)
        initial = role[:1]
        illegal = self.before is not None and self.before[1][:1] + initial not in _FOLLOWS
        self.before = (turn, role, text)
        self.audit.push(initial, f in ("blank", "duplicate"), f == "truncated")
        self.rows.append((turn, role, text, f, illegal))
        self.waiting += len(text) + 64

    def edits(self, audit: str) -> Iterator[tuple]:
        for e in audit:
            turn, role, text, f, illegal = (None, None, "", None, False) if e == "I" else self.rows[self.at]
            self.at += e != "I"
            if e == "D":
                text = None
            else:
                if e != "K":
                    role = "assistant" if self.state == 2 else "user"
                self.state = 1 if role[:1] == "s" else 3 if self.state == 2 else 2
            yield self.conv, self.seq, False, e, turn, role, text, f, illegal
            self.seq += 1
        del self.rows[:self.at]
        self.at = 0

    def finish(self) -> Iterator[tuple]:
        last = None
        for row in self.edits(self.audit.finish()):
            if last is not None:
                yield last
            last = row
        if last is not None:
            yield (*last[:2], True, *last[3:])
        else:  # nothing left to hand out, or no rows at all
            yield self.conv, self.seq, True, None, None, None, None, None, False


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None,
           check_bytes: int = 1 << 20) -> DataFrame:
    """(conv_id, seq, last, edit, turn, role, text, fault, illegal): the edits of every
    conversation in order, one row each, ordered within a partition.

    ``edit`` is K (kept), R (other role), D (deleted, its role as it was and a null
    text) or I (an empty turn put in, null turn); rows that aren't D are the repaired
    conversation. ``fault`` is the source row's: blank, duplicate (role and
    text seen earlier) or truncated; ``illegal`` marks a source row whose role can't follow
    the one before it. A row with a null edit ends a conversation that has nothing left, or no rows.

    Rows are ordered by turn (null first), role, text; null roles and texts count as one
    space. Rows with a null conversation id form one conversation. With ``gone_col``,
    rows where it's true only name their conversation. An empty table gives no
    rows; extra columns are ignored. A conversation streams through one task, which
    holds the rows whose edit isn't final yet.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
                     (F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)).alias("gone"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    # role and text that several turns hold; within one turn equal rows are neighbours
    first = (rows.where(~F.col("gone")).groupBy("conv_id", "key").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.bool_or(F.col("turn").isNull()).alias("at_null"))
             .where((F.col("low") < F.col("high")) | (F.col("at_null") & F.col("low").isNotNull()))
             .select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "low", "at_null"))
    seen = F.coalesce(F.when(F.col("at_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low")), F.lit(False))
    rows = (rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
            .select("conv_id", "turn", "role", "text", "gone", seen.alias("later")))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], ["conv_id", "seq", "last", "edit", "turn", "role", "text", "fault", "illegal"])

    def run(batches):
        conv, out, size = None, [], 0
        for b in batches:
            for c, turn, role, text, gone, later in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "gone", "later"))):
                if conv is None or conv.conv != c:
                    if conv is not None:
                        out += conv.finish()
                    conv = _Conversation(c)
                if not gone:
                    conv.push(turn, role, text, later)
                    size += len(text) + 64
                    if conv.waiting > check_bytes:
                        out += conv.edits(conv.audit.final())
                        conv.waiting = 0
                if size > 4 * check_bytes and out:
                    yield batch(out)
                    out, size = [], 0
        if conv is not None:
            out += conv.finish()
        if out:
            yield batch(out)

    n = shuffle_partitions(df.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _PIECES)


def summaries(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256): one row per conversation from the edits as :func:`repair`
    leaves them; hashes and counts grow row by row. ``gaps`` are the turns missing
    between the least and the largest one."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches):
        def fresh():
            return {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": sha256(), "any": False}

        one = fresh()
        for b in batches:
            out = []
            for conv, last, e, turn, role, text, f, illegal in zip(*(b.column(x).to_pylist() for x in ("conv_id", "last", "edit", "turn", "role", "text", "fault", "illegal"))):
                if e is not None:
                    one["audit"].append(e)
                    one["cost"] += cost[e] + (UNFINISHED if f == "truncated" and e != "D" else 0)
                    one["illegal"] += illegal
                    if f:
                        one[f] += 1
                    if turn is not None and turn != one["high"]:
                        one["low"] = turn if one["low"] is None else one["low"]
                        one["high"] = turn
                        one["turns"] += 1
                    if text is not None:
                        one["sha"].update(f"{chr(10) if one['any'] else ''}{role}:{text}".encode())
                        one["any"] = True
                if last:
                    gaps = one["high"] - one["low"] + 1 - one["turns"] if one["turns"] else 0
                    out.append((conv, gaps, *(one[x] for x in names[2:7]), "".join(one["audit"]), one["sha"].hexdigest()))
                    one = fresh()
            if out:
                kinds = [pa.int64()] * 7 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return pieces.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
