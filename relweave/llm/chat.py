"""Chat formatting with a grammar round trip.

A conversation is written as ``<s>``, its turns, ``</s>``. A turn is

    [INST role]text[/INST]          or, with its text escaped,
    [INST role*]text[/INST]

and the grammar has one parse only: the next control string decides. Every turn is
first written plainly; what was written is parsed again and compared with the
source, and a turn that doesn't come back the same is written escaped: the
characters that control strings and heads are made of, and the backslash, become
a backslash and a letter. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import shuffle_partitions

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST ", "[/INST]"
_CONTROL = re.compile(r"<s>|</s>|\[INST |\[/INST\]")
_LETTERS = {"\\": "b", "<": "l", "[": "o", "]": "c", "*": "s"}
_MEANT = {v: k for k, v in _LETTERS.items()}
_ESCAPE = re.compile(r"[\\<\[\]*]")
_UNESCAPE = re.compile(r"\\([blocs])")


class GrammarError(ValueError):
    pass


def _escaped(s: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + _LETTERS[m[0]], s)


def _unescaped(s: str) -> str:
    return _UNESCAPE.sub(lambda m: _MEANT[m[1]], s)


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int, int, bool, int]:
    """(role, text, text start, text end, escaped, end of turn) of the turn at ``at``."""
    if not s.startswith(OPEN, at):
        raise GrammarError(f"no turn at {at}")
    i = at + len(OPEN)
    j = s.find("]", i)
    if j < 0:
        raise GrammarError("unclosed turn head")
    head = s[i:j]
    escaped = head.endswith("*")
    m = _CONTROL.search(s, j + 1)
    if m is None or m[0] != CLOSE:
        raise GrammarError("turn without an end")
    raw = s[j + 1:m.start()]
    role = head[:-1] if escaped else head
    if escaped:
        role, raw = _unescaped(role), _unescaped(raw)
    return role, raw, j + 1, m.start(), escaped, m.end()


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """(written turn, text start, text end): plain if that reads back as the same
    role and text, else escaped."""
    for r, t, mark in ((role, text, ""), (_escaped(role), _escaped(text), "*")):
        s = f"{OPEN}{r}{mark}]{t}{CLOSE}"
        try:
            got = parse_turn(s)
        except GrammarError:
            continue
        if got[:2] == (role, text) and got[5] == len(s):
            return s, got[2], got[3]
    raise GrammarError("a turn can't be written")  # escaped turns always read back


def parse(s: str) -> list[tuple[str, str]]:
    """The turns of a written conversation."""
    if not s.startswith(BEGIN):
        raise GrammarError("no beginning")
    at, out = len(BEGIN), []
    while not s.startswith(END, at):
        role, text, _, _, _, at = parse_turn(s, at)
        out.append((role, text))
    if at + len(END) != len(s):
        raise GrammarError("text after the end")
    return out


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, last, role, formatted, loss_start, loss_end): the written
    conversations in pieces, one row per turn, in order within a partition.

    The pieces of a conversation, joined in order, are its formatted text; the
    first begins it and the last ends it. ``loss_start`` and ``loss_end`` bound the
    loss mask inside the piece (null where nothing is under it). Pieces keep the
    memory of a task to one turn, however long a conversation is.

    Null roles and texts count as empty. Turns are ordered by turn (null first),
    then role, then text; repeated rows are turns of their own. Rows with a null
    conversation id form one conversation. An empty table gives no rows; extra
    columns are ignored.
    """
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        held = None  # the turn whose successor decides whether it ends its conversation
        part = 0

        def written(row, last):
            conv, role, s, a, b = row
            lead = BEGIN if part == 0 else ""
            loss = (len(lead) + a, len(lead) + b) if role == "assistant" else (None, None)
            return conv, part, last, role, lead + s + (END if last else ""), *loss

        def batch(rows):
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "last", "role", "formatted", "loss_start", "loss_end"])

        for b in batches:
            out, size = [], 0
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held is not None:
                    last = held[0] != conv
                    out.append(written(held, last))
                    part = 0 if last else part + 1
                    size += len(held[2])
                held = (conv, role, *write_turn(role, text))
                if size > 4 << 20:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)
        if held is not None:
            yield batch([written(held, True)])

    n = shuffle_partitions(df.sparkSession)
    return (rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, "conv_id long, part long, last boolean, role string, formatted string, loss_start long, loss_end long"))


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars):
    parsed from the formatted pieces alone, which must come as :func:`format_turns`
    leaves them; hashes grow turn by turn."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        turns, loss, n, masked, chars = sha256(), sha256(), 0, 0, 0
        for b in batches:
            out = []
            for conv, part, last, s, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "last", "formatted", "loss_start", "loss_end"))):
                at = len(BEGIN) if part == 0 else 0
                role, text, start, _, escaped, end = parse_turn(s, at)
                if (part == 0 and not s.startswith(BEGIN)) or s[end:] != (END if last else ""):
                    raise GrammarError(f"conversation {conv} doesn't parse")
                turns.update(f"{role}\n{text}\n".encode("utf-8"))
                n += 1
                chars += len(s)
                if a is not None:
                    under = s[a:z]
                    if escaped:
                        under = _unescaped(under)
                    loss.update(under.encode("utf-8"))
                    masked += len(under)
                if last:
                    out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
                    turns, loss, n, masked, chars = sha256(), sha256(), 0, 0, 0
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
