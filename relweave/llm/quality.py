"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its own characters and words and those of its two
neighbours. The field has two states, good and bad. Which lines of a training
document are good is hidden: its label only says that good lines make up most or
little of its length. Forward and backward messages are kept as log odds, so a step
of the chain is one expression, worked for all documents of a slice at once. A
document's score is the mean of its lines' marginals, weighted by line length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import pick, slices

_SLICE = 2 << 20
_P = np.uint64(0x100000001B3)
_P_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@=+<>^~\\{}[]_/", b"|", b"!?", b".,;:", b" \t\r\x0b\x0c"]
N_OWN = 16


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line bytes, lines per text) of all lines of all texts."""
    per = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
    buf = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-8"), np.uint8)
    breaks = np.flatnonzero(buf == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(buf)]])
    size = end - start
    kind = np.full(256, 9, np.uint8)  # 8: line break, 9: other, 10: not ASCII
    kind[128:] = 10
    kind[10] = 8
    for i, chars in enumerate(_CLASSES):
        kind[np.frombuffer(chars, np.uint8)] = i
    k = kind[buf]

    def count(mask):
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (c[end] - c[start]).astype(np.float64)

    n = np.maximum(size, 1)
    upper, lower, digit, symbol, bar, shout, stop, space = (count(k == i) for i in range(8))
    letters = np.maximum(upper + lower, 1)

    solid = ~((k == 7) | (k == 8))
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(start, ws, "right") - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf.astype(np.uint64) * _powers(len(buf), _P)[:len(buf)])])
    h = (sums[we] - sums[ws]) * _powers(len(buf), _P_INV)[ws]
    words = np.bincount(line, minlength=len(size)).astype(np.float64)
    many = np.maximum(words, 1)
    again = np.zeros(len(ws), bool)
    if len(ws):
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    _, first = np.unique(h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    kinds = np.bincount(line[first], minlength=len(size))
    odd_end = np.isin(k[we - 1], (3, 5)) if len(ws) else np.zeros(0, bool)
    whole = np.bincount(line, again, len(size))
    mix = (sums[end] - sums[start]) * _powers(len(buf), _P_INV)[start]
    doc = np.repeat(np.arange(len(per)), per)
    _, inv, times = np.unique(mix ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    own = np.stack([
        np.log1p(size), upper / letters, digit / n, symbol / n, bar / n, shout / n, stop / n, space / n,
        count(k == 10) / n, np.log1p(words), (size - space) / many, whole / many, kinds / many,
        np.bincount(line, odd_end, len(size)) / many, (times[inv] > 1) & (size > 0), size == 0], 1)
    return own.astype(np.float32), size, per


def with_neighbours(own: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (zero at
    its ends), and a constant."""
    first = np.cumsum(per) - per
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[first + per - 1] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], 1)


def messages(s: np.ndarray, a: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of state 1 over chains of ``per`` lines with
    line scores ``s`` and transition scores ``a[from, to]``."""
    order = np.argsort(-per, kind="stable")
    first, size = (np.cumsum(per) - per)[order], per[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # chains longer than t
    m, b = s.astype(np.float64).copy(), np.zeros(len(s))
    for t in range(1, len(live)):
        at = first[:live[t]] + t
        x = m[at - 1]
        m[at] += np.logaddexp(a[0, 1], x + a[1, 1]) - np.logaddexp(a[0, 0], x + a[1, 0])
    for t in range(len(live) - 2, -1, -1):
        at = first[:live[t + 1]] + t
        x = s[at + 1] + b[at + 1]
        b[at] = np.logaddexp(a[1, 0], x + a[1, 1]) - np.logaddexp(a[0, 0], x + a[0, 1])
    return m, b


@dataclass
class LineField:
    """A fitted field: standardisation, line weights and transition scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, own: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        x = with_neighbours((own - self.mean) / self.scale, per)
        s = x @ self.weights
        m, b = messages(s, self.moves, per)
        return 1 / (1 + np.exp(-np.clip(m + b, -50, 50)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        own, size, per = line_features(texts)
        p, w = self.marginals(own, per), size + 1.0
        first = np.cumsum(per) - per
        return np.add.reduceat(p * w, first) / np.add.reduceat(w, first)


def _expected(s: np.ndarray, a: np.ndarray, per: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of state 1, and each neighbouring pair's of its four states."""
    m, b = messages(s, a, per)
    right = s[inner + 1] + b[inner + 1]
    pair = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] + right, m[inner] + a[1, 0], m[inner] + a[1, 1] + right], 1)
    pair = np.exp(pair - pair.max(1, keepdims=True))
    return 1 / (1 + np.exp(-np.clip(m + b, -50, 50))), pair / pair.sum(1, keepdims=True)


def fit_field(own: np.ndarray, per: np.ndarray, label: np.ndarray, doc: np.ndarray | None = None, rounds: int = 300, alone: int = 100,
              every: int = 5, most: float = 0.85, little: float = 0.25, rate: float = 0.05, ridge: float = 1e-3) -> LineField:
    """Gradient steps with hidden line labels; ``label``: one 0/1 per chain, ``doc``: the
    chain's document (none: one each).

    The first ``alone`` rounds fit the line scores with the document's label on all its
    lines and no transitions. After that the lines' labels are expected ones, made
    again after ``every`` steps: forward and backward over the field itself, with each
    document's line scores shifted by as much as it takes for good lines to make up at
    least ``most`` (label 1) or at most ``little`` (label 0) of its length.
    """
    mean, scale = own.mean(0), np.maximum(own.std(0), 1e-3)
    x = with_neighbours((own - mean) / scale, per).astype(np.float64)
    doc = np.repeat(np.arange(len(per)) if doc is None else np.unique(doc, return_inverse=True)[1], per)
    y = np.repeat(label, per).astype(np.float64)
    good = np.zeros(doc.max() + 1, bool)
    good[doc] = y > 0
    length = np.exp(own[:, 0].astype(np.float64))  # bytes and one: the first feature is their logarithm
    total = np.bincount(doc, length)
    part = length / total[doc]
    weight = part * np.bincount(doc)[doc]  # one on average
    shift = np.zeros(len(total))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per) - 1] = False
    inner = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
    line, pairs = y, None
    for step in range(1, rounds + 1):
        a = theta[-4:].reshape(2, 2)
        s = x @ theta[:-4]
        if step > alone and (step - alone) % every == 1:
            line, pairs = _expected(s + shift[doc] * weight, a, per, inner)
            share = np.bincount(doc, part * line)
            # dual steps: a shift grows while its document's share is on the wrong side, and never passes zero
            shift = np.where(good, np.clip(shift + 4 * (most - share), 0, 20), np.clip(shift - 4 * (share - little), -20, 0))
            line, pairs = _expected(s + shift[doc] * weight, a, per, inner)
        p, pair = _expected(s, a, per, inner)
        moves = np.zeros(4) if pairs is None else (pairs - pair).sum(0)
        grad = np.concatenate([x.T @ (line - p), moves]) / len(y) - ridge * theta
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad ** 2
        theta = theta + rate * (g1 / (1 - 0.9 ** step)) / (np.sqrt(g2 / (1 - 0.999 ** step)) + 1e-8)
    return LineField(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_docs: int = 4000, chain: int = 64, chains_per_doc: int = 8) -> LineField:
    """Fits the field on at most ``sample_docs`` labelled ids (smallest id hash
    first), each document cut into chains of ``chain`` lines of which up to
    ``chains_per_doc``, spread over the document, are used. An id labelled twice counts with
    its lower label, an id of several rows with the row of the smallest text hash; null
    labels and ids don't count. Labels of one kind alone say that of every line;
    without any, all lines have 0.5."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
              .where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))

    def run(batches):
        for b in slices(batches, most=_SLICE):
            own, _, per = line_features(b.column("text").to_pylist())
            size, data = [], []
            for f, n in zip((np.cumsum(per) - per).tolist(), per.tolist()):
                parts = -(-n // chain)
                used = sorted({int(q) for q in np.linspace(0, parts - 1, min(parts, chains_per_doc))})
                size.append([min(n, (c + 1) * chain) - c * chain for c in used])
                data.append(b"".join(own[f + c * chain:f + min(n, (c + 1) * chain)].tobytes() for c in used))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("hash"), pa.array(size, pa.list_(pa.int32())), pa.array(data, pa.binary())],
                                             ["doc_id", "y", "hash", "size", "data"])

    # the chosen ids are at most sample_docs rows; their chains are one row each
    rows = (pick(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("hash"), "text")
            .mapInArrow(run, "doc_id long, y int, hash long, size array<int>, data binary")
            .groupBy("doc_id").agg(F.min(F.struct("hash", "size", "data", "y")).alias("one")).select("doc_id", "one.y", "one.size", "one.data").toPandas())
    if not len(rows):
        return LineField(np.zeros(N_OWN), np.ones(N_OWN), np.zeros(3 * N_OWN + 1), np.zeros((2, 2)))
    rows = rows.sort_values("doc_id")  # the same order however the tasks end
    own = np.frombuffer(b"".join(rows["data"]), np.float32).reshape(-1, N_OWN)
    chains = rows["size"].map(len).to_numpy()
    return fit_field(own, np.concatenate(rows["size"].tolist()).astype(np.int64),
                     np.repeat((rows["y"].to_numpy() > 0).astype(np.int64), chains), np.repeat(rows["doc_id"].to_numpy(), chains))


def score(df: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score, predicted) for every row from the whole text: ``score``
    0 to 1, ``predicted`` 1 from 0.5 on.

    Null and empty texts are one empty line and get a score too. Repeated rows are
    scored one by one; an empty table gives no rows; extra columns are ignored.
    """
    def run(batches):
        for b in slices(batches, most=_SLICE):
            s = field.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return pick(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(df: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose document the field doesn't reject."""
    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        out, values, i = [], texts.tolist(), 0
        while i < len(values):
            n, j = 0, i
            while j < len(values) and (j == i or n < _SLICE):
                n += 3 * len(values[j] or "") + 64
                j += 1
            out.append(field.scores(values[i:j]))
            i = j
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return df.where(of(F.col(text_col).cast("string")) >= 0.5)
