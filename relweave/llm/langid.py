"""Language identification with interpolated Kneser-Ney character models.

Counts of character n-grams are taken from all labelled texts: every task counts
the grams of its texts with array operations, Spark adds them up by (language,
gram). The lower orders use continuation counts, the number of different
characters before a gram. Totals, back-off weights and interpolated probabilities
are grouped and joined by (language, gram). Each language's model is, for each
order, a sorted array of 64-bit keys with the log probability of every seen gram
and one with the back-off weight of every seen context. Tasks write the arrays in
shards to the shared folder, and executors map them, so the model grows with the
corpus and the driver doesn't hold it. A text's score is its mean cross-entropy
per character, and the lowest wins.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import publish_files, slices
from relweave.operators.windows import rank_in_group
from relweave.session import cut_lineage

_PAD = 2  # a code point that stands before the first character
_GRAMS, _WEIGHTS = 0, 1  # kinds of arrays
_MUL = np.uint64(0x9E3779B97F4A7C15)


def codes_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, ``order-1`` pads before each, runs of
    anything but letters folded into one blank; and the texts' first positions."""
    pad = chr(_PAD) * (order - 1)
    parts = [pad + t.lower() for t in texts]
    joined = "".join(parts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    kinds, inverse = _uniques(c)
    letter = np.array([chr(x).isalpha() or unicodedata.category(chr(x))[0] == "M" or x == _PAD for x in kinds.tolist()])
    folded = np.where(letter, kinds, 32).astype(np.uint32)[inverse]
    blank = folded == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[0] = True
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _uniques(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inverse, kinds = pd.factorize(a)
    return kinds, inverse


def gram_keys(c: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order 1..n the 64-bit keys of the grams ending at each position."""
    keys = [c.astype(np.uint64)]
    for k in range(1, order):
        longer = np.zeros(len(c), np.uint64)
        older = c[:-k].astype(np.uint64) if k < len(c) else c[:0].astype(np.uint64)
        longer[k:] = older
        keys.append(_mix(keys[-1] * _MUL + longer + np.uint64(k)))
    return keys


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def count_grams(df: DataFrame, order: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): the texts' grams of the highest order, over whole texts."""
    def run(batches):
        for b in slices(batches):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs) if x == lang and t]
                if not mine:
                    continue
                c, starts = codes_of(mine, order)
                key = gram_keys(c, order)[-1]
                real = np.ones(len(c), bool)
                for k in range(order - 1):
                    real[starts[:-1] + k] = False  # pads are context only
                at = np.flatnonzero(real)
                if not len(at):
                    continue
                inverse, kinds = pd.factorize(key[at])
                first = np.empty(len(kinds), np.int64)
                first[inverse[::-1]] = at[::-1]
                grams = c[first[:, None] + np.arange(1 - order, 1)].astype(np.uint32)
                text = grams.tobytes().decode("utf-32-le", "replace")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kinds), pa.string()), pa.array([text[i:i + order] for i in range(0, len(text), order)], pa.string()),
                     pa.array(np.bincount(inverse, minlength=len(kinds)))], ["lang", "gram", "n"])

    return (df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
            .where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """For each order 1..n (lang, gram, c): counts at the top, continuation counts below."""
    levels = [counts.select("lang", "gram", F.col("n").alias("c"))]
    for k in range(order - 1, 0, -1):
        up = levels[0]
        levels.insert(0, cut_lineage(up.groupBy("lang", F.expr(f"substr(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("c"))))
    return levels


@functools.lru_cache(8)
def _mapped(files: tuple[str, ...]) -> dict:
    """The arrays of all shards, mapped: (kind, language, order) -> (first keys, [(keys, logs)])."""
    found: dict = {}
    for name in files:
        data = np.memmap(SparkFiles.get(name), np.uint8, "r")
        at = 0
        while at < len(data):
            n, kind, k, size = data[at:at + 32].view(np.int64).tolist()
            lang = bytes(data[at + 32:at + 32 + size]).decode()
            at += 32 + -(-size // 8) * 8
            keys, logs = data[at:at + 8 * n].view(np.uint64), data[at + 8 * n:at + 16 * n].view(np.float64)
            found.setdefault((kind, lang, k), []).append((keys, logs))
            at += 16 * n + 8
    for key, shards in found.items():
        shards.sort(key=lambda x: x[0][0])
        found[key] = (np.array([x[0][0] for x in shards], np.uint64), shards)
    return found


@dataclass
class LanguageModels:
    """``files``: the shards of sorted arrays, for language and order (keys, log p)
    and for language and context order (keys, log weight). ``cut``: highest
    plausible cross-entropy."""

    order: int
    langs: list[str]
    files: tuple[str, ...]
    floor: dict
    cut: dict | None = None
    slope: float = 8.0

    def _find(self, table, keys, missing):
        out, hits = np.full(len(keys), missing), np.zeros(len(keys), bool)
        if table is None:
            return out, hits
        firsts, shards = table
        of = np.searchsorted(firsts, keys, "right") - 1
        turn = np.argsort(of, kind="stable")
        for mine in np.split(turn, np.flatnonzero(np.diff(of[turn])) + 1) if len(keys) else ():
            k, v = shards[of[mine[0]]]
            want = keys[mine]
            at = np.minimum(np.searchsorted(k, want), len(k) - 1)
            hit = k[at] == want
            out[mine], hits[mine] = np.where(hit, v[at], missing), hit
        return out, hits

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Mean negative log probability per character: a row per text, a column per language."""
        n = self.order
        c, starts = codes_of(texts, n)
        keys = gram_keys(c, n)
        real = np.ones(len(c), bool)
        for k in range(n - 1):
            real[np.minimum(starts[:-1] + k, len(c) - 1)] = False
        inverse, kinds = pd.factorize(keys[-1])
        first = np.empty(len(kinds), np.int64)
        first[inverse[::-1]] = np.arange(len(c))[::-1]
        mine = [k[first] for k in keys]
        back = [np.concatenate([k[:1], k[:-1]])[first] for k in keys[:-1]]
        tables = _mapped(self.files).get
        out = np.zeros((len(texts), len(self.langs)))
        counts = np.maximum(1, np.add.reduceat(np.append(real, False), starts[:-1]))
        for j, lang in enumerate(self.langs):
            logp = np.full(len(kinds), self.floor[lang])
            for k in range(1, n + 1):  # unseen at an order: the context's weight times the order below
                w = self._find(tables((_WEIGHTS, lang, k - 1)), back[k - 2], 0.0)[0] if k > 1 else 0.0
                value, hit = self._find(tables((_GRAMS, lang, k)), mine[k - 1], 0.0)
                logp = np.where(hit, value, logp + w)
            each = np.append(np.where(real, logp[inverse], 0.0), 0.0)
            out[:, j] = -np.add.reduceat(each, starts[:-1]) / counts
        return out

    def predict(self, texts: list[str | None], reject: bool = True) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text; ``und`` with score 0 if there is no letter."""
        has = [bool(t) and any(ch.isalpha() for ch in t) for t in texts]
        out = [("und", 0.0, True)] * len(texts)
        at = [i for i, x in enumerate(has) if x]
        if not at or not self.langs:
            return out
        h = self.entropies([texts[i] for i in at])
        best = h.argmin(1)  # ties: the language first by name
        p = 1.0 / np.exp(np.clip(self.slope * (h.min(1, keepdims=True) - h), -700, 0)).sum(1)
        for r, i in enumerate(at):
            lang = self.langs[best[r]]
            out[i] = (lang, float(p[r]), bool(reject and self.cut is not None and h[r, best[r]] > self.cut[lang]))
        return out


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = 4, discount: float = 0.75,
        shard_entries: int = 1 << 18, sample_rows: int | None = None, reject_share: float = 0.001) -> LanguageModels:
    """Learns the models from all rows with a language and a text.

    Every gram is kept under its 64-bit key, 16 bytes an entry. ``shard_entries``:
    about so many entries lie in a shard, which one task sorts. The rejection cut is
    calibrated on all these rows, at the quantile that rejects ``reject_share`` of a
    language's own texts; with ``sample_rows`` on about so many sampled ones.
    """
    levels = _levels(cut_lineage(count_grams(df, order, lang_col, text_col)), order)
    sizes, floor = {}, {}
    below, entries = None, []
    for k, level in enumerate(levels, 1):
        # a language's contexts; of order 0 the empty one
        sums = level.groupBy("lang", F.expr(f"substr(gram, 1, {k - 1})").alias("ctx")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        if k == 1:
            for r in sums.collect():  # 1 share for unseen characters
                floor[r.lang] = float(np.log(discount * r.kinds / r.total / (r.kinds + 1)))
        else:
            entries.append(_entry(sums, _WEIGHTS, k - 1, "ctx", F.lit(discount) * F.col("kinds") / F.col("total")))
        sizes |= {(r.lang, k): r["count"] for r in level.groupBy("lang").count().collect()}
        rows = level.withColumn("ctx", F.expr(f"substr(gram, 1, {k - 1})")).join(sums, ["lang", "ctx"])
        if k > 1:
            rows = rows.withColumn("suffix", F.expr(f"substr(gram, 2, {k - 1})")).join(below, ["lang", "suffix"])
        lower = F.col("lower") if k > 1 else 1 / (F.col("kinds") + 1)
        p = (F.greatest(F.col("c") - F.lit(discount), F.lit(0.0)) + F.lit(discount) * F.col("kinds") * lower) / F.col("total")
        level = rows.select("lang", "gram", p.alias("p"))
        level = cut_lineage(level) if k < order else level
        below = level.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        entries.append(_entry(level, _GRAMS, k, "gram", F.col("p")))
    files = _write(functools.reduce(DataFrame.unionByName, entries), sizes, shard_entries) if floor else ()
    model = LanguageModels(order, sorted(floor), files, floor)
    return _calibrated(model, df, lang_col, text_col, sample_rows, reject_share)


def _entry(rows: DataFrame, kind: int, k: int, gram: str, value) -> DataFrame:
    return rows.select("lang", F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.col(gram).alias("gram"), F.log(value).alias("log"))


def _write(entries: DataFrame, sizes: dict, shard_entries: int) -> tuple[str, ...]:
    """Writes the entries as shards of sorted arrays, cut by the keys' first bits."""
    bits = {x: max(0, -(-n // shard_entries) - 1).bit_length() for x, n in sizes.items()}
    # all shards are numbered, and dealt to tasks by their number
    base, shards = {}, 0
    for (lang, k), b in sorted(bits.items()):
        for kind in (_GRAMS, _WEIGHTS):
            base[lang, kind, k - kind] = shards
            shards += 1 << b
    tasks = min(shards, 512)

    def keyed(batches):
        for b in batches:
            t = b.to_pandas()
            for (lang, kind, k), x in t.groupby(["lang", "kind", "k"]):
                key = _keys_of(np.frombuffer("".join(x["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, k))
                top = bits[lang, k + kind]
                shard = (key >> np.uint64(64 - top)).astype(np.int64) if top and k > 1 else np.zeros(len(key), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(np.full(len(x), kind, np.int32)), pa.array(np.full(len(x), k, np.int32)),
                                                  pa.array(shard), pa.array(key.view(np.int64)), pa.array(x["log"].to_numpy()),
                                                  pa.array(((base[lang, kind, k] + shard) % tasks).astype(np.int32))],
                                                 ["lang", "kind", "k", "shard", "key", "log", "task"])

    def packed(batches):
        of, held = None, []
        for b in batches:
            t = b.to_pandas()
            for x, rows in t.groupby(["lang", "kind", "k", "shard"], sort=False):
                if of is not None and x != of:
                    yield _block(of, held)
                    held = []
                of = x
                held.append((rows["key"].to_numpy().view(np.uint64), rows["log"].to_numpy()))
        if held:
            yield _block(of, held)

    group = ["lang", "kind", "k", "shard"]
    rows = entries.mapInArrow(keyed, "lang string, kind int, k int, shard long, key long, log double, task int")
    rows = rows.repartitionById(tasks, "task").drop("task").sortWithinPartitions(*group).mapInArrow(packed, "data binary")
    return publish_files(rows, "data", f"langid-{uuid.uuid4().hex}")


def _block(of: tuple, held: list) -> pa.RecordBatch:
    """One shard: entries, kind, order, bytes of the language's name, the name, keys
    and logs, each from a multiple of 8; with the line end behind it the next one is too."""
    lang, kind, k, _ = of
    name = lang.encode()
    keys, logs = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys)
    head = np.array([len(keys), kind, k, len(name)], np.int64).tobytes() + name + bytes(-len(name) % 8)
    return pa.RecordBatch.from_arrays([pa.array([head + keys[order].tobytes() + logs[order].tobytes() + bytes(7)], pa.binary())], ["data"])


def _keys_of(grid: np.ndarray) -> np.ndarray:
    """Keys of whole grams, equal to what gram_keys gives at a gram's last position."""
    n = grid.shape[1]
    key = grid[:, -1].astype(np.uint64)
    for k in range(1, n):
        key = _mix(key * _MUL + grid[:, n - 1 - k].astype(np.uint64) + np.uint64(k))
    return key


def _calibrated(model: LanguageModels, df: DataFrame, lang_col: str, text_col: str, rows: int | None, share: float) -> LanguageModels:
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in slices(batches):
            langs = b.column("lang").to_pylist()
            h = m.entropies([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(h[np.arange(len(h)), [m.langs.index(x) for x in langs]])], ["lang", "h"])

    known = (df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
             .where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("lang").isin(model.langs)))
    if rows is not None:
        known = known.sample(min(1.0, rows / max(1, known.count())), seed=7)
    model.cut = {x: float("inf") for x in model.langs}
    for lang, (q, middle) in quantiles(known.mapInArrow(run, "lang string, h double"), "lang", "h", (1 - share, 0.5)).items():
        # the quantile, and a margin of its distance from the middle
        model.cut[lang] = q + (q - middle)
    return model


def quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...]) -> dict:
    """Exact quantiles of each group's values, between two neighbours in proportion. Rows are
    numbered in a sort over many tasks; a few of each group come to the driver."""
    # checkpointed: the borders of the sort's ranges read the values once more
    ranked = rank_in_group(cut_lineage(df.select(group, value)), group, [value], out="rn")
    sizes = {r[group]: r["n"] for r in ranked.groupBy(group).agg(F.max("rn").alias("n")).collect()}
    wanted = {g: [(n - 1) * x for x in at] for g, n in sizes.items()}
    asked = F.lit(False)
    for g, places in wanted.items():
        asked = asked | ((F.col(group) == g) & F.col("rn").isin(sorted({min(int(p) + k, sizes[g] - 1) + 1 for p in places for k in (0, 1)})))
    found = {(r[group], r["rn"]): r[value] for r in ranked.where(asked).collect()}
    out = {}
    for g, places in wanted.items():
        ends = [(found[g, int(p) + 1], found[g, min(int(p) + 1, sizes[g] - 1) + 1], p - int(p)) for p in places]
        out[g] = tuple(low + (high - low) * part for low, high, part in ends)
    return out


def predict(df: DataFrame, model: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, from the whole text.

    ``lang_pred`` is the language of lowest cross-entropy (ties: first by name),
    ``und`` for null texts, texts without a letter and models without languages;
    ``score`` its share against the other languages; ``rejected`` says that the
    text fits none of them by the calibrated cut. Repeated rows are answered one
    by one; an empty table gives no rows; extra columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in slices(batches):
            got = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                                              pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
