"""Deterministic text noise (G6-G11) as array expressions over one text's
sentence array.

Every choice the reference draws from a seeded RNG is drawn from ``md5`` of
(seed, text id, sentence position) instead, so results do not depend on
partitioning or on the order rows are processed, and an SQL engine can repeat
them. All work stays inside one row: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
# Noise levels and noise type names.
LEVELS = {"L1": 0.10, "L2": 0.30, "L3": 0.60}
TYPES = ["type1_contradictory", "type2_missing", "type3_duplicates", "type4_structural"]

# Python's \b around \w, written with explicit classes so Java and RE2 agree.
_PRE = r"(?s)^((?:.*?[^\pL\pN_])??)"
_POST = r"(?:[^\pL\pN_]|$)"
YEAR_RE = _PRE + r"((?:19|20)\d{2})" + _POST
ZIP_RE = _PRE + r"(\d{5})" + _POST
NUM_RE = _PRE + r"(\d{2,})" + _POST

# Honorifics dropped and institution suffixes shortened (type 3).
HONORIFICS = [r"(?U)\bMr\.\s+", r"(?U)\bMrs\.\s+", r"(?U)\bMs\.\s+", r"(?U)\bDr\.\s+", r"(?U)\bProf\.\s+"]
SUFFIXES = [
    (r"(?U)\bHigh School\b", "High"),
    (r"(?U)\bElementary School\b", "Elementary"),
    (r"(?U)\bMiddle School\b", "Middle"),
    (r"(?U)\bUnified School District\b", "Unified"),
    (r"(?U)\bSchool District\b", "District"),
]
COUNTY_RE = r"(?U)\b(\w+)\s+County\b"
# What a sentence holds that type 1 or 3 can change: two digits in a row; one of these.
DIGITS_RE = r"\d\d"
MARKS = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "School", "County"]


def _h(tag: str, src: Column, tid: Column, i: Column) -> Column:
    parts = [F.lit(tag), F.lit(str(SEED)), src.cast("string"), tid.cast("string"), i.cast("string")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def sentence_hashes(sents: Column, src: Column, tid: Column) -> Column:
    """Sampling key per sentence: ``md5('42|src|id|pos')``."""
    return F.transform(sents, lambda s, i: F.md5(F.concat_ws(
        "|", F.lit(str(SEED)), src.cast("string"), tid.cast("string"), i.cast("string"))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: interpreted lambdas repeat what they name twice."""
    return F.get(F.transform(F.array(value), use), 0)


def n_picked(n: Column, level: float) -> Column:
    """``max(1, round_half_even(n * level))``."""
    return F.greatest(F.lit(1), F.bround(n.cast("double") * F.lit(float(level)), 0).cast("int"))


def picked_flags(hashes: Column, level: float, sorted_hashes: Column | None = None) -> Column:
    """Boolean per sentence: among the ``k`` smallest hashes, or all if k >= n.
    Picks are nested across levels (the k smallest for a growing k), so one
    sorted copy of the hashes serves every level."""
    n = F.size(hashes)
    k = n_picked(n, level)
    srt = sorted_hashes if sorted_hashes is not None else F.array_sort(hashes)
    # worked out once for a text; null: all are picked
    thr = F.when(k >= n, F.lit(None).cast("string")).otherwise(F.element_at(srt, k))
    return _let(thr, lambda t: F.transform(hashes, lambda h: t.isNull() | (h <= t)))


def _bump(s: Column, pattern: str, delta: Column) -> Column:
    pre = F.regexp_extract(s, pattern, 1)
    num = F.regexp_extract(s, pattern, 2)
    new = (num.cast("decimal(38,0)") + delta.cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")
    return F.concat(pre, new, F.substr(s, F.length(pre) + F.length(num) + 1))


def type1(sents: Column, picked: Column, src: Column, tid: Column) -> Column:
    """Contradictory facts: in a picked sentence change the first year
    (+1..10), else the first 5-digit number (+10..99), else the first number of
    2+ digits (+5..50), at the match position (Q18 fixed)."""
    def one(s, i):
        h = _h("t1", src, tid, i)
        return (F.when(~F.get(picked, i) | ~s.rlike(DIGITS_RE), s)
                .when(s.rlike(YEAR_RE), _bump(s, YEAR_RE, F.lit(1) + F.pmod(h, F.lit(10))))
                .when(s.rlike(ZIP_RE), _bump(s, ZIP_RE, F.lit(10) + F.pmod(h, F.lit(90))))
                .when(s.rlike(NUM_RE), _bump(s, NUM_RE, F.lit(5) + F.pmod(h, F.lit(46))))
                .otherwise(s))
    return F.transform(sents, one)


def type2(sents: Column, picked: Column) -> Column:
    """Missing values: drop picked sentences; fewer than 2 left keeps the first
    two of the original."""
    kept = F.filter(sents, lambda s, i: ~F.get(picked, i))
    return _let(kept, lambda k: F.when(F.size(k) < 2, F.slice(sents, 1, 2)).otherwise(k))


def type3(sents: Column, picked: Column, src: Column, tid: Column) -> Column:
    """Duplicate entities: drop honorifics, shorten institution suffixes, and
    with probability 1/2 drop ``County``."""
    def one(s, i):
        x = s
        for p in HONORIFICS:
            x = F.regexp_replace(x, p, "")
        for p, r in SUFFIXES:
            x = F.regexp_replace(x, p, r)
        coin = _h("t3", src, tid, i) / F.lit(4294967296.0)
        x = F.when(coin < 0.5, F.regexp_replace(x, COUNTY_RE, "$1")).otherwise(x)
        marked = F.lit(False)
        for m in MARKS:
            marked = marked | s.contains(m)
        return F.when(F.get(picked, i) & marked, x).otherwise(s)
    return F.transform(sents, one)


def _swap(w: Column, h: Column) -> Column:
    def moved(sp):
        return F.concat(F.substring(w, 1, sp), F.substring(w, sp + 2, 1), F.substring(w, sp + 1, 1), F.substr(w, sp + 3))

    ae = F.length(F.regexp_replace(w, r"\PL+$", ""))
    return _let(ae, lambda n: F.when(n > 2, _let(F.pmod(h, n - 1).cast("int"), moved)).otherwise(w))


def type4(sents: Column, picked: Column, src: Column, tid: Column) -> Column:
    """Structural: for a picked sentence of 3+ words swap two neighbouring
    letters in one word's leading letters, and drop one inner word when it has
    more than 3 words; words rejoined by one space."""
    def one(s, i):
        def changed(words):
            nw = F.size(words)
            # slices instead of a lambda for every word
            def swapped(at):
                return F.concat(F.slice(words, 1, at), F.array(_swap(F.get(words, at), _h("t4s", src, tid, i))), F.slice(words, at + 2, nw))
            dropped = lambda w: _let(F.lit(1) + F.pmod(_h("t4d", src, tid, i), nw - 2).cast("int"), lambda at: F.concat(F.slice(w, 1, at), F.slice(w, at + 2, nw)))
            w2 = _let(F.pmod(_h("t4w", src, tid, i), nw).cast("int"), swapped)
            return F.when(nw < 3, s).otherwise(F.array_join(_let(w2, lambda w: F.when(nw > 3, dropped(w)).otherwise(w)), " "))
        # a single blank is split at without a regular expression
        return F.when(F.get(picked, i), _let(F.split(F.regexp_replace(s, r"\s+", " "), " "), changed)).otherwise(s)
    return F.transform(sents, one)


def apply_noise(kind: str, sents: Column, picked: Column, src: Column, tid: Column) -> Column:
    if kind == "type1_contradictory":
        return type1(sents, picked, src, tid)
    if kind == "type2_missing":
        return type2(sents, picked)
    if kind == "type3_duplicates":
        return type3(sents, picked, src, tid)
    if kind == "type4_structural":
        return type4(sents, picked, src, tid)
    raise ValueError(kind)


def noise_levels(kind: str, sents: Column, picked: dict[str, Column], at_top: Column) -> dict[str, Column]:
    """The noisy sentences of every level from ``at_top``, those of the highest
    one: picks are nested and what a sentence becomes doesn't depend on the level, so it is
    rewritten once. Type 2 drops other sentences at each level."""
    if kind == "type2_missing":
        return {name: type2(sents, p) for name, p in picked.items()}
    top = max(picked, key=lambda name: LEVELS[name])

    def lower(p):
        return F.transform(sents, lambda s, i: F.when(F.get(p, i), F.get(at_top, i)).otherwise(s))

    return {name: at_top if name == top else lower(p) for name, p in picked.items()}


def n_modified(kind: str, sents: Column, noisy: Column, picked: Column | None = None) -> Column:
    """Perturbation accounting (D20): removed count for type 2, else the number
    of positions whose text changed; with ``picked`` only of those flagged, so that
    the sentences of the highest level serve the lower ones."""
    if kind == "type2_missing":
        return F.size(sents) - F.size(noisy)
    if picked is None:
        changed = F.filter(sents, lambda s, i: s != F.get(noisy, i))
    else:
        changed = F.filter(sents, lambda s, i: F.get(picked, i) & (s != F.get(noisy, i)))
    return F.when(sents.isNotNull(), F.size(changed))
