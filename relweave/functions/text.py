"""Scalar text expressions (G1-G5, G13-G24, B13) as Spark Column builders.

Every builder returns a JVM-side expression so that whole-stage codegen and
predicate pushdown keep working; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
NULL_MARKER = "#"                      # missing cell marker in extracted values
NULL_WORDS = ("none", "null", "na")    # ground-truth texts treated as empty
NAN_WORD = "nan"                       # pandas' text for a missing value


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Python ``str.strip()``: all leading/trailing white space, not only blanks."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def split_lines(x) -> Column:
    """Paragraph split on newline; blank paragraphs are kept."""
    return F.split(_c(x), "\n")


def split_sentences(x) -> Column:
    """Split after a period followed by white space, strip, drop blanks."""
    return F.filter(F.transform(F.split(_c(x), r"(?<=\.)\s+"), strip_ws),
                    lambda s: s != F.lit(""))


def join_sentences(arr) -> Column:
    """Join with one space and end with a period unless empty."""
    j = F.array_join(F.filter(_c(arr), lambda s: s != F.lit("")), " ")
    return F.regexp_replace(j, r"\z(?<=[^.])", ".")


def render_value(x) -> Column:
    """Value as written into a sentence: stripped, outer single quotes removed,
    lower-cased; NULL when missing or the text ``nan`` (G1)."""
    s = strip_ws(_c(x).cast("string"))
    return F.when(_c(x).isNull() | (F.lower(s) == NAN_WORD), F.lit(None)) \
        .otherwise(F.lower(F.regexp_replace(s, r"^'+|'+$", "")))


def row_to_sentence(cols: list[str]) -> Column:
    """``"col is value, ..."`` over the given columns, trailing ``, `` removed,
    a period appended (G1). Missing values are skipped."""
    parts = [F.concat(F.lit(c.lower() + " is "), render_value(c)) for c in cols]
    body = F.concat(F.concat_ws(", ", *parts), F.lit(", "))
    return F.concat(F.regexp_replace(body, r"[, ]+$", ""), F.lit("."))


def truth_value(x) -> Column:
    """Ground-truth value of a cell: lower-cased text, NULL when missing."""
    s = F.lower(_c(x).cast("string"))
    return F.when(_c(x).isNull() | (s == NAN_WORD), F.lit(None)).otherwise(s)


# Fixed value: numbers with a sign, a dollar sign and thousands commas.
NUMBER_RE = r"^-?\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"


def is_number(x) -> Column:
    """Parse ``-$1,234.56`` style numbers to double, else NULL."""
    t = F.trim(_c(x))
    return F.when(t.rlike(NUMBER_RE),
                  F.regexp_replace(t, r"[$,]", "").try_cast("double"))


def md5_key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[_c(p) if not isinstance(p, (int, float)) else F.lit(str(p)) for p in parts]))


def hash_u32(*parts) -> Column:
    """First 32 bits of md5 over ``'|'``-joined parts, as BIGINT."""
    return F.conv(F.substring(md5_key(*parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Deterministic uniform number in [0, 1)."""
    return hash_u32(*parts) / F.lit(4294967296.0)


def hash_between(lo: int, hi: int, *parts) -> Column:
    """Deterministic integer in [lo, hi]."""
    return F.lit(lo) + F.pmod(hash_u32(*parts), F.lit(hi - lo + 1))


def domain_from_key(x) -> Column:
    """Text before the first underscore."""
    return F.split_part(_c(x), F.lit("_"), F.lit(1))


# Ordered substring tests for domain and difficulty.
DOMAIN_RULES = [
    ("education", "education", "medium"),
    ("tourism", "tourism", "easy"),
    ("ecommerce", "ecommerce", "medium"),
    ("healthcare", "healthcare", "hard"),
    ("finance", "finance", "medium"),
]


def domain_from_path(x, rules=DOMAIN_RULES) -> tuple[Column, Column]:
    dom, dif = F.lit(None).cast("string"), F.lit(None).cast("string")
    for needle, d, k in reversed(rules):
        hit = F.instr(_c(x), needle) > 0
        dom = F.when(hit, F.lit(d)).otherwise(dom)
        dif = F.when(hit, F.lit(k)).otherwise(dif)
    return dom, dif


def materialize(df, keep: list[str], **named: Column):
    """Evaluate ``named`` expressions once per row and expose them as plain
    columns. A one-element ``inline`` is a Generate node, which projection
    collapsing cannot see through; without it an array expression referenced
    inside a lambda is re-evaluated for every element."""
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(k) for k, e in named.items()]))))


def finalize(df):
    """Normalise output types for comparison: integers as BIGINT, floating
    values rounded to 6 digits."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("integer", "short", "byte"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif t in ("double", "float"):
            out.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
