"""Reading Python literals inside model answers.

A text is cut into quoted strings and what lies between them, so that brackets,
commas, ``None`` and ``True`` inside a string stay text. A quote opens a string
only behind a bracket, comma, colon or equals sign, and closes it only before a
bracket, comma, colon or the end; any other quote or apostrophe belongs to the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPENS, _CLOSES = r"(?<=[\[{(,:=]\s{0,8})", r"(?!\s*(?:[,:}\])]|$))"
_STRINGS = "|".join(rf"{_OPENS}{q}(?:[^{q}\\]++|\\.|{q}{_CLOSES})*+{q}" for q in "'\"")
_TOKEN = rf"(?s){_STRINGS}|[^'\"]++|['\"]"
#: Structure characters and what stands for them inside strings (private use code points).
_STRUCTURE, _GUARDS = "[]{}`", "\ue000\ue001\ue002\ue003\ue004"


def tokens(text: Column) -> Column:
    """Quoted strings, with their quotes, and the pieces between them, in order."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _quoted(t: Column) -> Column:
    return (F.length(t) >= 2) & (t.startswith("'") | t.startswith('"'))


def guarded(text: Column) -> Column:
    """The text with structure characters inside strings replaced, for patterns that
    look for brackets or fences; :func:`unguarded` undoes it."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(_quoted(t), F.translate(t, _STRUCTURE, _GUARDS)).otherwise(t)), "")


def unguarded(text: Column) -> Column:
    return F.translate(text, _GUARDS, _STRUCTURE)


def to_json(text: Column) -> Column:
    """JSON for a Python or JSON literal: strings in double quotes, None, True and
    False outside strings in JSON's words, an empty string behind a colon as null."""
    def string(t):
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        body = F.regexp_replace(body, r"\\'", "'")
        body = F.regexp_replace(body, r'(\\.)|(")', r'$1$2')
        # a bare double quote gets a backslash; one that has it keeps it
        return F.concat(F.lit('"'), F.regexp_replace(body, r'(?<!\\)"', r'\\"'), F.lit('"'))

    def plain(t):
        for word, meant in (("None", "null"), ("True", "true"), ("False", "false")):
            t = F.regexp_replace(t, rf"\b{word}\b", meant)
        return t

    ts = tokens(text)
    out = F.transform(ts, lambda t, i: F.when(~_quoted(t), plain(t)).when((F.length(t) == 2) & F.get(ts, i - 1).rlike(r":\s*$"), F.lit("null")).otherwise(string(t)))
    return F.array_join(out, "")


def last_list(text: Column) -> Column:
    """The last list of objects in a text; one that was cut gets its closing bracket."""
    rest = F.regexp_extract(guarded(text), r"(?s)^.*(\[\s*\{.*)$", 1)
    whole = F.regexp_extract(rest, r"(?s)^(\[\s*\{.*?\}\s*\])", 1)
    return unguarded(F.when(whole != "", whole).when(rest != "", F.concat(F.regexp_replace(rest, r"\s+\z", ""), F.lit("]"))))
