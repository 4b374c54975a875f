"""Text functions: preprocessing in Python and as columns, white space, placeholders."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_spaced_digits = re.compile(r"(?:\d\s){5,}\d")
#: Digits of joined fields of a payment form -> digits of the first one.
JOINED = {30: 10, 29: 9, 32: 12}
PLACEHOLDER = r"\[[^\[\]\s]+_\d+\]"


def preprocess(text: str) -> str:
    """Compose letters (NFC), join runs of single-spaced digits and split known joined fields again."""
    composed = unicodedata.normalize("NFC", text)
    runs = [x.replace(" ", "") for x in _spaced_digits.findall(composed)]
    if not runs:
        return composed
    fields = [" ".join(filter(None, (x[: JOINED[len(x)]], x[JOINED[len(x)] :]))) if len(x) in JOINED else x for x in runs]
    return "".join(map("".join, zip(_spaced_digits.split(composed), [*fields, ""])))


@lru_cache(1)
def not_composed() -> str:
    """A class of all characters that stand in no composed text, or may compose with one before them."""
    seconds = {int(d[1], 16) for d in (unicodedata.decomposition(chr(c)).split() for c in range(0x110000)) if len(d) == 2 and d[0][0] != "<"}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    found = [c for c in range(0x110000) if c in seconds or c in jamo or not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)))]
    found = [c for c in found if c >= 128]
    bounds = [k for k in range(1, len(found)) if found[k] != found[k - 1] + 1]
    return "[" + "".join(f"\\x{{{found[a]:X}}}-\\x{{{found[b - 1]:X}}}" for a, b in zip([0, *bounds], [*bounds, len(found)])) + "]"


#: Letters and signs that stand in composed text whatever comes before them: most of what there is, so looked at first.
COMPOSED = r"\x{0}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{590}\x{2010}-\x{20CF}\x{4E00}-\x{9FFF}"


def may_be_loose(text: Column) -> Column:
    """Whether the text holds a character that composed text lacks or that may compose with the one before it."""
    return F.coalesce(text.rlike(f"[[^{COMPOSED}]&&{not_composed()}]"), F.lit(False))


def rebuilt(text: Column, pattern: str, change) -> Column:
    """The text with each match of the pattern changed by a function of its column."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(gaps, F.transform(found, change), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")).otherwise(text)


def collapse_digits(text: Column) -> Column:
    """The digit part of `preprocess`, as a column."""

    def joined(m: Column) -> Column:
        digits = F.replace(m, F.lit(" "), F.lit(""))
        out = digits
        for n, head in JOINED.items():
            out = F.when(F.length(digits) == n, F.concat(F.substring(digits, 1, head), F.lit(" "), F.substring(digits, head + 1, n))).otherwise(out)
        return out

    return rebuilt(text, r"(?Ud)(?:\d\s){5,}\d", joined)


def squeezed(text: Column) -> Column:
    """White space runs made one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
