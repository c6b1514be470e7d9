"""String expressions shared by several operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters Python's str.strip() removes by default
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
TOKEN_PATTERN = "[\\p{L}]+"


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(c, f"^{ws}+|{ws}+$", "")


def normalise_answer(c: Column) -> Column:
    """Lower-case and strip (answer normalisation)."""
    return py_strip(F.lower(c))


def tokens(c: Column) -> Column:
    """Letter-run tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def json_string_length(c: Column) -> Column:
    """Length of ``json.dumps(s)`` without the surrounding quotes.

    ASCII-escaped encoding: quote, backslash and the five short escapes take
    two characters, any other character outside 0x20-0x7e takes six, and a
    character outside the basic plane takes twelve (a surrogate pair).
    """
    short = F.regexp_count(c, F.lit('[\\\\"\\n\\r\\t\\x08\\x0c]'))
    other = F.regexp_count(c, F.lit('[^\\x20-\\x7e]'))
    astral = F.regexp_count(c, F.lit('[\\x{10000}-\\x{10FFFF}]'))
    ctrl_short = F.regexp_count(c, F.lit('[\\n\\r\\t\\x08\\x0c]'))
    # short escapes are also "outside 0x20-0x7e" when control characters:
    # they cost 2, not 6, so remove them from the six-character class.
    return (F.length(c) + short + F.lit(5) * (other - ctrl_short)
            + F.lit(6) * astral)
