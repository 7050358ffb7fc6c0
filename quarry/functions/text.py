"""Scalar text functions, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points Python's str.split() / str.strip() treat as whitespace.
# Java's \s only covers [ \t\n\x0B\f\r]; the rest are listed explicitly.
WS_CLASS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS = WS_CLASS + "+"
# The same set split in two: Java's \s (ASCII) and the other code points, which
# ``translate`` maps to a space before a plain \s+ split (native, much faster than a
# regex over the full class). Fixed values as above.
_OTHER_WS = ("\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
             "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c) -> Column:
    """Lower-case and split on runs of Unicode whitespace, dropping empty strings.

    Same tokens as Python's ``text.lower().split()``: punctuation stays attached,
    no stemming, no stop words. Empty strings can only appear at the ends (leading or
    trailing whitespace) and are removed with the native ``array_remove``.
    """
    text = F.translate(F.lower(_col(c)), _OTHER_WS, " " * len(_OTHER_WS))
    return F.array_remove(F.split(text, r"\s+"), "")


def py_strip(c) -> Column:
    """Strip leading and trailing Unicode whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(_col(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(c) -> Column:
    """True when the text is null or only whitespace."""
    return F.coalesce(py_strip(c) == F.lit(""), F.lit(True))


def prefix_key(c, n: int = 100) -> Column:
    """First ``n`` characters (code points) of the text, used as the fusion identity."""
    return F.substring(_col(c), 1, n)


def py_list_literal(items_col) -> Column:
    """Render an array<string> the way Python prints a list of str: ``['a', 'b']``."""
    return F.concat(F.lit("["),
                    F.coalesce(F.concat(F.lit("'"), F.array_join(_col(items_col), "', '"), F.lit("'")),
                               F.lit("")),
                    F.lit("]"))
