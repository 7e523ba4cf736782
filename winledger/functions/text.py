"""Text columns. Patterns use Unicode classes, as the log format's own tools do."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as text handling in the log format sees it, as characters and as the
# inside of a character class.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"

# Variable parts of a prompt and their placeholders, applied in this order.
VARIABLES = (
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"),
    (r"(?U)https?://\S+", "<url>"),
    (r"(?U)\d{4}-\d{2}-\d{2}([T ][\d:.]+Z?)?", "<ts>"),
    (r"(?U)\d+", "<n>"),
)


def strip_blank(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


def slugify(c: Column, max_len: int = 128) -> Column:
    """A safe identifier: unexpected characters become '-', none at the ends, capped, never empty."""
    dashed = F.regexp_replace(strip_blank(c), r"[^A-Za-z0-9.:/+_-]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, max_len)
    return F.coalesce(F.regexp_replace(cut, r"^\z", "unknown"), F.lit("unknown"))


def strip_variables(c: Column) -> Column:
    """Replace ids, addresses, links, dates and numbers, leaving the prompt template."""
    for pattern, placeholder in VARIABLES:
        c = F.regexp_replace(c, pattern, placeholder)
    return c


def fingerprint(c: Column, salt: str) -> Column:
    """Salted SHA-256. Read the salt from a secret store; it must not be logged or exported."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(salt), c), 256))


def last_line(c: Column) -> Column:
    """The last line of the stripped text, NULL when it is blank."""
    text = strip_blank(c)
    return F.when(text != "", F.element_at(F.split(text, LINE_BREAK), -1))


def to_number(c: Column) -> Column:
    """A number written with optional thousands commas and percent sign, else NULL."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, ",", ""), r"%+\z", ""))
    shaped = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
    return F.when(shaped, plain.try_cast("double"))


def close(a: Column, b: Column) -> Column:
    """Within one percent of ``b``, or 0.01 for small values."""
    return F.abs(a - b) <= 0.01 * F.greatest(F.lit(1.0), F.abs(b))


def norm_cell(c: Column) -> Column:
    """A cell for comparison: no outer quotes, blanks or final dots, plain numbers, lower case."""
    bare = F.regexp_replace(strip_blank(c), r"^['\"]+|['\"]+\z", "")
    bare = strip_blank(F.regexp_replace(bare, r"\.+\z", ""))
    number = bare.rlike(r"(?U)^[-+]?[\d,]+(\.\d+)?\z")
    return F.lower(F.when(number, F.replace(bare, F.lit(","))).otherwise(bare))


def let(value: Column, build) -> Column:
    """``build`` on a value that is evaluated once: inside a lambda a plain column expression would
    be evaluated again for every element."""
    return F.transform(F.array(value), build)[0]


def trigram_share(before: str | None, now: str | None) -> float:
    """Share of the word trigrams of ``now`` that occur in ``before``; 0 when either has none."""
    def grams(text):
        words = re.findall(r"\w+", (text or "").lower())
        return list(zip(words, words[1:], words[2:], strict=False))

    known, fresh = set(grams(before)), grams(now)
    if not known or not fresh:
        return 0.0
    return sum(g in known for g in fresh) / len(fresh)


@F.pandas_udf(T.DoubleType())
def trigram_overlap(before: pd.Series, now: pd.Series) -> pd.Series:
    """``trigram_share`` of two columns. Set lookups keep it linear in the text, which array
    functions would not be."""
    return pd.Series([trigram_share(a, b) for a, b in zip(before, now, strict=True)], dtype="float64")


def word_shingles(text: Column, size: int) -> Column:
    """The distinct word n-grams of a text; NULL for shorter texts."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return let(words, lambda ws: F.when(F.size(ws) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: F.array_join(F.slice(ws, i, size), " ")))))
