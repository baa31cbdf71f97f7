"""Column expressions over text that several operators share; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of every contract here: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def without(text: Column, chars: str) -> Column:
    """The text less every given character: byte searches, with no regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where lambdas inside the body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fraction(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the key's MD5: the same on every engine, run and partitioning."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
