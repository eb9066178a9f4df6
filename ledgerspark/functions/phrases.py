"""A small grammar of wordings: tables of phrases over folded words, parted by single spaces."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.text import normalize_text


def words(text: Column) -> Column:
    """ " word word ... ": folded, marks as words of their own, a space on either side of each; a null text has none."""
    marked = F.regexp_replace(normalize_text(F.coalesce(text, F.lit(""))), "[^0-9a-z ]", " $0 ")
    return F.concat(F.lit(" "), F.regexp_replace(F.ltrim(marked), " +", " "), F.lit(" "))


def joined(first: Iterable[str], second: Iterable[str]) -> tuple[str, ...]:
    """Every word of first before every one of second, apart and run together."""
    return tuple(a + gap + b for a in first for b in second for gap in (" ", ""))


def said(flat: Column, phrases: Iterable[str]) -> Column:
    """Whether words() hold one of the phrases; " ... " in a phrase stands for any words."""
    parts = sorted({r" .*?(?<= )".join(map(re.escape, p.split(" ... "))) for p in phrases}, key=lambda p: (-len(p), p))
    return F.rlike(flat, F.lit("(?<= )(?:" + "|".join(parts) + ")(?= )"))


def first_said(flat: Column, table: Iterable[tuple[object, Iterable[str]]]) -> Column:
    """The value (a literal or a Column) of the first entry of (value, phrases) that words() hold, else null."""
    out = F
    for value, phrases in table:
        out = out.when(said(flat, phrases), value if isinstance(value, Column) else F.lit(value))
    return out
