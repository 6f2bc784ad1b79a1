"""Regular-expression pieces that behave the same on every engine we compare with.

Java treats accented letters as word characters and leaves the no-break space out
of ``\\s``; pages are full of both. The pieces below spell the classes out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: ASCII white space plus the Unicode blanks found on pages.
BLANK_CHARS = r"\s\u000b\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as one class; ordinary letters fail its first half, which is most of the work.
BLANK = rf"[[^!-\u009f\u00a1-\u167f]&&[{BLANK_CHARS}]]"
NOT_BLANK = f"[^{BLANK_CHARS}]"
#: ASCII word boundaries as look-arounds.
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"
#: Case folding that covers non-ASCII letters too.
ANY_CASE = "(?iu)"


def words(*alternatives: str) -> str:
    """Case-blind pattern that matches any of the alternatives as whole words."""
    return f"{ANY_CASE}{WORD_START}(?:{'|'.join(alternatives)}){WORD_END}"


def literal_words(items) -> str:
    """Like :func:`words`, for plain strings rather than patterns."""
    return words(*(re.escape(item) for item in items))


def let(value: Column, body) -> Column:
    """Bind an expression to a name so it is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(column: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(column, f"{BLANK}+", " "))


#: Every sign of :data:`BLANK_CHARS`, for functions that take a set of characters.
BLANK_SET = " \t\n\r\f\u000b\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_blank(column: Column) -> Column:
    """Trim both ends, Unicode blanks included; looks at the ends only."""
    return F.btrim(column, F.lit(BLANK_SET))


def first_group(column: Column, pattern: str, group: int = 1) -> Column:
    """One capture group, NULL (not the empty string) when there is no match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def first_of(column: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """The first non-empty capture group of an alternation."""
    return F.coalesce(*(blank_to_null(first_group(column, pattern, g)) for g in groups))


def blank_to_null(column: Column) -> Column:
    """Empty strings become NULL."""
    return F.when(column != "", column)


def all_matches(column: Column, pattern: str, group: int = 0) -> Column:
    """Every match (or one group of it), in order."""
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(group))


def round_half_up(column: Column, digits: int = 0) -> Column:
    """Rounding that sends halves towards plus infinity, unlike Spark's ``round``."""
    scale = float(10**digits)
    return F.floor(column * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """Share in per cent with one decimal, NULL when there is nothing to divide by."""
    return F.when(whole > 0, F.floor(part / whole * 1000.0 + 0.5) / 10.0)
