"""Text normalisation and lists in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What spreadsheets write where a formula fails.
ERROR_LITERALS = ["#DIV/0!", "#N/A", "#VALUE!", "#REF!", "#NAME?"]


def stripped(x: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalized(x: Column) -> Column:
    """Lower case, each white-space run as one space, stripped; null counts as empty."""
    return stripped(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def compact(x: Column) -> Column:
    """Normalised without any white space."""
    return F.regexp_replace(normalized(x), r"(?U)\s+", "")


def blank_to_null(x: Column) -> Column:
    return F.when(stripped(x) != "", x)


def safe_text(x: Column) -> Column:
    return stripped(F.coalesce(x.cast("string"), F.lit("")))


def is_nonempty(x: Column) -> Column:
    """Neither null nor blank nor a lone dash."""
    return F.coalesce(~stripped(x).isin("", "-"), F.lit(False))


def split_list(x: Column, separator: str = ";") -> Column:
    """Distinct trimmed parts that aren't blank; null counts as empty."""
    parts = F.split(F.coalesce(x, F.lit("")), separator)
    return F.array_distinct(F.filter(F.transform(parts, stripped), lambda p: p != ""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: within f, an expression would be computed at each of its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def contains_any(x: Column, words: list[str]) -> Column:
    """Whether x holds one of the words."""
    if not words:
        return F.lit(False)
    return F.greatest(*[F.contains(x, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(x, F.lit(words[0]))


def codes(*tests: tuple[Column, str]) -> Column:
    """The codes whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in tests]))


def column_letters_index(letters: Column) -> Column:
    """Index from 0 of a sheet column's letters (A is 0)."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c.rlike("^[A-Z]$"))
    return F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def column_letters(index: Column) -> Column:
    """Letters of a sheet column's index from 0, up to three letters."""
    letter = lambda n: F.char(n + 65)
    one = letter(F.pmod(index, F.lit(26)))
    rest = F.floor(index / 26) - 1
    two = F.concat(letter(F.pmod(rest, F.lit(26))), one)
    third = F.floor(rest / 26) - 1
    return F.when(index < 26, one).when(index < 702, two).otherwise(F.concat(letter(F.pmod(third, F.lit(26))), two))
