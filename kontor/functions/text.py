"""Small string helpers shared by the column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"^\s+|\s+$"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``c`` evaluated once, however often the body uses it.

    Without this a column used n times is copied n times into the expression tree,
    and nested rules grow exponentially.
    """
    return F.element_at(F.transform(F.array(c), body), 1)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def squash(c: Column) -> Column:
    """Trim and collapse runs of white space to one blank."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def filled(c: Column) -> Column:
    """True for a non-NULL, non-empty string."""
    return F.coalesce(c != F.lit(""), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def cap_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the others."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, cap_first), "")


def contains_any(c: Column, needles: list[str]) -> Column:
    """Literal substring test against a short fixed list, NULL-safe (NULL -> false)."""
    return F.coalesce(c.rlike("|".join(re.escape(n) for n in needles)), F.lit(False))
