"""Dates found in text; anything doubtful becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polislake.functions.text import let

_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)


def _iso(c: Column) -> Column:
    head = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})$", 1)
    return F.try_to_date(F.when(head != "", head), "yyyy-MM-dd")


def _written(c: Column) -> Column:
    """``5 March 2024`` with a full or a three-letter month name."""
    day, month, year = (F.regexp_extract(c, rf"(?i)^(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})$", i) for i in (1, 2, 3))
    text = F.when(day != "", F.concat_ws(" ", day, F.initcap(F.left(month, F.lit(3))), year))
    return F.try_to_date(text, "d MMM yyyy")


def _american(c: Column) -> Column:
    """``March 5, 2024``."""
    month, day, year = (F.regexp_extract(c, rf"(?i)^({_MONTHS})\s+(\d{{1,2}}),\s+(\d{{4}})$", i) for i in (1, 2, 3))
    text = F.when(day != "", F.concat_ws(" ", day, F.initcap(F.left(month, F.lit(3))), year))
    return F.try_to_date(text, "d MMM yyyy")


def parse(c: Column) -> Column:
    """P-16: the formats seen in records, ordinals removed, then the first date inside the text."""
    return let(
        F.regexp_replace(F.trim(c), r"(?i)(\d+)(st|nd|rd|th)", "$1"),
        lambda t: F.coalesce(
            _iso(F.left(t, F.lit(10))), _written(t), _american(t), _written(F.regexp_extract(t, r"\b(\d{1,2} [A-Z][a-z]+ \d{4})\b", 1))
        ),
    )


def first_in_text(c: Column) -> Column:
    """First ``d Month yyyy`` of the text, else the first ISO date."""
    pattern = r"(\d{1,2})\s+(\w+)\s+(\d{4})"
    written = F.concat_ws(" ", *[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)])
    return F.coalesce(_written(written), _iso(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1)))


def sane(c: Column, max_year: int, min_year: int = 1994) -> Column:
    """P-17: ISO date whose year lies in the window."""
    d = _iso(F.left(F.trim(c), F.lit(10)))
    return F.when(F.year(d).between(min_year, max_year), d)


def sane_from_name(stem: Column, max_year: int) -> Column:
    """P-17: the date carried by a file name."""
    return sane(F.regexp_extract(stem, r"(\d{4}-\d{2}-\d{2})", 1), max_year)


def iso_prefix(c: Column) -> Column:
    """P-18: date of an ISO timestamp text."""
    return _iso(F.left(c, F.lit(10)))


def since(c: Column) -> Column:
    """Start date written as ``since 5th March 2024``."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^since\s+", ""), r"(\d+)(st|nd|rd|th)", "$1")
    return _written(t)


def year_in(c: Column) -> Column:
    """P-19: first year of the 20th or 21st century."""
    y = F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(y != "", y.cast("int"))


def bill_number(c: Column) -> Column:
    """P-19: ``B 12`` or ``B12A``."""
    n = F.trim(F.regexp_extract(c, r"(?i)\b(B\s*\d+[A-Z]?)\b", 1))
    return F.when(n != "", n)


def int_with_commas(c: Column) -> Column:
    """P-19: whole number written with thousands commas."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("int")


def years_between(start: Column, end: Column) -> Column:
    """P-38: every year of the range, both ends included."""
    return F.sequence(F.year(start), F.year(end))
