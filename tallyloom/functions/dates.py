"""Date functions on the ISO texts that the records carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def german_date(c: Column) -> Column:
    """``dd.MM.yyyy`` as ISO; what cannot be read stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(c, "dd.MM.yyyy"), "yyyy-MM-dd"), c)


def day(c: Column) -> Column:
    """The first ten characters of a timestamp text."""
    return F.substring(c, 1, 10)


def iso_z(c: Column) -> Column:
    """ISO day with midnight in UTC; null stays null."""
    return F.concat(day(c), F.lit("T00:00:00Z"))


def year_of(c: Column) -> Column:
    """Year of an ISO text; null where it cannot be read."""
    return F.year(F.try_to_date(day(c), "yyyy-MM-dd"))


def is_month(c: Column) -> Column:
    """Whether a text is ``yyyy-mm`` with a month from 1 to 12; null gives false."""
    return F.coalesce(c.rlike(r"^\p{N}{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def without_time(c: Column) -> Column:
    """What stands before the first ``t`` of a lower-cased date text."""
    return F.substring_index(F.lower(c), "t", 1)


def not_later(a: Column, b: Column) -> Column:
    """ISO texts compared as texts, missing ones as the empty text."""
    return F.coalesce(a, F.lit("")) <= F.coalesce(b, F.lit(""))


def date_order(date: Column, tie: Column) -> list[Column]:
    """Sort expressions: the text of a date, missing ones first as the empty text, then ``tie``."""
    return [F.coalesce(date, F.lit("")).asc(), tie.asc()]
