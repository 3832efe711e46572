"""Small column helpers shared by the plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from motorlake import config

_BLANKS = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.trim(c, F.lit(_BLANKS))


def blank(name: str) -> Column:
    """True when the column is null or whitespace only."""
    return strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def date_key(c: Column) -> Column:
    """yyyyMMdd as an integer."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def month_key(c: Column) -> Column:
    """yyyyMM as an integer."""
    return (F.year(c) * 100 + F.month(c)).cast("int")


def row_key(*columns: str) -> Column:
    """md5 of the columns joined by a bar."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def iso_seconds(ts: Column) -> Column:
    """Timestamp text as yyyy-MM-ddTHH:mm:ss, with six decimals only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def is_breakdown(issue: Column) -> Column:
    """Unscheduled failure: not a routine text and naming any breakdown word."""
    text = strip(F.coalesce(issue, F.lit("")))
    mentions = F.lower(text).rlike("|".join(config.BREAKDOWN_WORDS))
    return ~text.isin(*config.ROUTINE_ISSUES) & mentions


def mentions(term: str, *columns: str) -> Column:
    """Case-insensitive containment in any of the columns; a blank term matches all."""
    needle = term.strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from start to end, as bigint."""
    return F.timestamp_diff("MICROSECOND", start, end)
