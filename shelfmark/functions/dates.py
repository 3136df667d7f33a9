"""Dates in free text, and time decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
MONTH_NAME = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{4}\b"


def iso_date(c: Column) -> Column:
    """The first YYYY-M-D or YYYY/M/D anywhere, padded; '' where there is none."""
    c = F.coalesce(c, F.lit(""))
    y, m, d = (F.regexp_extract(c, ISO, i) for i in (1, 2, 3))
    return F.when(y == "", "").otherwise(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def byline_date(c: Column, within: int = 1200) -> Column:
    """A date with a month's name near the start of a text; '' where there is none."""
    return F.regexp_extract(F.substring(F.coalesce(c, F.lit("")), 1, within), MONTH_NAME, 0)


def recency(stamp: Column, now: Column, days: float = 30.0) -> Column:
    """1 now, 0 after ``days``; 0 without a stamp."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / F.lit(86_400e6 * days)
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - age), F.lit(0.0))


def stamp(c: Column) -> Column:
    """An ISO stamp as a time; malformed ones are null, those without a zone are UTC."""
    return F.try_to_timestamp(F.regexp_replace(c, "T", " "))


def utc_stamp(now: Column | None = None) -> Column:
    """A moment, the current one if none is given, as YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if now is None else now.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
