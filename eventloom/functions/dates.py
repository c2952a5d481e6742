"""Dates and times from text.  Nothing here looks at the clock: a moment to count from is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*"


def first_of(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def rfc822(c: Column) -> Column:
    """Mail and feed dates; the weekday goes, since it can't be parsed."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    return first_of(t, "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")


def compact(c: Column) -> Column:
    """The compact forms of news indexes, then ISO."""
    return F.coalesce(first_of(c, "yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"), iso(c))


def textual(c: Column) -> Column:
    """First `Month d, yyyy` of a text, as a date."""
    found = F.regexp_extract(c, rf"(?i)\b({MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}})\b", 1)
    clean = F.regexp_replace(F.regexp_replace(found, r"[.,]", ""), r"\s+", " ")
    clean = F.regexp_replace(clean, "(?i)^sept ", "Sep ")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in ("MMMM d yyyy", "MMM d yyyy")]).cast("date")


def month_day(c: Column, year: Column) -> Column:
    """First `Month d` of a text, in the given year."""
    found = F.regexp_extract(c, rf"(?i)\b({MONTH}\.?\s+\d{{1,2}})\b", 1)
    clean = F.concat_ws(" ", F.regexp_replace(F.regexp_replace(found, r"[.]", ""), r"\s+", " "), year.cast("string"))
    clean = F.regexp_replace(clean, "(?i)^sept ", "Sep ")
    return F.when(found != "", F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in ("MMMM d yyyy", "MMM d yyyy")]).cast("date"))


def from_url(c: Column) -> Column:
    """Date in a URL's path, /yyyy/mm/dd/ or /yyyy-mm-dd."""
    path = F.try_parse_url(c, F.lit("PATH"))
    found = F.regexp_extract(path, r"/(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:\D|$)", 0)
    digits = F.regexp_replace(F.regexp_replace(found, r"^\D+|\D+$", ""), r"\D", "-")
    return F.when(found != "", F.try_to_timestamp(digits, F.lit("yyyy-M-d")).cast("date"))


def partial(c: Column) -> Column:
    """`yyyy`, `yyyy-MM`, `yyyy-MM-dd` or a timestamp as a date; what is missing is 1."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
        .when(t.rlike(r"^\d{4}-\d\d$"), F.try_to_timestamp(F.concat(t, F.lit("-01")), F.lit("yyyy-MM-dd")))
        .when(t.rlike(r"^\d{4}(?:-\d\d){2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
        .otherwise(F.try_to_timestamp(t))
        .cast("date")
    )


def precision(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}(?:-\d\d){2}"), "day").when(t.rlike(r"^\d{4}-\d\d$"), "month").when(t.rlike(r"^\d{4}$"), "year").otherwise("unknown")


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit(""))


def week_start(c: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def fiscal_month(year: Column, month: Column, first: int = 10) -> Column:
    """First day of a fiscal year's month; the year begins in month `first` of the year before."""
    return F.make_date(F.when(month >= first, year - 1).otherwise(year), month, F.lit(1))


def day_end(c: Column) -> Column:
    """Last millisecond of the day."""
    return F.date_trunc("day", c) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def within_days(a: Column, b: Column, days: Column | int) -> Column:
    """Both known and at most so many days apart."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def infer_year(month_day_text: Column, release: Column) -> Column:
    """`Month d` in the year of a release, or in the year before where it would lie after the release."""
    here = month_day(month_day_text, F.year(release))
    return F.when(here > release, month_day(month_day_text, F.year(release) - 1)).otherwise(here)
