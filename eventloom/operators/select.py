"""Filters and windows of rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text


def trailing(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last hours before as_of; 0 means all.  A plain comparison, so it is pushed to the scan."""
    return df if hours == 0 else df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def slices(df: DataFrame, ts: str, as_of: Column, days: dict[str, int | None]) -> dict[str, DataFrame]:
    """One table for each named window of days; None is everything."""
    return {k: df if n is None else trailing(df, ts, as_of, 24 * n) for k, n in days.items()}


def newest(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """The n newest rows (one TakeOrderedAndProject)."""
    return df.orderBy(F.desc(ts), tie).limit(n)


def rest_rows(df: DataFrame, ts: str, tie: str, as_of: Column, since_hours: int = 24, bbox: str | None = None, lat: str = "latitude", lon: str = "longitude", cap: int = 2000) -> DataFrame:
    """Rows that the query service gives: with coordinates, in the window and box, newest first, capped."""
    if not 0 <= since_hours <= 2160:
        raise ValueError("since_hours is 0 to 2160")
    out = trailing(df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()), ts, as_of, since_hours)
    if bbox:
        out = out.where(geo.in_bbox(F.col(lat), F.col(lon), geo.parse_bbox(bbox)))
    return newest(out, ts, tie, cap)


def faceted(df: DataFrame, equal: dict[str, object] | None = None, any_of: dict[str, Sequence] | None = None, search: tuple[Sequence[str], str] | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
    """Rows that meet every facet given; a facet that is None or empty is not asked."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (any_of or {}).items():
        df = df.where(F.arrays_overlap(F.col(c), F.array(*[F.lit(x) for x in v]))) if v else df
    if search and search[1]:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *search[0])), F.lit(search[1].lower())))
    for c, (lo, hi) in (between or {}).items():
        df = df if lo is None else df.where(F.col(c) >= lo)
        df = df if hi is None else df.where(F.col(c) <= hi)
    return df


def long_texts(df: DataFrame, col: str, least: int = 8192, hosts: Iterable[str] = (), markers: Iterable[str] = ()) -> DataFrame:
    """Texts of a length and more, without some hosts' and those that hold a marker."""
    df = df.where(F.length(col) >= least)
    if hosts:
        df = df.where(~F.coalesce(F.col("host").isin(*hosts), F.lit(False)))
    return df.where(~text.contains_any(F.col(col), markers)) if markers else df


def record_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows that hold the needle anywhere."""
    return df.where(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(needle.lower())))


def without_values(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """Delete rows whose trimmed, lower-case text is one of the values; null stays."""
    return df.where(~F.coalesce(F.lower(F.trim(F.col(col))).isin(*sorted(values)), F.lit(False)))


def quality_gate(df: DataFrame, required: Sequence[str], warn: float = 0.20, fail: float = 0.35) -> DataFrame:
    """One row a column: rows, unknown ones, their rate, and ok, warn or fail; one pass over the table."""
    unknown = lambda c: F.count_if(F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin("", "unknown"))
    row = df.agg(F.count("*").alias("n"), *[unknown(c).alias(c) for c in required])
    long = row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("unknown")) for c in required])).alias("x"))
    rate = F.when(F.col("n") > 0, F.round(F.col("unknown") / F.col("n"), 6)).otherwise(F.lit(0.0))
    out = long.select(F.col("x.field").alias("field"), F.col("n").alias("rows"), F.col("x.unknown").alias("unknown")).withColumn("n", F.col("rows"))
    return out.withColumn("rate", rate).withColumn("verdict", F.when(F.col("rate") > fail, "fail").when(F.col("rate") > warn, "warn").otherwise("ok")).drop("n")


def by_date_then_name(df: DataFrame, date: str, name: str) -> DataFrame:
    """Newest date first, then name; a missing one counts as empty."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.orderBy(text_of(date).desc(), text_of(name))


def by_place(df: DataFrame, state: str, city: str, name: str) -> DataFrame:
    return df.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (state, city, name)])


def stories_sorted(groups: DataFrame, option: str, ts: str, items: str, tie: str) -> DataFrame:
    """Story groups by option: newest (missing moments last), oldest (missing first) or coverage (most items first)."""
    if option not in ("newest", "oldest", "coverage"):
        raise ValueError("option is newest, oldest or coverage")
    order = {"newest": F.col(ts).desc_nulls_last(), "oldest": F.col(ts).asc_nulls_first(), "coverage": F.desc(items)}[option]
    return groups.orderBy(order, tie)


def page_of(df: DataFrame, order: Sequence[Column | str], page: int, size: int) -> DataFrame:
    """Page number `page`, from 0, of rows in order."""
    return df.orderBy(*order).offset(page * size).limit(size)


def longest_texts(df: DataFrame, text_col: str, tie: str, n: int) -> DataFrame:
    """The n longest texts, and the first one that is empty or null."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    longest = df.orderBy(size.desc(), tie).limit(n).withColumn("sample", F.lit("longest"))
    empty = df.where(size == 0).orderBy(tie).limit(1).withColumn("sample", F.lit("empty"))
    return longest.unionByName(empty)


def first_distinct(df: DataFrame, key: str, order: Sequence[str], cap: int) -> DataFrame:
    """The first `cap` distinct keys over all pages in order, each with the row that it came in first."""
    from . import aggregates

    return aggregates.first_per_key(df, [key], *order).orderBy(*order).limit(cap)


def latest_run(df: DataFrame, run: str, ts: str) -> DataFrame:
    """Rows of the run whose last moment is the latest."""
    last = df.groupBy(run).agg(F.max(ts).alias("__el_t")).orderBy(F.desc("__el_t"), run).limit(1)
    return df.join(last.select(run), run, "left_semi")


def unlike(df: DataFrame, patterns: dict[str, str], where: Column) -> DataFrame:
    """Delete rows of which every column is like its pattern and the condition holds."""
    hit = where
    for c, p in patterns.items():
        hit = hit & F.col(c).like(p)
    return df.where(~F.coalesce(hit, F.lit(False)))
