"""Aggregations; all of them have a partial step on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def index_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by each key alone, in one pass: (facet, value, n)."""
    facets = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")
    return df.select(facets).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def date_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def grid(df: DataFrame, key: Column, ts: str) -> DataFrame:
    """Rows of each cell: count, first and last moment."""
    return df.groupBy(key.alias("cell")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def stories(df: DataFrame, key: Column, order: str, firsts: Sequence[str], newest: str) -> DataFrame:
    """One row a story: first non-null of some columns in order, newest moment, number of items."""
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    return df.groupBy(key.alias("story")).agg(*pick, F.max(newest).alias("newest"), F.count("*").alias("items"))


def fold_flags(df: DataFrame, key: str, flags: dict[str, Column], ts: str) -> DataFrame:
    """One row a key: any of each flag, and the earliest moment."""
    return df.groupBy(key).agg(F.min(ts).alias(ts), *[F.bool_or(F.coalesce(f, F.lit(False))).alias(k) for k, f in flags.items()])


def weekly(df: DataFrame, ts: str, flags: Sequence[str], least: int = 5) -> DataFrame:
    """Per Monday week: total, count and ratio of each flag; a ratio is 0 in weeks of fewer than `least` rows."""
    out = df.groupBy(dates.week_start(F.col(ts)).alias("week")).agg(F.count("*").alias("total"), *[F.count_if(f).alias(f"n_{f}") for f in flags])
    ratio = lambda f: F.when(F.col("total") >= least, F.round(F.col(f"n_{f}") / F.col("total"), 6)).otherwise(F.lit(0.0))
    return out.select("week", "total", *[x for f in flags for x in (F.col(f"n_{f}"), ratio(f).alias(f"rate_{f}"))])


def all_weeks(df: DataFrame, week: str, first: str, last: str) -> DataFrame:
    """df with a row for every Monday from first to last; counts that are missing are 0."""
    spark = df.sparkSession
    weeks = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 7 DAYS)) AS {week}")
    return weeks.join(df, week, "left").na.fill(0)


def top_groups_weekly(df: DataFrame, group: str, ts: str, k: int) -> DataFrame:
    """Weekly counts of the k largest groups (ties by name)."""
    counts = df.groupBy(group, dates.week_start(F.col(ts)).alias("week")).agg(F.count("*").alias("n"))
    top = counts.groupBy(group).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), group).limit(k)
    return counts.join(top, group, "left_semi")


def host_counts(df: DataFrame, host: Column, least: int = 1) -> DataFrame:
    return df.groupBy(host.alias("host")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key; of equals the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def duplicated(df: DataFrame, keys: Sequence[Column], member: str) -> DataFrame:
    """Keys of several rows, how many, and the least member.  The members are a join away: no list is built.

    Hashes of the keys are counted first, so that of long keys only those that repeat are grouped.
    """
    rows = df.select(*keys, member)
    names = [c for c in rows.columns if c != member]
    rows = rows.withColumns({"__el_h": F.xxhash64(*names), "__el_d": F.md5(F.to_json(F.struct(*names)))})
    again = rows.groupBy("__el_h", "__el_d").count().where("count > 1").drop("count")
    same = rows.join(again, ["__el_h", "__el_d"], "left_semi")
    return same.groupBy(*names).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1")


def flag_counts(df: DataFrame, flags: Column) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def facet_values(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Distinct values of each facet."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value")) for k in facets])).alias("x")
    return df.select(pairs).select("x.facet", "x.value").where("value is not null and value <> ''").distinct()


def day_runs(df: DataFrame, part: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Rows numbered by run of one day in order: a new run begins where the day differs from the row before."""
    w = Window.partitionBy(*part).orderBy(ts, tie)
    day = F.col(ts).cast("date")
    starts = F.coalesce((day != F.lag(day).over(w)).cast("int"), F.lit(1))
    return df.withColumn("__el_s", starts).withColumn("run", F.sum("__el_s").over(w)).drop("__el_s")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__el_rn", F.row_number().over(w)).where("__el_rn = 1").drop("__el_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def only_value(df: DataFrame, keys: Sequence[str], value: str) -> Column:
    """Whether all rows of a group have one value between them."""
    w = Window.partitionBy(*keys)
    return F.min(value).over(w) == F.max(value).over(w)


def has_sibling(keys: Sequence[str], flag: Column) -> Column:
    """Whether any row of the group has the flag."""
    return F.max(F.coalesce(flag.cast("int"), F.lit(0))).over(Window.partitionBy(*keys)) == 1


def month_changes(df: DataFrame, part: Sequence[str], ts: str, tie: str) -> DataFrame:
    """df with month_change: whether the row's month is another than that of the row before it; the first row's is."""
    w = Window.partitionBy(*part).orderBy(ts, tie)
    month = F.date_format(ts, "yyyy-MM")
    return df.withColumn("month_change", F.coalesce(month != F.lag(month).over(w), F.lit(True)))


def most_mentioned(df: DataFrame, key: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """Of each key the term that its texts mention most, with the count; ties to the term named first, none mentioned gives null."""
    from ..functions import text

    counts = F.array(*[F.struct(text.mention_counts(F.col(text_col), F.lit(t)).cast("long").alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("term")) for i, t in enumerate(terms)])
    each = df.select(key, F.explode(counts).alias("x")).groupBy(key, "x.term", "x.i").agg(F.sum("x.n").alias("n"))
    best = each.groupBy(key).agg(F.max(F.struct("n", "i", "term")).alias("m"))
    return best.select(key, F.when(F.col("m.n") > 0, F.col("m.term")).alias("term"), F.col("m.n").alias("n"))


def summed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sums of a count held as text with thousands separators; what is no number counts nothing."""
    n = F.regexp_replace(F.col(value).cast("string"), ",", "").try_cast("long")
    return df.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0)).alias(value))
