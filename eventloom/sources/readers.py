"""Scans.  Every one has a fixed schema, so that no file is read to infer it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import structured, urls
from ..operators import aggregates
from . import schemas

Paths = str | list[str]


def json_lines(spark: SparkSession, path: Paths, schema: str) -> DataFrame:
    """JSON lines; those that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def keyed_json_lines(spark: SparkSession, path: Paths, schema: str, key: str) -> DataFrame:
    """JSON lines of which the last of each key counts, by file name and place in the file."""
    df = json_lines(spark, path, schema).select("*", F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("__el_at"))
    rest = [c for c in df.columns if c not in (key, "__el_at")]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), "__el_at").alias("r")).select(key, "r.*")


def triplets(spark: SparkSession, path: Paths) -> DataFrame:
    """Triplets of either naming; event types as a list whether they were a list, JSON or comma text."""
    extra = ", ".join(f"{a} {'double' if a in ('lat', 'lon') else 'string'}" for a in schemas.TRIPLET_ALIASES.values())
    df = json_lines(spark, path, f"{schemas.TRIPLET}, {extra}")
    df = df.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(a)) for k, a in schemas.TRIPLET_ALIASES.items()}).drop(*schemas.TRIPLET_ALIASES.values())
    return df.withColumn("event_types", structured.string_list(F.col("event_types")))


def matching_files(spark: SparkSession, path: str) -> list[str]:
    """Files that a path or glob names, in order of name; a folder's are those in it.  Nothing is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(where) or ():
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else (status,)
        found += [s.getPath() for s in inside if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return [p.toString() for p in sorted(found, key=lambda p: (p.getName(), p.toString()))]


def newest_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the file whose name sorts last; the others are listed only."""
    files = matching_files(spark, path)
    return json_lines(spark, files[-1:], schema) if files else spark.createDataFrame([], schema)


def dated_files(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Rows of the files whose names hold a date (yyyy-mm-dd or yyyymmdd) from first to last; no others are read."""
    day = re.compile(r"(20\d\d)-?([01]\d)-?([0-3]\d)")
    dates = [(m and "-".join(m.groups()), f) for f in matching_files(spark, path) for m in [day.search(f.rpartition("/")[2])]]
    files = [f for d, f in dates if d and first <= d <= last]
    return json_lines(spark, files, schema) if files else spark.createDataFrame([], schema)


def facilities(spark: SparkSession, path: Paths) -> DataFrame:
    """Facility catalog in file order; rows without name, address, city or state go, bad coordinates are null."""
    df = spark.read.schema(schemas.FACILITY).option("header", True).csv(path)
    for c in ("name", "address", "city", "state"):
        df = df.where(F.trim(c) != "")
    number = {c: F.col(c).try_cast("double") for c in ("latitude", "longitude")}
    query = F.concat_ws(", ", "address", "city", "state").alias("geocode_query")
    return df.withColumns(number).select("*", query, F.monotonically_increasing_id().alias("position"))


def monthly_counts(spark: SparkSession, path: Paths) -> DataFrame:
    """(fiscal_year, month_abbr, encounters), summed; thousands separators are understood."""
    n = F.regexp_replace("encounters", ",", "").try_cast("long")
    return spark.read.schema(schemas.MONTHLY).option("header", True).csv(path).groupBy(F.col("fiscal_year").try_cast("int").alias("fiscal_year"), "month_abbr").agg(F.sum(n).alias("encounters"))


def city_states(spark: SparkSession, path: Paths) -> DataFrame:
    """Lower-case city name or alternate name to its states, of US rows of a tab-separated gazetteer."""
    df = spark.read.schema(schemas.GAZETTEER).option("sep", "\t").csv(path).where("country = 'US'")
    names = F.explode(F.array_union(F.array("name"), F.coalesce(F.split("alternates", ","), F.array().cast("array<string>")))).alias("city")
    return df.select(names, "state").groupBy(F.lower(F.trim("city")).alias("city")).agg(F.array_sort(F.collect_set("state")).alias("states"))


def config_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """Lines of a configuration file without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def blacklist(spark: SparkSession, path: Paths) -> DataFrame:
    """(host, prefix) of `host` or `host/path` lines; a null prefix stands for the whole host."""
    line = F.regexp_replace(F.col("line"), "^https?://", "")
    at = F.instr(line, "/")
    return config_lines(spark, path).select(F.regexp_replace(F.lower(F.substring_index(line, "/", 1)), r"^www\.", "").alias("host"), F.when(at > 0, F.substring(line, at, F.length(line))).alias("prefix")).distinct()


def feeds(spark: SparkSession, path: Paths) -> DataFrame:
    """(name, url) of `name|url`, `name,url` or bare `url` lines."""
    lines = config_lines(spark, path)
    url = F.regexp_extract("line", r"(https?://\S+)$", 1)
    name = F.nullif(F.trim(F.regexp_extract("line", r"^([^|,]+)[|,]\s*https?://", 1)), F.lit(""))
    return lines.where(url != "").select(F.coalesce(name, urls.feed_name(url)).alias("name"), url.alias("url")).distinct()


def page_links(pages: DataFrame, url: str, html: str, cap: int = 50, external_only: bool = False) -> DataFrame:
    """(page url, link, title): absolute links of landing pages, each once, at most `cap` a page in page order."""
    each = pages.select(F.col(url).alias("page"), F.posexplode(structured.links(F.col(html))).alias("pos", "a"))
    out = each.select("page", "pos", urls.join_url(F.col("page"), F.col("a.href")).alias("link"), F.col("a.text").alias("title")).where("link like 'http%'")
    if external_only:
        out = out.where(urls.host(F.col("link")) != urls.host(F.col("page")))
    once = aggregates.first_per_key(out, ["page", "link"], "pos")
    return aggregates.top_per_group(once, ["page"], cap, "pos").select("page", "link", "title")


def fetched(df: DataFrame, url: str, fetch, into: str = "content") -> DataFrame:
    """df with a column of what fetch(url) gives, text or None: the hook for bodies, PDFs and rendered pages.

    Put filters before it: none are pushed through Python.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{into: [fetch(u) if u else None for u in b[url]]})

    return df.mapInPandas(run, schema)

