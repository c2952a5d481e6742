"""Whole jobs: ingest, incidents, export, service.  Each is one logical plan from tables to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..operators import aggregates, classify, incidents, joins, select


@dataclass
class Ingested:
    reports: DataFrame  # relevant, dated, placed
    fresh: DataFrame  # of those, first of stories not seen before
    metrics: DataFrame


def ingest(reports: DataFrame, keywords: Iterable[str], case_words: Iterable[str], catalog: DataFrame, cache: DataFrame, seen: DataFrame, blocked: DataFrame, as_of: Column, least: int = 1, fetch: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Reports of all sources to placed stories.  Filters come before the fetch hook; there is no limit on places asked."""
    c = F.col
    one = aggregates.first_per_key(reports, ["source", "source_id"], F.desc(F.length(F.coalesce("content", F.lit(""))) > 0), "published_at", "url")
    one = one.withColumns({"host": F.regexp_extract("url", r"^\w+://(?:www\.)?([^/:?#]+)", 1), "path": F.try_parse_url("url", F.lit("PATH"))})
    one = joins.not_blocked(one, "host", "path", blocked).drop("host", "path")
    blob = F.concat_ws(" ", "title", "summary", "content")
    kept = one.where(classify.relevant(blob, keywords, case_words, least))
    kept = fetch(kept) if fetch else kept
    both = lambda old, new: F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), new))
    kept = kept.withColumns(
        {
            "locations": both("locations", classify.states(blob)),
            "city_mentions": both("city_mentions", classify.city_states(blob)),
            "facility_mentions": both("facility_mentions", classify.facilities(blob)),
            "published_at": F.coalesce(c("published_at"), dates.from_url(c("url")).cast("timestamp")),
        }
    )
    kept = kept.withColumn("geocode_query", F.try_element_at(classify.geocode_phrases(c("facility_mentions"), c("city_mentions"), c("locations")), F.lit(1)))
    named = catalog.select("position", "name", F.concat_ws(", ", "city", "state").alias("city_state"), F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lon"))
    placed = joins.first_contained(kept, "geocode_query", ["source", "source_id"], named, ["name", "city_state"], "position")
    hit = cache.select(F.col("query").alias("geocode_query"), F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"), "fetched_at")
    placed = placed.join(hit, "geocode_query", "left").withColumns(
        {
            "latitude": F.coalesce("latitude", "f_lat", "c_lat"),
            "longitude": F.coalesce("longitude", "f_lon", "c_lon"),
            "geocode_status": F.when(c("f_lat").isNotNull(), "catalog").otherwise(geo.cache_status(c("c_lat"), c("fetched_at"), as_of)),
        }
    )
    placed = placed.select(*reports.columns, "geocode_status")
    keyed = placed.withColumn("title_norm", text.norm_title(c("title")))
    fresh = joins.unseen(keyed, seen, "title_norm", "published_at").drop("title_norm")
    metrics = placed.agg(F.count("*").alias("reports"), F.count("latitude").alias("placed"), F.count_distinct("source").alias("sources"))
    return Ingested(placed, fresh, metrics)


@dataclass
class Resolved:
    records: DataFrame
    changes: DataFrame
    index: DataFrame


def daily_incidents(existing: DataFrame, incoming: Iterable[DataFrame], access_date: str) -> Resolved:
    """Merge incoming records into the existing ones, fold duplicates, drop what names nobody; with changes and counts."""
    new = None
    for table in incoming:
        table = incidents.with_fields(table)
        new = table if new is None else new.unionByName(table)
    merged = incidents.merge_records(incidents.with_fields(existing), new)
    records = incidents.drop_unnamed(incidents.collapse(merged.drop("change", "changes")))
    changes = merged.where("change <> 'same'")
    return Resolved(records.orderBy(F.coalesce("date_of_death", F.lit("")), F.coalesce("person_name", F.lit("")), "id"), changes, incidents.index(records))


def serve(triplets: DataFrame, as_of: Column, since_hours: int = 24, bbox: str | None = None) -> DataFrame:
    """What the query service gives for its two parameters; a bad box or range raises ValueError."""
    return select.rest_rows(triplets, "published_at", "story_id", as_of, since_hours, bbox)


def stats(items: DataFrame, key: str, ts: str, patterns: dict[str, str], title: str, body: str) -> DataFrame:
    """Articles folded to flags, then counts and ratios by week."""
    folded = aggregates.fold_flags(items, key, classify.mentions(F.col(title), F.col(body), patterns), ts)
    return aggregates.weekly(folded, ts, list(patterns))
