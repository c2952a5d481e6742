"""Schemas of the tables, as DDL."""

REPORT = (
    "source string, source_id string, title string, url string, summary string, published_at timestamp, locations array<string>, city_mentions array<string>, "
    "facility_mentions array<string>, content string, latitude double, longitude double, geocode_query string, raw string"
)
TRIPLET = (
    "story_id string, source string, url string, title string, published_at string, who string, what string, `where` string, latitude double, longitude double, "
    "geocode_query string, geocode_status string, event_types string, extracted_at string, run_id string"
)
TRIPLET_ALIASES = {"where": "where_text", "latitude": "lat", "longitude": "lon", "published_at": "publishedAt", "event_types": "eventTypes"}
FACILITY = "name string, address string, city string, state string, latitude string, longitude string"
MONTHLY = "month string, fiscal_year string, month_abbr string, encounters string, presidency string"
GEOCACHE = "query string, latitude double, longitude double, raw_response string, fetched_at timestamp"
GAZETTEER = "geonameid string, name string, alternates string, country string, state string"
