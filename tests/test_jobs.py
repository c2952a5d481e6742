"""Scans, sinks, jobs and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from eventloom.plans import jobs
from eventloom.sources import readers, schemas, sinks
from eventloom.streaming import increments


def test_scans(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text("\n".join([json.dumps({"story_id": "a", "lat": 1.5, "where": "X", "event_types": "march, rally"}), "{broken", json.dumps({"story_id": "b", "latitude": 2.5, "where_text": "Y", "eventTypes": '["riot"]'})]))
    got = {r["story_id"]: r for r in readers.triplets(spark, str(f)).collect() if r["story_id"]}
    assert (got["a"]["latitude"], got["a"]["where"], got["a"]["event_types"]) == (1.5, "X", ["march", "rally"])
    assert (got["b"]["latitude"], got["b"]["where"], got["b"]["event_types"]) == (2.5, "Y", ["riot"])
    c = tmp_path / "f.csv"
    c.write_text("name,address,city,state,latitude,longitude\nA,1 St,X,TX,31.5,bad\n,2 St,Y,TX,1,2\n")
    r = readers.facilities(spark, str(c)).collect()
    assert [(x["name"], x["latitude"], x["longitude"], x["geocode_query"]) for x in r] == [("A", 31.5, None, "1 St, X, TX")]
    m = tmp_path / "m.csv"
    m.write_text('month,fiscal_year,month_abbr,encounters,presidency\nx,2024,OCT,"1,200",P\nx,2024,OCT,300,P\n')
    assert readers.monthly_counts(spark, str(m)).first()["encounters"] == 1500
    b = tmp_path / "b.txt"
    b.write_text("# no\nwww.a.org\nb.org/x\n\n")
    assert {tuple(x) for x in readers.blacklist(spark, str(b)).collect()} == {("a.org", None), ("b.org", "/x")}
    w = tmp_path / "w.txt"
    w.write_text("N|https://a.org/feed\nhttps://b.org/rss\n")
    assert {tuple(x) for x in readers.feeds(spark, str(w)).collect()} == {("N", "https://a.org/feed"), ("custom-b-org-rss", "https://b.org/rss")}
    p = spark.createDataFrame([("https://a.org/n/", '<a href="/x">One</a><a href="/x">One</a><a href="https://b.org/y">Two</a>')], "url string, html string")
    assert {(x["link"], x["title"]) for x in readers.page_links(p, "url", "html").collect()} == {("https://a.org/x", "One"), ("https://b.org/y", "Two")}
    assert readers.page_links(p, "url", "html", external_only=True).count() == 1
    assert readers.fetched(p, "url", lambda u: u.upper()).first()["content"] == "HTTPS://A.ORG/N/"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 30)), (2, dt.datetime(2024, 1, 1))], "id int, ts timestamp")
    sinks.windows(df, "ts", F.lit("2024-01-31").cast("timestamp"), str(tmp_path / "w"), {"3d": 3, "all": None})
    assert spark.read.json(str(tmp_path / "w/triplets_3d")).count() == 1
    assert spark.read.json(str(tmp_path / "w/triplets_all")).count() == 2
    for _ in range(2):
        sinks.run_log(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log")).count() == 4


def test_ingest(spark):
    row = {"source": "s", "published_at": None, "locations": None, "city_mentions": None, "facility_mentions": None, "content": None, "latitude": None, "longitude": None, "geocode_query": None, "raw": None}
    reports = [
        row | {"source_id": "1", "title": "Protest at Eloy Detention Center", "url": "https://a.org/2024/01/02/x", "summary": "In Eloy, Arizona people march."},
        row | {"source_id": "1", "title": "again", "url": "https://a.org/z", "summary": ""},
        row | {"source_id": "2", "title": "Protest seen before", "url": "https://a.org/y", "summary": "protest"},
        row | {"source_id": "3", "title": "Protest, blocked", "url": "https://bad.org/y", "summary": "protest"},
        row | {"source_id": "4", "title": "Cake sale", "url": "https://a.org/w", "summary": "nice"},
    ]
    df = spark.createDataFrame([{k: r[k] for k in r} for r in reports], schemas.REPORT)
    catalog = spark.createDataFrame([(0, "Eloy Detention Center", "Eloy", "AZ", 32.8, -111.5)], "position long, name string, city string, state string, latitude double, longitude double")
    cache = spark.createDataFrame([], schemas.GEOCACHE)
    seen = spark.createDataFrame([("protest seen before",)], "title_norm string")
    blocked = spark.createDataFrame([("bad.org", None)], "host string, prefix string")
    out = jobs.ingest(df, ["protest"], [], catalog, cache, seen, blocked, F.lit("2024-02-01").cast("timestamp"))
    got = {r["source_id"]: r for r in out.reports.collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["latitude"], got["1"]["geocode_status"], str(got["1"]["published_at"])[:10]) == (32.8, "catalog", "2024-01-02")
    assert [r["source_id"] for r in out.fresh.collect()] == ["1"]
    assert out.metrics.first().asDict() == {"reports": 2, "placed": 1, "sources": 1}


def test_stream_merge(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i, rows in enumerate(([{"k": 1, "v": 1}, {"k": 2, "v": 1}], [{"k": 2, "v": 5}])):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = increments.new_files(spark, str(src), "k int, v int")
        increments.merge_into(stream, out, ["k"], "v", str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{out}/v=1").select("k", "v").collect()} == {(1, 1), (2, 5)}
