"""Golden rows of the operators' rules."""

import uuid

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, geo, ids, structured, text, urls
from eventloom.operators import classify, incidents, parse
from eventloom.operators import merge as M

DAY = "2026-01-24"


@pytest.fixture(autouse=True)
def interpreted(spark):
    """These plans are wide and their tables tiny: compiling them takes longer than all else."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "true")


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def record(spark, *rows):
    return incidents.normalize(spark.createDataFrame([incident(**r) for r in rows], incidents.SCHEMA), DAY)


def incident(sources=(), **known):
    row = {n: None for n, _ in incidents.FIELDS} | known
    row["sources"] = [{"url": u, "publisher": None, "publish_date": None, "access_date": None, "source_type": k, "credibility_tier": None, "snippet": None, "claim_tags": None} for u, k in sources]
    return row


@pytest.mark.parametrize(
    ("keywords", "case_words", "title", "want"),
    [
        ([], ["ICE"], "ICE announces new policy", True),
        ([], ["ICE"], "Ice announces new policy", False),
        ([], ["ICE"], "Local police announce new policy", False),
        (["immigration"], [], "IMMIGRATION COURT BACKLOG GROWS", True),
        (["immigration"], [], "Protesters march against ICE raids in Chicago", True),
        (["immigration"], [], "Residents march over housing policy in city hall", True),
        (["immigration"], [], "Bake sale at city hall", False),
    ],
)
def test_relevance(spark, keywords, case_words, title, want):
    assert one(spark, title, lambda c: classify.relevant(c, keywords or ["nothing here"], case_words)) is want


@pytest.mark.parametrize(
    ("value", "has", "lacks"),
    [
        ("They planned a protest march, then held a vigil.", {"protest", "march", "vigil"}, set()),
        ("There was civil unrest, and riots by night.", {"civil_unrest", "riot"}, set()),
        ("A trial begins March 2024 in Portland.", set(), {"march"}),
        ("March 2024 in Portland", set(), {"march"}),
        ("Students announced a march for justice here.", {"march"}, set()),
        ("March for justice begins", {"march"}, set()),
        ("Women's March downtown", set(), {"march"}),
        ("Mid-March 2024. March 5, rain", {"march"}, set()),
        ("rally and strikes", {"rally", "strike"}, set()),
        ("Rallies held", {"rally"}, set()),
    ],
)
def test_event_types(spark, value, has, lacks):
    got = set(one(spark, value, classify.event_types))
    assert has <= got
    assert not lacks & got


REPORT = """Detainee Death Report: ROJAS Vega, Tomas
Date of Birth: March 3, 1980
Date of Death: October 4, 2025
Age: 45
Sex: Male
Country of Citizenship: Peru
In August officers transferred Mr. ROJAS Vega to the Juniper ICE
Processing Center (APC) in Juniper, CA."""


def test_report(spark):
    df = spark.createDataFrame([(REPORT, "https://www.ice.gov/a.pdf")], "text string, url string")
    r = parse.reports(df, "text", "url").first()
    assert (r["person_name"], r["date_of_birth"], r["date_of_death"]) == ("Tomas Rojas Vega", "1980-03-03", "2025-10-04")
    assert (r["age"], r["gender"], r["country_of_citizenship"], r["death_context"]) == (45, "Male", "Peru", "detention")
    assert r["facility_or_location"] == "Juniper ICE Processing Center (APC)"
    assert parse.reports(df, "text", "url", min_year=2026).count() == 0


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (
            "JANUARY 18, 2026EL PASO, TX\nDETAINEE DEATH\nTexas — Hector Samuel Rios, a 36-year-old man from Nicaragua, died Jan. 16, 2026 at a clinic.",
            dict(city="El Paso", state="TX", person_name="Hector Samuel Rios", date_of_death="2026-01-16", release_date="2026-01-18", age=36, nationality="Nicaragua"),
        ),
        ("JANUARY 18, 2026 EL PASO, TX Hector Samuel Rios, a 36-year-old man from Nicaragua, died in custody Jan. 14 at Camp East Montana in El Paso, Texas.", {"date_of_death": "2026-01-14"}),
        ("JANUARY 9, 2026 INDIO, CA — Oscar Daniel Leon-Cruz, a 68-year-old man from Honduras, passed away Jan 6 at a hospital.", dict(person_name="Oscar Daniel Leon-Cruz", date_of_death="2026-01-06")),
        (
            "JANUARY 9, 2026 HOUSTON, TX — Pedro Ivan Salas Montes, a 42-year-old man from Honduras, passed away Jan 5 at a hospital. The cause of death remains under investigation.",
            dict(person_name="Pedro Ivan Salas Montes", date_of_death="2026-01-05", under_investigation=True),
        ),
    ],
)
def test_release(spark, value, want):
    r = parse.release_fields(spark.createDataFrame([(value,)], "t string"), "t").first().asDict()
    assert {k: (str(r[k]) if k.endswith(("date", "death")) else r[k]) for k in want} == want


def test_incident_id(spark):
    r = record(spark, dict(person_name="Jane Doe", date_of_death="2025-01-02", facility_or_location="Austin, Texas", death_context="street", sources=[("https://www.reuters.com/x", None)])).first()
    assert r["id"] == str(uuid.uuid5(uuid.UUID(ids.INCIDENTS), "jane doe|2025-01-02|austin, texas"))


MINN = dict(facility_or_location="Duluth, Minnesota", death_context="street")
RELEASE = [("https://www.ice.gov/r/1", "official_release")]
#: name of the case: existing record, incoming record
MERGES = {
    "record-1": (
        dict(id="record-1", person_name="Jane Doe", date_of_death="2025-01-02", death_context="detention", agency="ICE", summary_1_sentence="Initial.", sources=[("https://apnews.com/a", None)]),
        dict(id="record-1", person_name="Jane Doe", date_of_death="2025-01-02", death_context="street", agency="unknown", summary_1_sentence="Updated.", sources=[("https://www.pbs.org/b", None)]),
    ),
    "same-day": (
        dict(id="same-day", person_name="Lena Stone", date_of_death="2026-01-11", **MINN, sources=[("https://www.reuters.com/a", None)]),
        dict(id="in-1", person_name="Lena Marie Stone", date_of_death="2026-01-11", **MINN, summary_1_sentence="Updated.", sources=[("https://apnews.com/b", None)]),
    ),
    "near-day": (
        dict(id="near-day", person_name="Anna Maria Roe", date_of_death="2026-01-16", **MINN, sources=[("https://www.nbcnews.com/a", None)]),
        dict(id="in-2", person_name="Anna Roe", date_of_death="2026-01-19", **MINN, summary_1_sentence="Updated.", sources=[("https://www.nbcnews.com/b", None)]),
    ),
    "by-url": (
        dict(id="by-url", person_name="Pedro Ivan Salas Montes", date_of_death="2026-01-05", death_context="detention", sources=RELEASE),
        dict(id="in-3", person_name="Pedro Ivan Salas-Montes", date_of_death="2025-12-23", death_context="detention", summary_1_sentence="Updated.", sources=RELEASE),
    ),
}


def test_merge(spark):
    base, new = zip(*MERGES.values())
    out = {r["id"]: r for r in incidents.merge_records(record(spark, *base), record(spark, *new)).collect()}
    assert set(out) == set(MERGES)
    assert {r["summary_1_sentence"] for r in out.values()} == {"Updated."}
    assert {k: len(r["sources"]) for k, r in out.items()} == {"record-1": 2, "same-day": 2, "near-day": 2, "by-url": 1}
    assert {r["change"] for r in out.values()} == {"updated"}
    r = out["record-1"]
    assert (r["death_context"], r["agency"]) == ("detention", "ICE")
    assert "summary_1_sentence" in {c["field"] for c in r["changes"]}


TRIPLET = "title string, who string, what string, `where` string, published_at string, url string, source string"


def test_leads(spark):
    rows = [("Protestors", "https://www.reuters.com/x"), ("Lena Stone", ""), ("family representative", "https://www.nbcnews.com/x"), ("Lena Stone", "https://www.reuters.com/x")]
    df = spark.createDataFrame([("A story", who, "was shot", "Duluth, Minnesota", "2026-01-11T12:00:00Z", url, "Reuters") for who, url in rows], TRIPLET)
    assert [r["person_name"] for r in incidents.from_triplets(df, DAY).collect()] == ["Lena Stone"]


def test_index(spark):
    src = {"sources": [("https://www.reuters.com/x", None)]}
    df = record(
        spark,
        dict(id="a", person_name="A", date_of_death="2025-01-02", death_context="detention", homicide_status="suspected", **src),
        dict(id="b", person_name="B", date_of_death="2026-03", death_context="street", homicide_status="unknown", **src),
        dict(id="c", person_name="C", date_of_death="2026", death_context="street", homicide_status="ruled_homicide", **src),
    )
    got = {(r["facet"], r["value"]): r["n"] for r in incidents.index(df).collect()}
    assert got["year", "2025"] == 1 and got["year", "2026"] == 2
    assert got["context", "detention"] == 1 and got["context", "street"] == 2
    assert got["homicide_status", "ruled_homicide"] == 1
    r = df.select(dates.partial(F.col("date_of_death")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert [str(x) for x in r] == ["2025-01-02", "2026-03-01"]


def test_rules_of_one_record(spark):
    street = dict(person_name="Jane Doe", date_of_death="2026-01-10", death_context="street", confidence_score=80)
    out = record(
        spark,
        street | {"id": "few", "sources": [(f"https://{h}/x", "news") for h in ("www.reuters.com", "www.nbcnews.com")]},
        street | {"id": "both", "sources": [(f"https://{h}/x", "news") for h in ("apnews.com", "www.nbcnews.com")]},
        dict(id="jail", person_name="Sample Name", date_of_death="2025-05-12", facility_or_location="St. Louis County Jail", death_context="detention", city="United States Notifications. Passes away at a hospital after being admitted in Houston", state="Texas", sources=RELEASE),
        dict(id="office", person_name="Inspector General", date_of_death="2026-01-29", death_context="detention", sources=RELEASE),
        dict(id="family", person_name="family representative", date_of_death="2026-01-29", death_context="street", sources=[("https://apnews.com/x", "news")]),
    ).cache()
    r = {x["id"]: x for x in out.collect()}
    assert (r["few"]["manual_review"], r["few"]["confidence_score"]) == (True, 45)
    assert (r["both"]["manual_review"], r["both"]["confidence_score"]) == (False, 90)
    assert (r["jail"]["facility_name"], r["jail"]["location_category"], r["jail"]["city"], r["jail"]["state"]) == ("St. Louis County Jail", "facility", None, "Texas")
    assert {x["id"] for x in incidents.drop_unnamed(out).collect()} == {"few", "both", "jail"}


def test_collapse(spark):
    chain = dict(person_name="Ann Mary Doe", **MINN)
    rows = [
        dict(id="a1", person_name="Rafael Gomez Ortiz", date_of_death="2025-10-23", death_context="detention", facility_or_location="Victor Valley Medical Center", sources=[("https://www.ice.gov/a.pdf", "official_report")]),
        dict(id="a2", person_name="Rafael Gomez-Ortiz", date_of_death="2025-10-23", death_context="detention", sources=[("https://www.ice.gov/b", "official_release")]),
        dict(id="b1", person_name="Lena Marie Stone", date_of_death="2026-01-16", **MINN, sources=[("https://www.nbcnews.com/a", "news")]),
        dict(id="b2", person_name="Lena Marie Stone", date_of_death="2026-01-19", **MINN, sources=[("https://www.nbcnews.com/b", "news")]),
        # only pairs with the first of a cluster count: c3 is near c2 but not near c1
        *[dict(chain, id=f"c{i}", date_of_death=d, sources=[(f"https://apnews.com/{i}", None)]) for i, d in ((1, "2025-01-01"), (2, "2025-01-12"), (3, "2025-01-24"))],
    ]
    df = record(spark, *rows).cache()
    out = {r["id"]: r for r in incidents.collapse(df).collect()}
    assert sorted(k[0] for k in out) == ["a", "b", "c", "c"]
    a, b = (next(r for k, r in out.items() if k[0] == x) for x in "ab")
    assert a["facility_or_location"] == "Victor Valley Medical Center" and len(a["sources"]) == 2
    assert b["date_of_death"] == "2026-01-16" and len(b["sources"]) == 2
    assert {(r["first_id"], r["second_id"]) for r in incidents.duplicate_pairs(df).collect()} == {("a1", "a2"), ("b1", "b2"), ("c1", "c2"), ("c2", "c3")}


def test_reports_to_records(spark):
    df = spark.createDataFrame(
        [("Jane Doe", "2025-10-20", "Mesa Detention Center, Mesa, AZ", "Desert Medical Center, Tempe, AZ", ["https://www.ice.gov/x.pdf"])],
        "person_name string, date_of_death string, initial_custody_location string, facility_or_location string, report_urls array<string>",
    ).withColumn("death_location", F.col("facility_or_location"))
    r = incidents.from_reports(df, DAY).first()
    assert r["initial_custody_location"].startswith("Mesa") and r["death_location"].startswith("Desert") and r["facility_or_location"].startswith("Desert")


def test_fill_only(spark):
    schema = "id string, facility string, urls array<string>"
    old, new = spark.createDataFrame([("x", None, ["a"])], schema), spark.createDataFrame([("x", "F", ["b"])], schema)
    assert M.fill_only(old, new, "id", unions=["urls"]).first().asDict() == dict(id="x", facility="F", urls=["a", "b"])


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (lambda c: dates.rfc822(c).cast("string"), "Tue, 02 Jan 2024 03:04:05 +0000", "2024-01-02 03:04:05"),
        (lambda c: dates.compact(c).cast("string"), "20240102T030405Z", "2024-01-02 03:04:05"),
        (lambda c: dates.from_url(c).cast("string"), "https://x.org/2024/01/02/story", "2024-01-02"),
        (lambda c: dates.from_url(c).cast("string"), "https://x.org/story", None),
        (lambda c: dates.textual(c).cast("string"), "Posted Sept. 3, 2024 by", "2024-09-03"),
        (lambda c: dates.partial(c).cast("string"), "2026-03", "2026-03-01"),
        (text.display_name, "DOE, Jane", "Jane Doe"),
        (text.canonical_name, "José  Núñez-Díaz", "jose nunez diaz"),
        (text.drop_repeat_half, "Paris Paris", "Paris"),
        (urls.host, "https://www.Example.com:80/x", "example.com"),
        (lambda c: urls.join_url(F.lit("https://a.org/x/y"), c), "../z", "https://a.org/x/../z"),
        (lambda c: urls.join_url(F.lit("https://a.org/x/y"), c), "/z", "https://a.org/z"),
        (lambda c: F.array_join(structured.string_list(c), "|"), '["a"," b"]', "a|b"),
        (lambda c: F.array_join(structured.string_list(c), "|"), "a, b,", "a|b"),
        (lambda c: structured.json_array_in(c, "array<struct<who:string>>")[0]["who"], 'Sure: [{"who": "x"}] done', "x"),
        (lambda c: F.array_join(classify.states(c), "|"), "In West Virginia and texas", "Texas|West Virginia"),
        (structured.html_text, "<p>a&amp;b<script>x</script> <b>c</b></p>", "a&b c"),
    ],
)
def test_scalars(spark, expr, value, want):
    assert one(spark, value, expr) == want


def test_bbox():
    assert geo.parse_bbox("-10,0,10,5") == (-10.0, 0.0, 10.0, 5.0)
    with pytest.raises(ValueError):
        geo.parse_bbox("10,0,-10,5")
