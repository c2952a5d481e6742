"""Incident records: one shape, source rules, identity resolution, duplicates, index."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids, text, urls
from . import classify as C
from . import joins, merge

SOURCE = "struct<url:string,publisher:string,publish_date:string,access_date:string,source_type:string,credibility_tier:string,snippet:string,claim_tags:array<string>>"
FIELDS = [
    ("id", "string"), ("person_name", "string"), ("aliases", "array<string>"), ("nationality", "string"), ("age", "string"), ("gender", "string"),
    ("date_of_death", "string"), ("date_precision", "string"), ("city", "string"), ("county", "string"), ("state", "string"),
    ("initial_custody_location", "string"), ("death_location", "string"), ("facility_or_location", "string"), ("facility_name", "string"),
    ("location_category", "string"), ("lat", "double"), ("lon", "double"), ("death_context", "string"), ("custody_status", "string"),
    ("agency", "string"), ("cause_of_death_reported", "string"), ("manner_of_death", "string"), ("homicide_status", "string"),
    ("investigation_status", "string"), ("suspect_identified", "boolean"), ("suspect_name", "string"), ("suspect_role", "string"), ("suspect_agency", "string"),
    ("suspect_status", "string"), ("summary_1_sentence", "string"), ("confidence_score", "int"), ("manual_review", "boolean"),
    ("primary_report_url", "string"), ("sources", f"array<{SOURCE}>"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)
ALLOWED = ("apnews.com", "cbp.gov", "cbsnews.com", "cnn.com", "dhs.gov", "ice.gov", "nbcnews.com", "npr.org", "nytimes.com", "pbs.org", "reuters.com", "theguardian.com", "washingtonpost.com")
OFFICIAL = ("cbp.gov", "dhs.gov", "ice.gov")
BLOCKED = ("wikipedia.org",)
CORROBORATION = ("apnews.com", "nbcnews.com")
CONTEXTS, AGENCIES = ("detention", "street"), ("CBP", "DHS", "HSI", "ICE")
CUSTODY = ("CBP custody", "detention", "transport", "unknown")
HOMICIDE = ("alleged", "ruled_homicide", "suspected", "unknown")
FACILITY_NOUN = r"(?i)\b(?:center|correctional|facility|jail|penitentiary|prison)\b"


def with_fields(df: DataFrame) -> DataFrame:
    """df with every field of a record; those that it lacks are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in FIELDS])


def place_key(city: str = "city") -> Column:
    have = [text.blank_to_null(F.col(c)) for c in ("facility_or_location", city, "county", "state")]
    return F.lower(F.coalesce(*have, F.lit("unknown")))


def short_place(c: Column, chars: int, words: int) -> Column:
    """A place name, or null where the text is a sentence or has digits."""
    ok = (F.length(c) <= chars) & (F.size(F.split(c, r"\s+")) <= words) & ~c.rlike(r"\d") & ~c.rlike(r"(?i)\b(?:after|before|said|told|was|were|when|where|which|who)\b")
    return F.when(ok, c)


def source_rules(df: DataFrame, required: Sequence[str] = CORROBORATION) -> DataFrame:
    """Review and score by sources: fewer than two cap the score, official with other ones raise it, and news of the
    street needs all the required domains.  Boosts are taken from the score that comes in; apply once to a base score."""
    hosts = lambda c: F.transform(c, lambda s: urls.host(s["url"]))
    n = F.size("sources")
    official = F.size(F.filter("sources", lambda s: urls.in_domains(s["url"], OFFICIAL)))
    news = F.exists("sources", lambda s: s["source_type"] == "news")
    df = df.withColumns({"__el_n": n, "__el_o": official})
    few = F.col("__el_n") < 2
    both = (F.col("__el_o") > 0) & (F.col("__el_o") < F.col("__el_n"))
    conf = F.col("confidence_score")
    df = df.withColumns({"manual_review": F.col("manual_review") | few, "confidence_score": F.when(few, F.least(conf, F.lit(45))).when(both, F.least(F.lit(100), conf + 5)).otherwise(conf)})
    applies = (F.col("death_context") == "street") & F.coalesce(news, F.lit(False))
    full = merge.has_all(hosts(F.col("sources")), required)
    conf = F.col("confidence_score")
    df = df.withColumns(
        {
            "manual_review": F.col("manual_review") | (applies & ~full),
            "confidence_score": F.when(applies & ~full, F.least(conf, F.lit(45))).when(applies, F.least(F.lit(100), conf + 10)).otherwise(conf),
        }
    )
    return df.drop("__el_n", "__el_o")


def primary_url(sources: Column) -> Column:
    of = lambda kind: F.try_element_at(F.filter(sources, lambda s: s["source_type"] == kind), F.lit(1))["url"]
    return F.coalesce(of("official_report"), of("official_release"))


def normalize(df: DataFrame, access_date: str) -> DataFrame:
    """Records in one shape: cleaned fields, guarded enumerations, derived places, a stable id, source rules."""
    c = F.col
    df = with_fields(df)
    strings = [n for n, t in FIELDS if t == "string"]
    df = df.withColumns({n: text.blank_to_null(c(n)) for n in strings})
    keep = lambda s: urls.in_domains(s["url"], ALLOWED) & ~urls.in_domains(s["url"], BLOCKED)
    clean = lambda s: F.struct(
        s["url"].alias("url"), s["publisher"].alias("publisher"), s["publish_date"].alias("publish_date"), F.coalesce(s["access_date"], F.lit(access_date)).alias("access_date"),
        s["source_type"].alias("source_type"), s["credibility_tier"].alias("credibility_tier"), text.trim_words(s["snippet"], 25).alias("snippet"), F.coalesce(s["claim_tags"], F.array().cast("array<string>")).alias("claim_tags"),
    )
    df = df.withColumns(
        {
            "aliases": F.coalesce(F.filter(F.transform("aliases", lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>")),
            "sources": F.coalesce(F.transform(F.filter("sources", keep), clean), F.array().cast(f"array<{SOURCE}>")),
            "city": short_place(c("city"), 60, 4),
            "state": short_place(c("state"), 30, 3),
            **{n: F.when((F.length(c(n)) <= 120) & (F.size(F.split(c(n), r"\s+")) <= 14), c(n)) for n in ("initial_custody_location", "death_location", "facility_or_location")},
            "death_context": C.enum(c("death_context"), CONTEXTS, "street"),
            "custody_status": C.enum(c("custody_status"), CUSTODY, "unknown"),
            "agency": C.enum(c("agency"), AGENCIES, "unknown"),
            "homicide_status": C.enum(c("homicide_status"), HOMICIDE, "unknown"),
            "manual_review": F.coalesce(c("manual_review"), F.lit(False)),
        }
    )
    facility = F.when((c("death_context") == "detention") | c("facility_or_location").rlike(FACILITY_NOUN), c("facility_or_location"))
    df = df.withColumn("facility_name", F.coalesce("facility_name", facility))
    kind = F.when(c("facility_name").isNotNull(), "facility").when(c("death_context") == "street", "street").otherwise("unknown")
    named = text.is_person_name(c("person_name"))
    unnamed = (c("death_context") == "street") & F.exists("sources", lambda s: F.coalesce(s["source_type"] == "news", F.lit(False))) & ~named
    df = df.withColumns(
        {
            "location_category": F.when(c("location_category").isin("facility", "street"), c("location_category")).otherwise(kind),
            "person_name": F.when(unnamed, None).otherwise(c("person_name")),
            "manual_review": c("manual_review") | unnamed,
            "confidence_score": C.clamp(F.when(unnamed, F.least(F.coalesce("confidence_score", F.lit(0)), F.lit(35))).otherwise(c("confidence_score"))),
            "suspect_identified": F.coalesce("suspect_identified", F.when(c("suspect_name").isNotNull() | c("suspect_role").isNotNull(), True)),
            "date_precision": F.coalesce("date_precision", dates.precision(c("date_of_death"))),
        }
    )
    df = df.withColumn("id", F.coalesce("id", ids.incident_id(c("person_name"), c("date_of_death"), place_key())))
    df = source_rules(df)
    own = F.when(urls.in_domains(c("primary_report_url"), ALLOWED), c("primary_report_url"))
    return df.withColumn("primary_report_url", F.coalesce(primary_url(c("sources")), own)).select(*[n for n, _ in FIELDS])


def keyed(df: DataFrame) -> DataFrame:
    """Records with what identity is judged by: canon, ends (first and last name), place, died, urls."""
    c = F.col
    return df.withColumns(
        {
            "canon": text.canonical_name(c("person_name")),
            "ends": text.first_last_name(c("person_name")),
            "place": place_key(),
            "died": dates.partial(c("date_of_death")),
            "urls": F.array_distinct(F.concat(F.transform("sources", lambda s: s["url"]), F.when(c("primary_report_url").isNotNull(), F.array("primary_report_url")).otherwise(F.array().cast("array<string>")))),
        }
    )


KEYS = ("canon", "ends", "place", "died", "urls")


def resolve(incoming: DataFrame, existing: DataFrame, days: int = 7) -> DataFrame:
    """(incoming_id, existing_id, rule): by id; name and date; first and last name, date and place; name within days; first and last
    name within days; a shared URL.  Each rule is an equi-join; URLs are exploded, so that none is a nested loop."""
    cols = ("id", "person_name", "date_of_death", *KEYS)
    i = keyed(incoming).select(*[F.col(c).alias(f"i_{c}") for c in cols]).withColumnRenamed("i_id", "incoming_id")
    e = keyed(existing).select(*[F.col(c).alias(f"e_{c}") for c in cols]).withColumnRenamed("e_id", "existing_id")
    same = lambda c: (F.col(f"i_{c}"), F.col(f"e_{c}"))
    near = (F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda n: F.date_add("i_died", n)), F.col("e_died"))
    rules = [
        [(F.col("incoming_id"), F.col("existing_id"))],
        [(F.lower("i_person_name"), F.lower("e_person_name")), same("date_of_death")],
        [same("ends"), same("date_of_death"), same("place")],
        [same("canon"), near],
        [same("ends"), near],
    ]
    best = joins.ranked(i, e, rules, "incoming_id", "existing_id")
    by_url = i.select("incoming_id", F.explode("i_urls").alias("u")).join(e.select("existing_id", F.explode("e_urls").alias("u")), "u")
    by_url = by_url.groupBy("incoming_id").agg(F.min("existing_id").alias("existing_id")).withColumn("rule", F.lit(6))
    return best.unionByName(by_url.join(best.select("incoming_id"), "incoming_id", "left_anti"))


def merge_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing records with the incoming ones merged in, and change and changes (see merge.overwrite).

    Incoming rows are resolved against existing ones as a set; those of one target come in order of id.  Rows
    that match only each other are left to collapse().
    """
    found = resolve(incoming, existing)
    aimed = incoming.join(found.select(F.col("incoming_id").alias("id"), "existing_id"), "id", "left").withColumn("id", F.coalesce("existing_id", "id")).drop("existing_id")
    rest = [n for n, _ in FIELDS if n not in ("id", "sources", "aliases")]
    known = lambda c: F.col(c).isNotNull() & ~F.lower(F.col(c).cast("string")).isin("unknown", "")
    one = aimed.groupBy("id").agg(
        *[F.max_by(c, F.struct(known(c), F.col("confidence_score"), F.col("date_of_death"))).alias(c) for c in rest],
        F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )
    # a street context or an unknown place is what a record has by default, and so says nothing
    one = one.withColumn("death_context", F.when(F.col("death_context") == "street", "unknown").otherwise(F.col("death_context"))).withColumn("location_category", F.when(F.col("location_category") == "street", "unknown").otherwise(F.col("location_category")))
    old_sources = existing.select("id", F.col("sources").alias("__el_s"), F.col("aliases").alias("__el_a"))
    empty = F.array().cast(f"array<{SOURCE}>")
    fresh = F.filter("sources", lambda s: ~F.exists(F.coalesce("__el_s", empty), lambda o: o["url"] == s["url"]))
    one = one.join(old_sources, "id", "left").withColumn("sources", F.concat(F.coalesce("__el_s", empty), fresh)).withColumn("aliases", F.array_sort(F.array_union(F.coalesce("__el_a", F.array().cast("array<string>")), "aliases"))).drop("__el_s", "__el_a")
    keep_name = existing.select("id", F.col("person_name").alias("__el_p"), F.col("date_of_death").alias("__el_d"))
    one = one.join(keep_name, "id", "left").withColumn("person_name", F.coalesce("__el_p", "person_name")).withColumn("date_of_death", F.coalesce("__el_d", "date_of_death")).drop("__el_p", "__el_d")
    names = [n for n, _ in FIELDS]
    merged = merge.overwrite(existing.select(*names), one.select(*names), "id", largest=["confidence_score"], any_true=["manual_review"])
    return merged.withColumn("death_context", F.when(F.col("death_context") == "unknown", "street").otherwise(F.col("death_context"))).withColumn("location_category", F.when((F.col("location_category") == "unknown") & (F.col("death_context") == "street"), "street").otherwise(F.col("location_category")))


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """(first_id, second_id) of records that are one by name, context and the residual rules of joins.same_incident."""
    k = keyed(df).where("canon is not null").select("id", "death_context", *KEYS)
    on = (F.col("a.canon") == F.col("b.canon")) & (F.col("a.death_context") == F.col("b.death_context")) & (F.col("a.id") < F.col("b.id")) & joins.same_incident()
    return k.alias("a").join(k.alias("b"), on).select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))


def collapse(df: DataFrame) -> DataFrame:
    """Greedy star clusters inside one name and context: in order of id, a record takes all later ones that duplicate it; the best of the
    cluster stays, filled up from the others.  Names that come once never leave the JVM."""
    names = [n for n, _ in FIELDS]
    k = keyed(df.select(*names)).withColumn("group", F.when(F.col("canon").isNotNull(), F.concat_ws("|", "canon", "death_context")))
    size = k.where("group is not null").groupBy("group").agg(F.count("*").alias("__el_n")).where("__el_n > 1")
    alone = k.join(size, "group", "left_anti").select(*names)
    several = k.join(size.select("group"), "group", "left_semi")
    several = several.withColumn("died", F.col("died").cast("string")).withColumn("named", text.is_person_name(F.col("person_name")))
    return alone.unionByName(several.groupBy("group").applyInPandas(_collapse_group, SCHEMA))


def _collapse_group(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values("id", kind="stable").to_dict("records")
    left, out = list(range(len(rows))), []
    while left:
        head, *rest = left
        cluster = [head, *[i for i in rest if _same(rows[head], rows[i])]]
        best = max(cluster, key=lambda i: (_quality(rows[i]), -i))
        one = rows[best]
        for i in cluster:
            if i != best:
                one = _fill(one, rows[i])
        out.append(one)
        left = [i for i in rest if i not in cluster]
    return pd.DataFrame(out, columns=[n for n, _ in FIELDS])


def _blank(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or (not hasattr(v, "__len__") and pd.isna(v)) or (hasattr(v, "__len__") and len(v) == 0)


def _same(a: dict, b: dict) -> bool:
    if set(a["urls"]) & set(b["urls"]):
        return True
    place, other = a["place"], b["place"]
    day, other_day = a["date_of_death"], b["date_of_death"]
    if not _blank(day) and day == other_day and (a["death_context"] == "detention" or place == other or "unknown" in (place, other)):
        return True
    if place != other or place == "unknown" or _blank(a["died"]) or _blank(b["died"]):
        return False
    return abs((pd.Timestamp(a["died"]) - pd.Timestamp(b["died"])).days) <= (14 if a["death_context"] == "street" else 180)


def _quality(r: dict) -> tuple:
    kinds = {s["source_type"] for s in r["sources"]}
    return "official_report" in kinds, r["place"] != "unknown", 0 if _blank(r["confidence_score"]) else r["confidence_score"]


def _fill(one: dict, other: dict) -> dict:
    new = {k: (other[k] if _blank(v) else v) for k, v in one.items()}
    days = [r for r in (one, other) if not _blank(r["died"])]
    if days:
        new["date_of_death"] = min(days, key=lambda r: r["died"])["date_of_death"]
    if other["named"] and not one["named"]:
        new["person_name"] = other["person_name"]
    new["manual_review"] = bool(one["manual_review"]) or bool(other["manual_review"])
    new["confidence_score"] = max(one["confidence_score"], other["confidence_score"])
    new["aliases"] = sorted({*one["aliases"], *other["aliases"]})
    have = {s["url"] for s in one["sources"]}
    new["sources"] = [*one["sources"], *[s for s in other["sources"] if s["url"] not in have]]
    return new


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Without records of news or releases that have no likely person name."""
    soft = F.exists("sources", lambda s: F.coalesce(s["source_type"].isin("news", "official_release"), F.lit(False)))
    return df.where(~(soft & ~text.is_person_name(F.col("person_name"))))


def index(df: DataFrame) -> DataFrame:
    """(facet, value, n) by year, context and homicide status."""
    from . import aggregates

    named = df.select(dates.year_of(F.col("date_of_death")).alias("year"), F.col("death_context").alias("context"), "homicide_status")
    return aggregates.index_counts(named, ["year", "context", "homicide_status"])


def from_triplets(df: DataFrame, access_date: str, years: tuple[int, int] = (2025, 2026)) -> DataFrame:
    """Records of the triplets that tell of a named person's death and have an allowed source."""
    blob = F.concat_ws(" ", "title", "who", "what")
    day = F.coalesce(F.to_date(F.try_to_timestamp(F.col("published_at"))), F.lit(None).cast("date"))
    lead = df.where(blob.rlike(C.LEAD) & text.is_person_name(F.col("who")) & urls.in_domains(F.col("url"), ALLOWED) & F.year(day).between(*years))
    place = F.split(F.col("where"), r",\s*")
    source = F.struct(F.col("url").alias("url"), F.col("source").alias("publisher"), day.cast("string").alias("publish_date"), F.lit(access_date).alias("access_date"), F.lit("news").alias("source_type"), F.lit(None).cast("string").alias("credibility_tier"), F.concat_ws(" ", "who", "what").alias("snippet"), F.array().cast("array<string>").alias("claim_tags"))
    return normalize(
        lead.select(
            F.col("who").alias("person_name"),
            day.cast("string").alias("date_of_death"),
            F.try_element_at(place, F.lit(1)).alias("city"),
            F.try_element_at(place, F.lit(2)).alias("state"),
            C.context(blob).alias("death_context"),
            text.ladder(blob, C.AGENCY, "unknown").alias("agency"),
            text.ladder(blob, C.CUSTODY, "unknown").alias("custody_status"),
            text.ladder(blob, C.MANNER).alias("manner_of_death"),
            text.ladder(blob, C.INVESTIGATION).alias("investigation_status"),
            C.suspect_identified(blob).alias("suspect_identified"),
            F.concat_ws(" ", "who", "what").alias("summary_1_sentence"),
            C.confidence(blob, F.col("who"), ["border patrol", "immigration", "ice"]).alias("confidence_score"),
            F.array(source).alias("sources"),
        ),
        access_date,
    )


def from_reports(df: DataFrame, access_date: str, kind: str = "official_report", score: int = 90, min_year: int = 2025) -> DataFrame:
    """Records of parsed reports (or, with kind official_release and score 85, of releases)."""
    source = lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("publish_date"), F.lit(access_date).alias("access_date"), F.lit(kind).alias("source_type"), F.lit("official").alias("credibility_tier"), F.lit(None).cast("string").alias("snippet"), F.array().cast("array<string>").alias("claim_tags"))
    df = df.where(dates.year_of(F.col("date_of_death")).cast("int") >= min_year)
    df = df.withColumns({"sources": F.transform("report_urls", source), "confidence_score": F.lit(score), "death_context": F.lit("detention"), "custody_status": F.lit("detention"), "agency": F.lit("ICE")})
    return normalize(df.drop("report_urls"), access_date)

