"""Fields from semi-structured reports and releases, as expressions over their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ids, text

_NAME = r"[A-ZÀ-Þ][\p{L}.'’-]+(?: (?:[A-ZÀ-Þ][\p{L}.'’-]*|de|del|la)){1,4}"


def field(c: Column, label: str) -> Column:
    """What stands after `label:` on its line."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^\s*{label}\s*:\s*(.+?)\s*$", 1)), F.lit(""))


def facility(c: Column) -> Column:
    """Facility that a person was moved to or died at, with an abbreviation in brackets."""
    flat = text.squeeze(c)
    noun = r"((?:[A-Z][\w.'-]*\s+){1,7}(?:Center|Facility|Jail|Prison|Hospital)(?:\s*\([A-Z]+\))?)"
    return F.nullif(F.coalesce(*[F.nullif(F.regexp_extract(flat, p + noun, 1), F.lit("")) for p in (r"(?:to|at) the ", r"(?:to|at) ")], F.lit("")), F.lit(""))


def reports(df: DataFrame, col: str, url: str, min_year: int = 0) -> DataFrame:
    """Labelled-text reports as records; those without name or date of death, or of earlier years, go."""
    c = F.col(col)
    raw = F.coalesce(field(c, "Detainee Death Report"), field(c, "Name"))
    died = dates.textual(field(c, "Date of Death"))
    out = df.select(
        text.display_name(raw).alias("person_name"),
        raw.alias("name_raw"),
        F.date_format(dates.textual(field(c, "Date of Birth")), "yyyy-MM-dd").alias("date_of_birth"),
        F.date_format(died, "yyyy-MM-dd").alias("date_of_death"),
        F.regexp_extract(field(c, "Age"), r"(\d+)", 1).try_cast("int").alias("age"),
        field(c, "(?:Sex|Gender)").alias("gender"),
        field(c, "Country of Citizenship").alias("country_of_citizenship"),
        facility(c).alias("facility_or_location"),
        F.lit("detention").alias("death_context"),
        F.array(F.col(url)).alias("report_urls"),
    ).where("person_name is not null and date_of_death is not null")
    out = out.where(dates.year_of(F.col("date_of_death")).cast("int") >= min_year)
    return out.withColumn("id", ids.uuid5(F.concat_ws("|", F.lower("person_name"), "date_of_death")))




def tidy_release(c: Column) -> Column:
    """Release text in one line, with headings that ran together taken apart and months without dots."""
    t = F.regexp_replace(F.regexp_replace(c, "[–—]", "—"), r"\s+", " ")
    t = F.regexp_replace(t, r"((?:19|20)\d{2})(?=[A-Z]{2})", "$1 ")
    t = F.regexp_replace(t, r"([A-Z]{2})(DETAINEE )", "$1 $2")
    return F.regexp_replace(t, r"(?i)\b(jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.", "$1")


DEATH = r"(?is)\b(?:died|passed away|pronounced (?:dead|deceased)|was found (?:dead|unresponsive))\b"


def death_sentence(c: Column) -> Column:
    """The sentence that tells of the death best: by score, then position."""
    scored = F.transform(
        text.sentences(c),
        lambda s, i: F.struct(
            (
                F.when(s.rlike(DEATH), 4).otherwise(0) + F.when(s.rlike(r"\d{1,3}-year-old"), 2).otherwise(0) + F.when(s.rlike(_NAME + r","), 2).otherwise(0) + F.when(s.rlike(rf"(?i){dates.MONTH} \d"), 1).otherwise(0)
            ).alias("points"),
            (-i).alias("place"),
            s.alias("sentence"),
        ),
    )
    best = F.array_max(scored)
    return F.when(best["points"] >= 4, best["sentence"])


def release_fields(df: DataFrame, col: str) -> DataFrame:
    """Unstructured releases: name, date of death, age, nationality, place, release date, whether still investigated."""
    t = df.withColumn("__el_t", tidy_release(F.col(col)))
    t = t.withColumn("__el_s", death_sentence(F.col("__el_t"))).withColumn("release_date", dates.textual(F.col("__el_t")))
    s, all_ = F.col("__el_s"), F.col("__el_t")
    city_upper = F.regexp_extract(all_, r"(?:^|\d{4} )([A-Z][A-Z .'-]+?), ([A-Z]{2})\b", 1)
    state_upper = F.regexp_extract(all_, r"(?:^|\d{4} )([A-Z][A-Z .'-]+?), ([A-Z]{2})\b", 2)
    from_name = F.nullif(F.regexp_extract(all_, rf"({_NAME}), an? \d{{1,3}}-year-old", 1), F.lit(""))
    from_sentence = F.nullif(F.regexp_extract(s, rf"({_NAME}),", 1), F.lit(""))
    after = F.regexp_extract(s, DEATH + "(.*)$", 1)
    dated = dates.textual(after)
    place = F.nullif(F.regexp_extract(s, r" (?:at|in) (?:the )?((?:[A-Z][\w.'-]+ ?){1,7})", 1), F.lit(""))
    out = t.withColumns(
        {
            "person_name": F.coalesce(from_name, from_sentence),
            "date_of_death": F.coalesce(dated, dates.infer_year(after, F.col("release_date")), dates.textual(s)),
            "age": F.regexp_extract(all_, r"([0-9]{1,3})-year-old", 1).try_cast("int"),
            "nationality": F.nullif(F.regexp_extract(all_, r"-year-old[\w\s]*? (?:from|of) ([A-Z][a-z]+(?: [A-Z][a-z]+)?)", 1), F.lit("")),
            "city": F.when(city_upper != "", F.initcap(F.lower(city_upper))),
            "state": F.nullif(state_upper, F.lit("")),
            "facility_or_location": F.trim(place),
            "raw_sentence": s,
            "under_investigation": F.coalesce(all_.rlike(r"(?i)under investigation|being investigated"), F.lit(False)),
        }
    )
    return out.drop("__el_t", "__el_s")
