"""Text to who/what/where rows.

The extractor is a hook: any DataFrame function that adds `found`, an array of (who, what, where).  The default is a
rule in Catalyst expressions; a model would come in by mapInPandas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, classify

Extractor = Callable[[DataFrame, str], DataFrame]
NEWS = ("arrest", "blocked", "charged", "died", "killed", "marched", "protest", "raid", "rallied", "shot", "sued")
ROUTINE = ("according", "announced", "commented", "noted", "said", "stated", "told")
_WHO = r"((?:[A-ZÀ-Þ][\p{L}'-]+)(?: [A-ZÀ-Þ][\p{L}'-]+){0,3})"


def rule_extractor(df: DataFrame, col: str) -> DataFrame:
    """One triplet a sentence that begins with a name: the name, what follows up to a comma, the place after `in`."""
    sent = F.filter(text.sentences(F.col(col)), lambda s: s.rlike(r"^\s*" + _WHO + r" \p{Ll}"))
    one = lambda s: F.struct(
        F.regexp_extract(s, r"^\s*" + _WHO, 1).alias("who"),
        F.trim(F.regexp_extract(s, r"^\s*" + _WHO + r" ([^,.;!?]+)", 2)).alias("what"),
        F.nullif(F.regexp_extract(s, r"\b[Ii]n ([A-Z][\p{L} ]+?(?:, [A-Z][\p{L} ]+)?)(?=[.,;!?]|$)", 1), F.lit("")).alias("where"),
    )
    return df.withColumn("found", F.transform(sent, one))


def sanitize(df: DataFrame) -> DataFrame:
    """Ordered checks; each names why a row goes, and later ones leave such rows alone."""
    steps: list[tuple[str, Column]] = [
        ("missing_who", F.coalesce(F.trim("who"), F.lit("")) == ""),
        ("missing_what", F.coalesce(F.trim("what"), F.lit("")) == ""),
        ("generic_who", F.lower("who").isin("he", "it", "she", "they", "this", "we")),
        ("sparse_action", F.size(F.split("what", " ")) < 2),
        ("unfinished_action", F.col("what").rlike(r"(?i)\b(?:at|by|for|from|in|of|on|to|with)$")),
    ]
    # an exploded array of one, so that the checks read what is cleaned instead of cleaning it each
    df = df.withColumn("__el_what", F.explode(F.array(text.squeeze(F.col("what")))))
    cleaned = F.struct(text.squeeze(F.col("who")).alias("who"), text.drop_repeat_phrase(F.col("__el_what")).alias("what"), text.drop_repeat_half(F.col("where")).alias("where"))
    out = df.withColumn("__el_x", F.explode(F.array(cleaned))).withColumns({c: F.col(f"__el_x.{c}") for c in ("who", "what", "where")})
    out = out.drop("__el_x", "__el_what").withColumn("drop_reason", F.lit(None).cast("string"))
    for why, bad in steps:
        out = out.withColumn("drop_reason", F.coalesce("drop_reason", F.when(bad, why)))
    return out


def drop_uncompleted(df: DataFrame, key: str) -> DataFrame:
    """Without short actions of which the same actor has a longer one with the same first two words in the story."""
    base = F.substring_index("what", " ", 2)
    w = Window.partitionBy(key, F.lower("who"), base)
    return df.withColumn("__el_max", F.max(F.size(F.split("what", " "))).over(w)).where((F.size(F.split("what", " ")) > 2) | (F.col("__el_max") <= 2)).drop("__el_max")


def triplets(df: DataFrame, key: str, col: str, extractor: Extractor = rule_extractor, per_story: int = 2) -> DataFrame:
    """Extract, clean, drop duplicates (a row without place goes where one with place says the same), and take the best of each story."""
    rows = extractor(df, col).select(key, F.posexplode("found").alias("pos", "x")).select(key, "pos", "x.*")
    rows = sanitize(rows).where("drop_reason is null").drop("drop_reason")
    rows = drop_uncompleted(rows, key)
    same = [key, "__el_who", "__el_what"]
    rows = rows.withColumns({"__el_who": F.lower("who"), "__el_what": F.lower("what")})
    rows = rows.withColumn("__el_placed", aggregates.has_sibling(same, F.col("where").isNotNull())).where(F.col("where").isNotNull() | ~F.col("__el_placed"))
    rows = aggregates.first_per_key(rows, [*same, "where"], "pos")
    rows = rows.withColumn("score", classify.triplet_score(F.col("who"), F.col("what"), NEWS, ROUTINE))
    best = aggregates.top_per_group(rows, [key], per_story, F.desc("score"), "pos")
    return best.select(key, "who", "what", "where", "score", "rank", F.array_join(classify.event_types(F.concat_ws(" ", "who", "what")), ",").alias("event_types"))
