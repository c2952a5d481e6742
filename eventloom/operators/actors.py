"""Who did what: aliases of actors, finished and unfinished actions, rewriting a table under new names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates


def aliased(df: DataFrame, who: str, aliases: DataFrame) -> DataFrame:
    """df with the display name of each actor that the table (alias, display) knows, without case; others are trimmed, null and blank stay."""
    known = aliases.groupBy(F.lower("alias").alias("__el_alias")).agg(F.min("display").alias("__el_display"))
    joined = df.join(known, F.lower(F.trim(df[who])) == F.col("__el_alias"), "left")
    named = F.coalesce("__el_display", F.coalesce(F.nullif(F.trim(who), F.lit("")), F.col(who)))
    return joined.withColumn(who, named).drop("__el_alias", "__el_display")


def without_unfinished(df: DataFrame, who: str, base: Column, unfinished: Column) -> DataFrame:
    """Without unfinished actions of which the same actor has a finished one with the same base."""
    rows = df.withColumns({"__el_who": F.lower(F.trim(who)), "__el_base": base, "__el_open": F.coalesce(unfinished, F.lit(False))})
    done = rows.where("not __el_open and __el_who <> '' and __el_base <> ''").select("__el_who", "__el_base").distinct()
    opened = rows.where("__el_open").join(done, ["__el_who", "__el_base"], "left_anti")
    return rows.where("not __el_open").unionByName(opened).select(*df.columns)


def rewritten(df: DataFrame, changes: dict[str, Column], keys: list[str], newest: str, tie: str) -> DataFrame:
    """The table under normalised columns, one row a key: the newest, null last, the first by tie where equal."""
    out = df.withColumns({k: F.coalesce(c, F.col(k)) for k, c in changes.items()})
    return aggregates.first_per_key(out, keys, F.col(newest).desc_nulls_last(), tie)
