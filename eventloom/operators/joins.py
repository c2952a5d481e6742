"""Joins that lookups in dictionaries and lists amount to.

A dimension is broadcast by Spark's own threshold, never by a hint: its size is then known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def first_match(rows: DataFrame, catalog: DataFrame, on: Column, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Left join that keeps for each row the first matching catalog row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.join(catalog, on, "left").withColumn("__el_rn", F.row_number().over(w)).where("__el_rn = 1").drop("__el_rn")


def first_contained(rows: DataFrame, text: str, key: Sequence[str], catalog: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """First catalog row of which any of the names is a substring of the row's text.

    The distinct texts alone meet the catalog, and the winner is an aggregate (min_by), so that the pairs of the
    nested loop are never shuffled; the result is joined back on the text.
    """
    found = F.lit(False)
    for n in names:
        found = found | F.contains(F.lower(F.col("__el_text")), F.lower(F.col(n)))
    fields = [c for c in catalog.columns if c != order]
    texts = rows.select(F.col(text).alias("__el_text")).distinct()
    best = texts.join(catalog, found, "inner").groupBy("__el_text").agg(F.min_by(F.struct(*fields), F.col(order)).alias("__el_hit"))
    out = rows.join(best, rows[text].eqNullSafe(best["__el_text"]), "left")
    return out.select(*[rows[c] for c in rows.columns], *[F.col(f"__el_hit.{c}").alias(c) for c in fields])


def fallback(rows: DataFrame, dim: DataFrame, levels: Sequence[Sequence[str]], value: str, order: str) -> DataFrame:
    """Value of the dimension by the first level of keys that finds one; within a level the first by order."""
    out = rows
    tries = []
    for i, keys in enumerate(levels):
        named = [F.col(k).alias(f"__el_{i}_{k}") for k in keys]
        best = dim.where(F.col(value).isNotNull()).groupBy(*named).agg(F.min_by(value, order).alias(f"__el_v{i}"))
        on = [F.col(k) == F.col(f"__el_{i}_{k}") for k in keys]
        out = out.join(best, on, "left").drop(*[f"__el_{i}_{k}" for k in keys])
        tries.append(F.col(f"__el_v{i}"))
    return out.withColumn(value, F.coalesce(*tries)).drop(*[f"__el_v{i}" for i in range(len(levels))])


def prefer_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which the left table's values win."""
    values = [c for c in left.columns if c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"__el_{c}") for c in values])
    return left.join(r, list(keys), "full").select(*keys, *[F.coalesce(c, f"__el_{c}").alias(c) for c in values])


def as_of(rows: DataFrame, ts: str, bounds: Sequence[tuple[str, str]]) -> Column:
    """Label of the latest boundary (date, label) at or before ts; the boundary table is a literal."""
    out = F.lit(None).cast("string")
    for start, label in sorted(bounds):
        out = F.when(F.col(ts).cast("date") >= F.lit(start).cast("date"), label).otherwise(out)
    return out


def near_in_time(rows: DataFrame, key: str, ts: str, tie: str, days: int) -> DataFrame:
    """Pairs of rows of one key at most so many days apart, the earlier first.

    The key and a bucket of days are the equi-join, so that a busy key is cut into pieces too.
    """
    a = rows.select(F.col(key), F.col(tie).alias("first_id"), F.col(ts).cast("date").alias("first_date"))
    b = rows.select(F.col(key).alias("__el_k"), F.col(tie).alias("second_id"), F.col(ts).cast("date").alias("second_date"))
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1)).cast("long")
    a = a.withColumn("__el_b", bucket(F.col("first_date")))
    b = b.withColumn("__el_b2", F.explode(F.array(*[bucket(F.col("second_date")) + i for i in (-1, 0)])))
    close = (F.datediff("second_date", "first_date") <= days) & (F.struct("first_date", "first_id") < F.struct("second_date", "second_id"))
    return a.join(b, (F.col(key) == F.col("__el_k")) & (F.col("__el_b") == F.col("__el_b2")) & close).drop("__el_k", "__el_b", "__el_b2")


def ranked(rows: DataFrame, targets: DataFrame, rules: Sequence[Sequence[tuple[Column, Column]]], row_id: str, target_id: str) -> DataFrame:
    """(row_id, target_id, rule): for each row the target that the first rule finds, of equals the least id.

    A rule is the pairs (key of a row, key of a target) that must be equal; of a row's key that is an array, any element.
    The targets of equal keys are folded to the least id before they are joined, so that a row meets one of them at
    most, however many match; the best of the rules' union is an aggregate.
    """
    found = None
    for i, rule in enumerate(rules):
        on = [f"__el_k{j}" for j in range(len(rule))]
        near = rows.select(row_id, *[a.alias(k) for (a, _), k in zip(rule, on)])
        for k in on:
            if near.schema[k].dataType.typeName() == "array":
                near = near.withColumn(k, F.explode(k))
        best = targets.select(target_id, *[b.alias(k) for (_, b), k in zip(rule, on)]).groupBy(*on).agg(F.min(F.struct(target_id)).alias("__el_t"))
        hit = near.join(best, on).select(row_id, F.col(f"__el_t.{target_id}").alias(target_id), F.lit(i + 1).alias("rule"))
        found = hit if found is None else found.union(hit)
    best = F.min(F.struct("rule", target_id))
    return found.groupBy(row_id).agg(best.alias("b")).select(row_id, F.col(f"b.{target_id}").alias(target_id), F.col("b.rule").alias("rule"))


def longest_text(rows: DataFrame, wanted: DataFrame, key: str, text: str, tie: str) -> DataFrame:
    """The longest text of each wanted key, of equals that of the least tie."""
    near = rows.join(wanted.select(key).distinct(), key, "left_semi")
    return near.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), -F.col(tie))).alias(text))


def not_blocked(rows: DataFrame, host: str, path: str, blocked: DataFrame) -> DataFrame:
    """Rows whose (host, path) no (host, prefix) blocks; a null prefix blocks the whole host."""
    b = blocked.select(F.col("host").alias("__el_h"), F.col("prefix").alias("__el_p"))
    hit = (F.col(host) == F.col("__el_h")) & (F.col("__el_p").isNull() | F.startswith(F.coalesce(F.col(path), F.lit("/")), F.col("__el_p")))
    return rows.join(b, hit, "left_anti")


def unseen(rows: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a key that is not among the seen ones, one for each key; rows without a key always pass."""
    keyed = rows.where(F.coalesce(F.col(key), F.lit("")) != "").join(seen.select(key), key, "left_anti")
    rest = rows.where(F.coalesce(F.col(key), F.lit("")) == "")
    w = Window.partitionBy(key).orderBy(order)
    one = keyed.withColumn("__el_rn", F.row_number().over(w)).where("__el_rn = 1").drop("__el_rn")
    return one.select(*rows.columns).unionByName(rest)


def same_incident(days_street: int = 14, days_other: int = 180) -> Column:
    """Residual condition of the duplicate join of incidents a and b of one canonical name and context."""
    a, b = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    width = F.when(a("death_context") == "street", days_street).otherwise(days_other)
    same_place = F.coalesce(a("place") == b("place"), F.lit(False))
    one_unknown = (a("place") == "unknown") | (b("place") == "unknown")
    shared = F.coalesce(F.arrays_overlap(a("urls"), b("urls")), F.lit(False))
    same_day = F.coalesce(a("died") == b("died"), F.lit(False))
    return shared | (same_day & (same_place | (a("death_context") == "detention") | one_unknown)) | (same_place & dates.within_days(a("died"), b("died"), width))


def manual_point(df: DataFrame, place: str, points: DataFrame, unless: dict[str, str] | None = None) -> DataFrame:
    """df with the point (lat, lon) of the first key of the table (position, key, lat, lon) that stands in the place as a word.

    unless: of a key, a phrase that it does not stand for (mexico: new mexico).  status is manual, or null.
    """
    low = F.lower(F.col("__el_place"))
    meant = F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower("key"), F.lit(r"\E(?![\p{L}\p{N}_])")))
    for key, phrase in (unless or {}).items():
        meant = meant & ~((F.lower("key") == key) & F.contains(low, F.lit(phrase)))
    asked = df.select(F.col(place).alias("__el_place")).distinct()
    best = asked.join(points, meant).groupBy("__el_place").agg(F.min_by(F.struct("lat", "lon"), "position").alias("__el_p"))
    out = df.join(best, df[place] == best["__el_place"], "left").drop("__el_place")
    return out.withColumns({"lat": F.col("__el_p.lat"), "lon": F.col("__el_p.lon"), "status": F.when(F.col("__el_p").isNotNull(), "manual")}).drop("__el_p")


def by_either_key(rows: DataFrame, key: str, table: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the first row of the table, in order, that has the key in any of its key columns; null where none has."""
    each = table.select(F.explode(F.array_compact(F.array(*[F.nullif(F.col(k), F.lit("")) for k in keys]))).alias("__el_k"), order, *fields)
    first = each.groupBy("__el_k").agg(F.min_by(F.struct(*fields), order).alias("__el_r"))
    return rows.join(first, rows[key] == first["__el_k"], "left").select(*[rows[c] for c in rows.columns], *[F.col(f"__el_r.{f}").alias(f) for f in fields])


def by_first_key(rows: DataFrame, keys: Sequence[str], table: DataFrame, value: str, order: str) -> DataFrame:
    """The value of the table by the first of the rows' keys that finds one; the table has the same key columns."""
    out, tries = rows, []
    for i, k in enumerate(keys):
        first = table.where(F.col(value).isNotNull() & F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__el_k{i}")).agg(F.min_by(value, order).alias(f"__el_v{i}"))
        out = out.join(first, F.col(k) == F.col(f"__el_k{i}"), "left")
        tries.append(F.col(f"__el_v{i}"))
    return out.select(*rows.columns, F.coalesce(*tries).alias(value))


def city_states(rows: DataFrame, city: str, gazetteer: DataFrame) -> DataFrame:
    """A row for each state that the gazetteer (city, states) has for the row's city, without case; one with a null state where it has none."""
    g = gazetteer.select(F.col("city").alias("__el_city"), F.col("states").alias("__el_states"))
    out = rows.join(g, F.lower(F.trim(rows[city])) == F.col("__el_city"), "left")
    return out.select(*rows.columns, F.explode_outer("__el_states").alias("state"))
