"""Changes to tables as joins and aggregates: the new table is a function of the old one and the changes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace on key: of each key the newest row, the new table's among equals.  Nulls in keys count as equal."""
    both = old.withColumn("__el_side", F.lit(0)).unionByName(new.withColumn("__el_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__el_side")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("__el_side"))).alias("r"))
    return best.select(*keys, "r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows only for keys that the old table lacks, one a key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def delete_insert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows of the keys in the new table go, and the new ones come."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def bump(old: DataFrame, new: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Earliest and latest sighting of each key."""
    return old.select(key, first, last).unionByName(new.select(key, first, last)).groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last))


def fill_only(old: DataFrame, new: DataFrame, key: str, unions: Iterable[str] = ()) -> DataFrame:
    """Full outer merge that never overwrites: old values stay, blanks are filled, lists are united and sorted."""
    unions = set(unions)
    values = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"__el_{c}") for c in values])
    have = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    empty = F.array().cast("array<string>")
    pick = lambda c: (
        F.array_sort(F.array_union(F.coalesce(c, empty), F.coalesce(f"__el_{c}", empty))) if c in unions else F.coalesce(have(F.col(c)), F.col(f"__el_{c}"))
    )
    return old.join(n, key, "full").select(key, *[pick(c).alias(c) for c in values])


def overwrite(old: DataFrame, new: DataFrame, key: str, placeholders: Sequence[str] = ("unknown", ""), largest: Iterable[str] = (), any_true: Iterable[str] = ()) -> DataFrame:
    """Full outer merge in which new values win unless they say nothing, with a log of changes.

    A placeholder never replaces a known value.  Columns of `largest` take the greater, of `any_true` the or.
    Adds change (added, updated, same) and changes: array of field, previous and new value.
    """
    largest, any_true = set(largest), set(any_true)
    values = [c for c in old.columns if c != key]
    o = old.select(key, F.lit(True).alias("__el_o"), *values)
    n = new.select(key, F.lit(True).alias("__el_n"), *[F.col(c).alias(f"__el_{c}") for c in values])

    def says(c: Column) -> Column:
        return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin(*placeholders)

    def pick(c: str) -> Column:
        was, now = F.col(c), F.col(f"__el_{c}")
        if c in largest:
            return F.greatest(was, now)
        if c in any_true:
            return F.coalesce(was, F.lit(False)) | F.coalesce(now, F.lit(False))
        return F.when(says(now) | (now.isNotNull() & ~says(was)), now).otherwise(was)

    both = o.join(n, key, "full").withColumns({f"__el_r_{c}": pick(c) for c in values})
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"__el_r_{c}"))
    log = F.array_compact(F.array(*[F.when(changed(c), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("previous_value"), F.col(f"__el_r_{c}").cast("string").alias("new_value"))) for c in values]))
    kind = F.when(F.col("__el_o").isNull(), "added").when(F.col("__el_n").isNotNull() & (F.size(log) > 0), "updated").otherwise("same")
    return both.select(key, *[F.col(f"__el_r_{c}").alias(c) for c in values], kind.alias("change"), F.when(kind == "updated", log).otherwise(F.expr("slice(array(named_struct('field','','previous_value','','new_value','')),1,0)")).alias("changes"))


def backfill(df: DataFrame, col: str, *sources: Column) -> DataFrame:
    """Blanks of a column from the first source that has something."""
    return df.withColumn(col, F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), *sources))


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows of tables of different columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def union_sorted(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def has_all(have: Column, required: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in required]), have)) == 0


def fill_unknown(old: DataFrame, new: DataFrame, key: str, unknown: Sequence[str] = ("", "unknown")) -> DataFrame:
    """Known rows only, with their null, blank or unknown values taken from the new table where that knows them."""
    values = [c for c in old.columns if c != key]
    n = new.groupBy(F.col(key).alias("__el_key")).agg(*[F.first(c, ignorenulls=True).alias(f"__el_{c}") for c in values])
    known = lambda c: F.when(~F.lower(F.trim(F.col(c).cast("string"))).isin(*unknown), F.col(c))
    out = old.join(n, old[key] == n["__el_key"], "left")
    return out.select(key, *[F.coalesce(known(c), known(f"__el_{c}"), F.col(c)).alias(c) for c in values])
