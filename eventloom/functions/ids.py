"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INCIDENTS = "31f4a5a3-2f5f-4e6f-98b8-1e857de534d6"


def uuid5(name: Column, namespace: str = INCIDENTS) -> Column:
    """RFC 4122 version 5 identifier of a name, equal to that of other implementations."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def incident_id(name: Column, date: Column, place: Column) -> Column:
    key = F.concat_ws("|", *[F.coalesce(F.lower(F.trim(x)), F.lit("unknown")) for x in (name, date, place)])
    return uuid5(key)
