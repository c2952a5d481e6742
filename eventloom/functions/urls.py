"""Hosts, domains and paths of URLs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(c: Column) -> Column:
    """Host of a URL in lower case, without port and www."""
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def bare_host(c: Column) -> Column:
    """Host of a URL, or of a text that is only a host and path."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")
    return F.when(c.rlike("(?i)^https?://"), host(c)).otherwise(F.regexp_replace(F.substring_index(plain, "/", 1), r":\d+$", ""))


def path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))


def matches_domain(h: Column, domain: Column | str) -> Column:
    """Host is the domain or lies below it."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (h == d) | F.endswith(h, F.concat(F.lit("."), d))


def in_domains(c: Column, domains: Iterable[str]) -> Column:
    """URL's host is one of the domains or below one; false without a host."""
    h = host(c)
    return F.coalesce(F.exists(F.array(*[F.lit(d) for d in sorted(set(domains))]), lambda d: matches_domain(h, d)), F.lit(False))


def allowed(c: Column, allow: Iterable[str], block: Iterable[str] = ()) -> Column:
    return in_domains(c, allow) & ~in_domains(c, block) if block else in_domains(c, allow)


def set_page(c: Column, page: Column | int) -> Column:
    """URL or path with its page parameter set."""
    p = page if isinstance(page, Column) else F.lit(page)
    value = F.concat(F.lit("page="), p.cast("string"))
    return (
        F.when(c.rlike(r"[?&]page=\d*"), F.regexp_replace(c, F.lit(r"(?<=[?&])page=\d*"), value))
        .when(F.contains(c, F.lit("?")), F.concat(c, F.lit("&"), value))
        .otherwise(F.concat(c, F.lit("?"), value))
    )


def join_url(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page."""
    scheme = F.regexp_extract(base, "^([A-Za-z]+):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.when(base.rlike(r"^[A-Za-z]+://[^/?#]+/"), F.regexp_extract(base, r"^([A-Za-z]+://[^?#]*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(link.rlike("^[?#]"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link))
        .otherwise(F.concat(folder, F.regexp_replace(link, r"^(?:\./)+", "")))
    )


def feed_name(c: Column) -> Column:
    """Name for a feed that was given as a mere URL."""
    return F.concat(F.lit("custom-"), F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", host(c), path(c))), "[^a-z0-9]+", "-"), "^-|-$", ""))
