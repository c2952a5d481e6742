"""JSON and HTML held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_list(c: Column) -> Column:
    """A JSON array of strings, or else a comma list, as an array without blanks."""
    plain = F.split(F.coalesce(c, F.lit("")), ",")
    return F.filter(F.transform(F.coalesce(F.from_json(c, "array<string>"), plain), lambda x: F.trim(x)), lambda x: x != "")


def json_array_in(c: Column, schema: str) -> Column:
    """Objects of the JSON array between a text's first [ and last ]; null where it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit("")), schema)


def json_object_in(c: Column, schema: str) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def json_strings(c: Column, keys: tuple[str, ...] = ("articleBody", "body", "text", "description")) -> Column:
    """Values of the named string fields anywhere in a text that holds JSON."""
    return F.regexp_extract_all(c, F.lit('"(?:' + "|".join(sorted(keys)) + r')"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))


def json_ld(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1))


def map_total(c: Column) -> Column:
    """Sum of a JSON object's values, those that aren't numbers left out."""
    values = F.map_values(F.from_json(c, "map<string,string>"))
    return F.aggregate(F.transform(values, lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def unescape(c: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def html_text(c: Column) -> Column:
    """Visible text of an HTML fragment."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def main_content(c: Column) -> Column:
    """Text of the article or main element, else of the body, else of the whole page."""
    inside = lambda tag: F.nullif(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))
    return html_text(F.coalesce(inside("article"), inside("main"), inside("body"), c))


def links(c: Column) -> Column:
    """Array of (href, text) of a page's links, each once."""
    whole = F.regexp_extract_all(c, F.lit(r"(?is)(<a\b[^>]*href\s*=.*?</a>)"), F.lit(1))
    pair = lambda a: F.struct(F.regexp_extract(a, r"""(?is)href\s*=\s*["']?([^"'\s>]*)""", 1).alias("href"), html_text(a).alias("text"))
    return F.array_distinct(F.transform(whole, pair))


def published_meta(c: Column) -> Column:
    """Publishing time of a page from its meta tags or first time element."""
    meta = F.regexp_extract(c, r"""(?is)<meta[^>]*(?:published_time|datePublished|pubdate)[^>]*content\s*=\s*["']([^"']+)""", 1)
    tag = F.regexp_extract(c, r"""(?is)<time[^>]*datetime\s*=\s*["']([^"']+)""", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(meta, F.lit(""))), F.try_to_timestamp(F.nullif(tag, F.lit(""))))


def before_related(c: Column, markers: tuple[str, ...] = ("more from", "read more", "recommended for you", "related articles", "related stories", "trending now")) -> Column:
    """Text up to the first heading of further reading."""
    return F.rtrim(F.regexp_replace(c, r"(?is)\b(?:" + "|".join(sorted(markers)) + r")\b.*$", ""))
