"""Feeds held as text: RSS and JSON answers parsed in Catalyst expressions, and crawls that page until a stop rule.

What fetches is a function of a URL that gives text or None, so that all of this runs on saved files too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured

ARTICLES = "struct<articles:array<struct<url:string,title:string,publishedAt:string,seendate:string,description:string,domain:string>>>"


def rss_items(df: DataFrame, col: str) -> DataFrame:
    """One row an item of RSS text: position, title, link, published (as written), summary; blanks are null."""
    items = F.regexp_extract_all(F.col(col), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)\s*>"), F.lit(1))

    def inside(item: Column, *tags: str) -> Column:
        found = [F.nullif(F.regexp_extract(item, rf"(?is)<{t}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{t}\s*>", 1), F.lit("")) for t in tags]
        return structured.html_text(F.coalesce(*found))

    each = df.select(*[c for c in df.columns if c != col], F.posexplode(items).alias("position", "__el_i"))
    i = F.col("__el_i")
    href = F.nullif(F.regexp_extract(i, r"""(?is)<link\b[^>]*href\s*=\s*["']([^"']+)""", 1), F.lit(""))
    return each.withColumns({"title": inside(i, "title"), "link": F.coalesce(F.nullif(inside(i, "link"), F.lit("")), href), "published": inside(i, "pubDate", "published", "updated"), "summary": inside(i, "description", "summary")}).drop("__el_i")


def json_articles(df: DataFrame, col: str) -> DataFrame:
    """One row an article of a JSON answer, with either service's name for the moment; an answer that can't be read gives none."""
    a = F.explode(F.from_json(F.col(col), ARTICLES)["articles"]).alias("a")
    return df.select(*[c for c in df.columns if c != col], a).select("*", "a.url", "a.title", F.coalesce("a.publishedAt", "a.seendate").alias("published"), F.col("a.description").alias("summary"), "a.domain").drop("a")


def binary_texts(spark: SparkSession, path: str, pages: Callable[[bytes], str | None], pattern: str = "*.pdf") -> DataFrame:
    """(path, text) of binary files by a function from bytes to text, such as a PDF reader; files it can't read give null."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            texts = []
            for data in b["content"]:
                try:
                    texts.append(pages(bytes(data)))
                except Exception:  # noqa: BLE001  a file that can't be read is a null text
                    texts.append(None)
            yield b[["path"]].assign(text=texts)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


def crawl(first: str, fetch: Callable[[str], str | None], page_url: Callable[[str, int], str], keys: Callable[[str], list[str]], stop_keys: set[str], most: int = 50) -> list[str]:
    """Pages of a listing from page 1 on: ends at a page that is missing, that has no new keys, that holds a stop key, or at `most` pages."""
    seen: set[str] = set()
    pages: list[str] = []
    for n in range(1, most + 1):
        text = fetch(page_url(first, n))
        found = set(keys(text)) if text else set()
        if not found - seen:
            break
        pages.append(text)
        seen |= found
        if found & stop_keys:
            break
    return pages
