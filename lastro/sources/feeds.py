"""Feeds, sitemaps and publishing APIs as rows: raw documents in a table, items out.

Broken documents give the items that can still be read, or none; they never fail the job. A null document gives none.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "titulo string, link string, data string, corpo_html string, subtitulo string, categorias array<string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def feed_items(raw: str | None) -> list[tuple]:
    """Items of one RSS or Atom document; of a broken one those that end before the break."""
    if not raw or re.search(r"<!(?:DOCTYPE|ENTITY)\b", raw, re.I):  # declared entities are never expanded
        return []
    raw = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", raw.strip())
    try:
        nodes = [x for x in ET.fromstring(raw).iter() if _local(x.tag) in ("item", "entry")]
    except ET.ParseError:
        nodes = []
        for part in re.findall(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>", raw):
            bare = re.sub(r"<(/?)[\w.-]+:", r"<\1", re.sub(r"\s[\w.-]+:[\w.-]+=(\"[^\"]*\"|'[^']*')", "", part))
            bare = re.sub(r"&(?!#?\w{1,8};)|&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;", bare)
            try:
                nodes.append(ET.fromstring(bare))
            except ET.ParseError:
                continue
    out = []
    for node in nodes:
        texts: dict[str, str] = {}
        categories, alternate = [], None
        for x in node:
            name, text = _local(x.tag), "".join(x.itertext()).strip()
            if name == "category":
                categories.append(text or x.get("term", ""))
            elif name == "link" and x.get("href"):
                if alternate is None and x.get("rel", "alternate") == "alternate":
                    alternate = x.get("href")
            else:
                texts.setdefault(name, text)
        first = lambda *names: next((texts[n] for n in names if texts.get(n)), None)  # noqa: E731, B023
        out.append((first("title"), alternate or first("link") or first("guid", "id"), first("pubdate", "published", "updated", "date"), first("encoded", "content", "description", "summary"), first("subtitle"), [c for c in categories if c]))
    return out


def parse_feeds(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """One row per item of the feed documents in ``raw``, beside the columns ``keep``."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*(pdf[c].iloc[i] for c in keep), *item) for i, text in enumerate(pdf["_raw"]) for item in feed_items(text)]
            yield pd.DataFrame(rows, columns=[*keep, "titulo", "link", "data", "corpo_html", "subtitulo", "categorias"])

    return df.select(*keep, F.col(raw).alias("_raw")).mapInPandas(run, f"{kinds}, {ITEM}" if keep else ITEM)


def parse_posts(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Items of publishing-API answers (JSON arrays of posts); an answer that is no list gives none."""
    rendered = "struct<rendered: string>"
    schema = f"array<struct<title: {rendered}, link: string, date_gmt: string, date: string, content: {rendered}, excerpt: {rendered}>>"
    posts = F.when(F.trim(F.col(raw)).startswith("["), F.from_json(F.col(raw), schema))
    p = df.select(*keep, F.explode(posts).alias("p"))
    return p.select(*keep, F.col("p.title.rendered").alias("titulo"), F.col("p.link").alias("link"), F.coalesce("p.date_gmt", "p.date").alias("data"), F.col("p.content.rendered").alias("corpo_html"), F.col("p.excerpt.rendered").alias("subtitulo"))


def parse_sitemaps(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """(kind, loc, lastmod) of sitemap documents; kind is 'indice' for lists of sitemaps, else 'urlset'."""
    entries = F.regexp_extract_all(F.col(raw), F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)
    kind = F.when(F.col(raw).rlike("<sitemapindex"), "indice").when(F.col(raw).rlike("<urlset"), "urlset").otherwise("")
    e = df.select(*keep, kind.alias("kind"), F.explode(entries).alias("e"))
    loc = F.trim(F.regexp_replace(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1), r"<!\[CDATA\[|\]\]>", ""))
    day = F.regexp_extract("e", r"<lastmod>\s*(\d{4}-\d{2}-\d{2})", 1)
    return e.select(*keep, "kind", loc.alias("loc"), F.when(day != "", day).alias("lastmod")).where("loc <> ''")


def feed_links(html: str) -> F.Column:
    """Addresses of the feeds that a page announces, in page order, distinct."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\b([^>]*type=[\"']application/(?:rss|atom)\+xml[\"'][^>]*)>"), 1)
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"href=[\"']([^\"']+)", 1)), lambda x: x != ""))
