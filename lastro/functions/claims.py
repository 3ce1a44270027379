"""Claims and labels in free text: first sentences, delivery frames, negation, split claims, chunks of HTML, JSON in text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lastro.functions.normalise import plain

# Frames that deliver a rumour, and words that mark time.
FRAMES = r"^(?:urgente!*|atenção!*|acabou de sair:?|repassem:?|gente,|não caiam nessa,|é verdade que|vocês sabiam que)\s+"
TIME_WORDS = r"\b(?:hoje|ontem|anteontem|agora|esta semana|semana passada|este mês)\b"


def first_sentence(c: Column, most: int = 250) -> Column:
    """Text up to the first full stop, question or exclamation mark that ends a sentence, at most ``most`` characters."""
    found = F.regexp_extract(F.trim(c), r"^(.*?[.!?])(?:\s|$)", 1)
    return F.substring(F.when(found != "", found).otherwise(F.trim(c)), 1, most)


def unframed(c: Column) -> Column:
    """Text without the frame that delivers it and without time words; the text itself where fewer than three words would stay."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "(?iu)" + FRAMES, ""), "(?iu)" + TIME_WORDS, ""), r"\s+", " "))
    return F.when(F.size(F.split(out, " ")) < 3, c).otherwise(out)


def polarity(c: Column) -> Column:
    """Struct (core, negated): a claim said false, or with one plain negation, as its affirmative core."""
    c = F.translate(c, "\u00a0", " ")
    framed = F.regexp_extract(c, r"(?iu)^(?:é falso que|não há provas de que|é enganoso dizer que|vídeo não mostra que)\s+(.*)$", 1)
    n = F.regexp_count(F.lower(c), F.lit(r"(?<!\p{L})não(?!\p{L})"))
    single = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?iu)(?<!\p{L})não(?!\p{L})[,]?", ""), r"\s+", " "))
    return F.when(framed != "", F.struct(framed.alias("core"), F.lit(True).alias("negated"))).when(n == 1, F.struct(single.alias("core"), F.lit(True).alias("negated"))).otherwise(F.struct(c.alias("core"), F.lit(False).alias("negated")))


def split_claims(c: Column, most: int = 3, least: int = 25) -> Column:
    """The first ``most`` sentences of more than ``least`` characters."""
    parts = F.split(F.trim(c), r"(?<=[.!?])\s+")
    return F.slice(F.filter(parts, lambda x: F.length(x) > least), 1, most)


def masked(c: Column) -> Column:
    """Addresses, numbers and capitalised names as tags."""
    out = F.regexp_replace(c, r"https?://\S+", "[URL]")
    out = F.regexp_replace(out, r"\d[\d.,]*", "[NUM]")
    return F.regexp_replace(out, r"\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)+", "[NOME]")


def navigation(c: Column) -> Column:
    """Whether a text is navigation: mostly short lines, or very many words with hardly a sentence end."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0)
    short = F.size(F.filter(lines, lambda x: F.length(x) < 40))
    n_words, stops = F.size(F.split(F.trim(c), r"\s+")), F.regexp_count(c, F.lit(r"[.!?](?:\s|$)"))
    return ((F.size(lines) >= 8) & (short > 0.6 * F.size(lines))) | ((n_words >= 80) & (stops < 0.01 * n_words))


def untagged(c: Column) -> Column:
    """HTML as text: scripts and styles dropped, line breaks at block ends, tags stripped, the five basic entities read."""
    out = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b.*?</\1>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr)>", "\n"), r"(?s)<[^>]+>", "")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        out = F.regexp_replace(out, f"&{name};", sign)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n\s*", "\n"))


def paragraphs(html: Column, least: int = 40, most: int = 60) -> Column:
    """Texts of the <p> elements of at least ``least`` characters, at most ``most`` of them."""
    found = F.regexp_extract_all(F.regexp_replace(html, r"(?is)<(script|style|nav|footer|aside)\b.*?</\1>", ""), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    return F.slice(F.filter(F.transform(found, untagged), lambda x: F.length(x) >= least), 1, most)


def page_title(html: Column) -> Column:
    """og:title, else the first h1, else title; at most 300 characters."""
    def first(p: str) -> Column:
        x = F.trim(untagged(F.regexp_extract(html, p, 1)))
        return F.when(x != "", x)

    return F.substring(F.coalesce(first(r"(?is)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)"), first(r"(?is)<h1\b[^>]*>(.*?)</h1>"), first(r"(?is)<title\b[^>]*>(.*?)</title>")), 1, 300)


def _first_value(t: str | None) -> str | None:
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", t or ""):
        try:
            _, end = decoder.raw_decode(t, m.start())
        except ValueError:
            continue
        return t[m.start() : end]
    return None


def first_json(c: Column, schema: str) -> Column:
    """The first JSON object or list in free text, every opening bracket being tried in turn, read by a schema; null where there is none that reads."""

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(_first_value)

    return F.from_json(first(c), schema)


def anchored(claimed: Column, page: Column) -> Column:
    """Share of a value's words that its page holds; 0 for a value without words."""
    w = F.array_distinct(F.filter(F.split(plain(claimed), " "), lambda x: x != ""))
    return F.when(F.size(w) > 0, F.size(F.array_intersect(w, F.split(plain(page), " "))) / F.size(w)).otherwise(F.lit(0.0))
