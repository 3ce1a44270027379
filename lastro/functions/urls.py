"""Address functions: canonical form, registrable domain, deduplication key, reasons to leave a page out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track, and two-level public suffixes.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|dclid|msclkid|igshid|mc_cid|mc_eid|ref|origem)(=|$)"
SUFFIXES = ["com.br", "gov.br", "org.br", "jus.br", "edu.br", "net.br", "leg.br", "mil.br", "com.pt", "co.uk"]
SOCIAL = ["facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "youtube.com", "t.me", "whatsapp.com"]


def host(url: Column) -> Column:
    """Lower-case host without www, amp or m, each of them only while two dots or more are in the host."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), r"^(?:www\.(?=[^.]*\.))?(?:amp\.(?=[^.]*\.))?(?:m\.(?=[^.]*\.))?", "")


def path(url: Column) -> Column:
    """Path without a trailing slash or /amp."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r"(/amp)?/*$", "")


def kept_query(url: Column) -> Column:
    """Query parameters without tracking ones, in order."""
    q = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")


def canonical(url: Column) -> Column:
    """https, host, path and sorted query without tracking; no fragment; null for what is no address."""
    q = kept_query(url)
    return F.when(host(url) != "", F.concat(F.lit("https://"), host(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def registrable(url: Column) -> Column:
    """Domain under the public suffix, by a short list of two-level suffixes."""
    parts = F.split(host(url), r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return F.when(last(2).isin(SUFFIXES), last(3)).otherwise(last(2))


def dedupe_key(url: Column) -> Column:
    """Host and path, lower case, without file endings."""
    return F.lower(F.concat(host(url), F.regexp_replace(path(url), r"\.(html|ghtml|htm|php)$", "")))


def discard_reason(url: Column) -> Column:
    """Why a page is not read: social host, document file, listing, home page; null for articles."""
    p = F.lower(path(url))
    return F.when(registrable(url).isin(SOCIAL), "rede_social").when(p.rlike(r"\.(pdf|docx?|xlsx?)$"), "documento").when(p.rlike(r"/(tag|tags|autor|author|busca|search|categoria)(/|$)"), "listagem").when(p.rlike(r"/(page|pagina)/\d+$"), "paginacao").when(p == "", "inicial").when(p.rlike(r"^/[a-z-]+$") & (kept_query(url) == ""), "secao")
