"""Queries of string and address functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastro.functions import normalise as n
from lastro.functions import urls as u
from lastro.session import table

_PLAIN = "trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({0},''))),'[^a-z0-9 ]',' ','g'),' +',' ','g'))"
_STOP = "(" + ",".join(f"'{w}'" for w in n.STOP) + ")"


def _plain(c: str) -> str:
    return _PLAIN.format(c)


def _tokens(c: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all({_plain(c)},'[a-z0-9]{{{least},}}'), lambda x: x NOT IN {_STOP})"


def b01_plain(s, d):
    return table(s, d, "v6_pool").select("rid", n.plain(F.col("text_no_url")).alias("plain"))


def b02_ascii(s, d):
    return table(s, d, "v6_pool").select("rid", n.ascii_deleted(F.col("text_no_url")).alias("deleted"), n.ascii_spaced(F.col("text_no_url")).alias("spaced"))


def b07_tokens(s, d):
    return table(s, d, "checagens").select("checagem_id", F.array_join(n.tokens(F.col("titulo")), " ").alias("tokens"))


def b09_shingles(s, d):
    return table(s, d, "v6_pool").select("rid", F.size(n.word_shingles(F.col("text_no_url"))).alias("n_shingles"))


def b12_first_tokens(s, d):
    return table(s, d, "checagens").select("checagem_id", F.array_join(n.first_tokens(F.col("titulo"), 6), " ").alias("consulta"))


def b13_overlap(s, d):
    return table(s, d, "checagens").where("afirmacao_checada IS NOT NULL").select("checagem_id", F.round(n.overlap(F.col("titulo"), F.col("afirmacao_checada")), 6).alias("sobreposicao"))


def b19_era(s, d):
    return table(s, d, "checagens").groupBy(n.era(F.col("data_pub")).alias("era")).agg(F.count("*").alias("n"))


def b21_style(s, d):
    st = n.style(F.col("text_no_url"))
    return table(s, d, "v6_pool").select("rid", st.alias("s")).select("rid", *[F.round(f"s.{c}", 6).alias(c) for c in ("excl", "quest", "ellip", "log_len", "urgency", "polarity")])


def b24_redacted(s, d):
    return table(s, d, "link_lido").select("link_id", n.digest(F.col("texto")).alias("digest"), n.redacted(F.col("texto")).alias("texto"))


def b27_chunks(s, d):
    return table(s, d, "documents").where("length(trim(text)) > 0").select("doc_id", F.posexplode(n.chunks(F.col("text"), 192, 4)).alias("bloco", "t")).select("doc_id", "bloco", F.size(F.split("t", " ")).alias("n_palavras"))


def c01_canonical(s, d):
    return table(s, d, "checagens").select("checagem_id", u.canonical(F.col("url")).alias("canonica"))


def c02_domain(s, d):
    return table(s, d, "fonte_evidencia").groupBy(u.registrable(F.col("url")).alias("dominio")).agg(F.count("*").alias("n"))


def c03_key(s, d):
    return table(s, d, "checagens").select("checagem_id", u.dedupe_key(F.col("url")).alias("chave"))


def c06_reason(s, d):
    return table(s, d, "checagens").select(F.coalesce(u.discard_reason(F.col("url")), F.lit("artigo")).alias("motivo")).groupBy("motivo").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (b01_plain, b02_ascii, b07_tokens, b09_shingles, b12_first_tokens, b13_overlap, b19_era, b21_style, b24_redacted, b27_chunks, c01_canonical, c02_domain, c03_key, c06_reason)}

_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.([^.]*\..*)$', '\1'), '^amp\.([^.]*\..*)$', '\1'), '^m\.([^.]*\..*)$', '\1')"
_PATH = r"regexp_replace(regexp_extract({0}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '(/amp)?/*$', '')"
_QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract({0}, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '" + u.TRACKING + "'))), '&')"
_H, _P, _Q = _HOST.format("url"), _PATH.format("url"), _QUERY.format("url")
_SUFFIX = "(" + ",".join(f"'{x}'" for x in u.SUFFIXES) + ")"
_T = "coalesce(text_no_url,'')"
_HITS = r"len(regexp_extract_all({0}, '\b(?:{1})\b'))"


def _hits(listed: list[str]) -> str:
    return _HITS.format(_plain("text_no_url"), "|".join(listed))


SQL = {
    "b01_plain": f"SELECT rid, {_plain('text_no_url')} AS plain FROM v6_pool",
    "b02_ascii": "SELECT rid, regexp_replace(strip_accents(text_no_url),'[^\\x00-\\x7F]','','g') AS deleted, trim(regexp_replace(regexp_replace(lower(strip_accents(text_no_url)),'[^\\x00-\\x7F]',' ','g'),'\\s+',' ','g')) AS spaced FROM v6_pool",
    "b07_tokens": f"SELECT checagem_id, array_to_string({_tokens('titulo')}, ' ') AS tokens FROM checagens",
    "b09_shingles": f"WITH w AS (SELECT rid, string_split({_plain('text_no_url')}, ' ') AS w FROM v6_pool) SELECT rid, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) ELSE 0 END::INTEGER AS n_shingles FROM w",
    "b12_first_tokens": f"WITH t AS (SELECT checagem_id, {_tokens('titulo')} AS t FROM checagens) SELECT checagem_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:6], ' ') AS consulta FROM t",
    "b13_overlap": f"WITH t AS (SELECT checagem_id, list_distinct({_tokens('titulo', 4)}) AS a, {_tokens('afirmacao_checada', 4)} AS b FROM checagens WHERE afirmacao_checada IS NOT NULL) SELECT checagem_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6) AS sobreposicao FROM t",
    "b19_era": "SELECT CASE WHEN data_pub IS NULL OR NOT regexp_matches(data_pub,'^[0-9]{4}') THEN 'sem_data' WHEN data_pub[1:4]::INT <= 2017 THEN '<=2017' WHEN data_pub[1:4]::INT <= 2022 THEN '2018-2022' ELSE '>=2023' END AS era, count(*) AS n FROM checagens GROUP BY 1",
    "b21_style": f"""
WITH w AS (SELECT rid, text_no_url, CASE WHEN length(trim({_T})) > 0 THEN len(regexp_split_to_array(trim({_T}), '\\s+')) ELSE 0 END AS n,
  {_hits(n.URGENT)} AS u, {_hits(n.POSITIVE)} AS p, {_hits(n.NEGATIVE)} AS g FROM v6_pool)
SELECT rid, round(len(regexp_extract_all({_T}, '!')) / (n + 1), 6) AS excl, round(len(regexp_extract_all({_T}, '\\?')) / (n + 1), 6) AS quest,
  round(len(regexp_extract_all({_T}, '\\.\\.\\.|…')) / (n + 1), 6) AS ellip, round(ln(1 + n), 6) AS log_len, round(100 * u / greatest(n, 1), 6) AS urgency,
  round((p - g) / (p + g + 1e-5), 6) AS polarity FROM w""",
    "b24_redacted": "SELECT link_id, sha256(texto)[1:12] AS digest, regexp_replace(regexp_replace(regexp_replace(texto,'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+','[email]','g'),'\\([0-9]{2}\\) ?[0-9]{4,5}-[0-9]{4}','[telefone]','g'),'(?i)bearer [A-Za-z0-9._-]+','[token]','g') AS texto FROM link_lido",
    "b27_chunks": "WITH w AS (SELECT doc_id, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM documents WHERE length(trim(text)) > 0), b AS (SELECT doc_id, n, unnest(range(0, least(4, ceil(n / 192)::INT))) AS bloco FROM w) SELECT doc_id, bloco::INTEGER AS bloco, least(192, n - bloco * 192)::INTEGER AS n_palavras FROM b",
    "c01_canonical": f"SELECT checagem_id, CASE WHEN {_H} <> '' THEN 'https://' || {_H} || {_P} || CASE WHEN {_Q} <> '' THEN '?' || {_Q} ELSE '' END END AS canonica FROM checagens",
    "c02_domain": f"WITH p AS (SELECT string_split({_H}, '.') AS p FROM fonte_evidencia) SELECT CASE WHEN array_to_string(p[-2:], '.') IN {_SUFFIX} THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS dominio, count(*) AS n FROM p GROUP BY 1",
    "c03_key": f"SELECT checagem_id, lower({_H} || regexp_replace({_P}, '\\.(html|ghtml|htm|php)$', '')) AS chave FROM checagens",
    "c06_reason": f"""WITH p AS (SELECT lower({_P}) AS p, {_Q} AS q FROM checagens)
SELECT CASE WHEN regexp_matches(p, '\\.(pdf|docx?|xlsx?)$') THEN 'documento' WHEN regexp_matches(p, '/(tag|tags|autor|author|busca|search|categoria)(/|$)') THEN 'listagem'
 WHEN regexp_matches(p, '/(page|pagina)/[0-9]+$') THEN 'paginacao' WHEN p = '' THEN 'inicial' WHEN regexp_matches(p, '^/[a-z-]+$') AND q = '' THEN 'secao' ELSE 'artigo' END AS motivo, count(*) AS n FROM p GROUP BY 1""",
}
