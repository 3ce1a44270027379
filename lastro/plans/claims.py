"""Queries of claim shaping and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastro.functions import claims as c
from lastro.plans.text import _plain
from lastro.session import table


def b11_first_sentence(s, d):
    return table(s, d, "checagens").select("checagem_id", c.first_sentence(F.col("trecho")).alias("frase"))


def b15_unframed(s, d):
    return table(s, d, "v6_pool").select("rid", c.unframed(F.col("text_no_url")).alias("texto"))


def b16_polarity(s, d):
    return table(s, d, "checagens").where("titulo IS NOT NULL").select("checagem_id", c.polarity(F.col("titulo")).alias("p")).select("checagem_id", "p.core", "p.negated")


def b17_claims(s, d):
    return table(s, d, "v6_pool").select("rid", F.posexplode(c.split_claims(F.col("text_no_url"))).alias("pos", "afirmacao"))


def b18_masked(s, d):
    return table(s, d, "v6_pool").select("rid", c.masked(F.col("text_no_url")).alias("texto"))


def e02_navigation(s, d):
    return table(s, d, "extracao").where("length(trim(texto)) > 0").groupBy("metodo").agg(F.count("*").alias("n"), F.count_if(c.navigation(F.col("texto"))).alias("navegacao"))


def e03_paragraphs(s, d):
    """The paragraphs of texts put into markup, read back."""
    html = F.concat(F.lit("<html><nav><p>menu</p></nav><p>"), F.regexp_replace("texto", "\n", "</p>\n<p class='x'>"), F.lit("</p><script>p()</script></html>"))
    return table(s, d, "extracao").where("length(trim(texto)) > 0 AND NOT contains(texto, '&') AND NOT contains(texto, '<')").select("extracao_id", F.size(c.paragraphs(html)).alias("n"))


def e07_anchor(s, d):
    return table(s, d, "corpo_lido").where("length(texto_completo) > 0 AND titulo IS NOT NULL").select("corpo_id", F.round(c.anchored(F.col("titulo"), F.col("texto_completo")), 6).alias("ancora"))


QUERIES = {f.__name__: f for f in (b11_first_sentence, b15_unframed, b16_polarity, b17_claims, b18_masked, e02_navigation, e03_paragraphs, e07_anchor)}

_N = "len(regexp_extract_all(' ' || regexp_replace(lower(titulo), '[^\\p{L}]+', '  ', 'g') || ' ', ' não '))"
_FRAMED = "regexp_extract(titulo, '(?i)^(?:é falso que|não há provas de que|é enganoso dizer que|vídeo não mostra que)\\s+(.*)$', 1)"
SQL = {
    "b11_first_sentence": "SELECT checagem_id, left(CASE WHEN f <> '' THEN f ELSE trim(trecho) END, 250) frase FROM (SELECT *, regexp_extract(trim(trecho), '^(.*?[.!?])(?:\\s|$)', 1) f FROM checagens)",
    "b15_unframed": "WITH t AS (SELECT rid, text_no_url, trim(regexp_replace(regexp_replace(regexp_replace(text_no_url, '(?i)" + c.FRAMES + "', ''), '(?i)" + c.TIME_WORDS + "', '', 'g'), '\\s+', ' ', 'g')) o FROM v6_pool) SELECT rid, CASE WHEN len(string_split(o, ' ')) < 3 THEN text_no_url ELSE o END texto FROM t",
    "b16_polarity": f"SELECT checagem_id, CASE WHEN f <> '' THEN f WHEN n = 1 THEN trim(regexp_replace(regexp_replace(' ' || titulo || ' ', '(?i)([^\\p{{L}}])não,?([^\\p{{L}}])', '\\1\\2'), '\\s+', ' ', 'g')) ELSE titulo END core, f <> '' OR n = 1 negated FROM (SELECT *, {_FRAMED} f, {_N} n FROM (SELECT checagem_id, replace(titulo, chr(160), ' ') titulo FROM checagens WHERE titulo IS NOT NULL))",
    "b17_claims": "WITH t AS (SELECT rid, list_filter(string_split(regexp_replace(trim(text_no_url), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 25)[1:3] c FROM v6_pool) SELECT rid, (i - 1)::INTEGER pos, c[i] afirmacao FROM (SELECT rid, c, unnest(range(1, len(c) + 1)) i FROM t)",
    "b18_masked": "SELECT rid, regexp_replace(regexp_replace(regexp_replace(text_no_url, 'https?://\\S+', '[URL]', 'g'), '[0-9][0-9.,]*', '[NUM]', 'g'), '\\p{Lu}\\p{Ll}+(?:\\s+\\p{Lu}\\p{Ll}+)+', '[NOME]', 'g') texto FROM v6_pool",
    "e02_navigation": "WITH t AS (SELECT metodo, list_filter(string_split(texto, chr(10)), lambda x: length(trim(x)) > 0) l, len(regexp_split_to_array(trim(texto), '\\s+')) w, len(regexp_extract_all(texto, '[.!?](?:\\s|$)')) s FROM extracao WHERE length(trim(texto)) > 0) SELECT metodo, count(*) n, count(*) FILTER ((len(l) >= 8 AND len(list_filter(l, lambda x: length(x) < 40)) > .6 * len(l)) OR (w >= 80 AND s < .01 * w)) navegacao FROM t GROUP BY 1",
    "e03_paragraphs": "SELECT extracao_id, least(60, len(list_filter(string_split(texto, chr(10)), lambda x: length(trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) >= 40)))::INTEGER n FROM extracao WHERE length(trim(texto)) > 0 AND NOT contains(texto, '&') AND NOT contains(texto, '<')",
    "e07_anchor": f"WITH t AS (SELECT corpo_id, list_distinct(list_filter(string_split({_plain('titulo')}, ' '), lambda x: x <> '')) a, string_split({_plain('texto_completo')}, ' ') b FROM corpo_lido WHERE length(texto_completo) > 0 AND titulo IS NOT NULL) SELECT corpo_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END, 6) ancora FROM t",
}
