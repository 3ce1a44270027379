"""Queries of classification lookups, baselines, recall, quotas, gates and stop rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lastro.functions import normalise as n
from lastro.functions import urls as u
from lastro.operators import evidence as ev
from lastro.operators import search as se
from lastro.plans.evidence import _GATE, _INDEX, _PART, _index, _items, _queries
from lastro.plans.metrics import _JUDGED, _judged
from lastro.plans.text import _HOST, _plain
from lastro.session import table

_IT = "(SELECT DISTINCT ON (item_id) * FROM item_evidencia)"
# Patterns of misleading texts, by name.
PATTERNS = {"urgencia": r"\b(?:urgente|atencao|alerta)\b", "apelo": r"\b(?:compartilhe|repassem)\b", "imprensa": r"imprensa nao mostra", "autoridade": r"\b(?:medico|medica|epidemiologista) \w+ \w+ confirmou", "segredo": r"ninguem fala"}
# Platt coefficients of the applied calibration.
PLATT_A, PLATT_B = 1.3, -0.2


def b20_rating(s, d):
    r = F.lower(F.trim(F.coalesce("rating_class", F.lit(""))))
    kind = F.when(r.isin("", "nan"), "none").when(r.startswith("fals"), "false_pure").when(r.startswith("verd"), "true").when(r.startswith("engan") | r.startswith("sem_"), "hard").otherwise("other")
    return table(s, d, "v6_pool").groupBy(kind.alias("classe")).agg(F.count("*").alias("n"))


def b23_patterns(s, d):
    t = n.plain(F.col("text_no_url"))
    return table(s, d, "v6_pool").select("rid", F.array_join(F.filter(F.array(*[F.when(t.rlike(p), k) for k, p in PATTERNS.items()]), lambda x: x.isNotNull()), ",").alias("padroes"))


def d10_display(s, d):
    return table(s, d, "extracao").where("data_pub IS NOT NULL").select("extracao_id", F.date_format(F.try_to_date("data_pub"), "dd/MM/yyyy").alias("dia"))


def f08_tier(s, d):
    tier = F.when(F.col("curada"), "curada").when(F.col("confiabilidade") == "plataforma", "plataforma").when(F.col("confiabilidade").isin("institucional", "alto_trafego"), F.col("confiabilidade")).otherwise("baixo_trafego")
    return table(s, d, "fonte_evidencia").groupBy(tier.alias("nivel")).agg(F.count("*").alias("n"))


def f12_outcome(s, d):
    p = F.col("p")
    return _judged(s, d).groupBy(F.when(p >= 0.75, "falso").when(p <= 0.25, "verdadeiro").otherwise("incerto").alias("resultado")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("y"))


def f13_override(s, d):
    return table(s, d, "fonte_evidencia").select("fonte_id", F.when(~F.isnan("confianca") & (F.col("confianca") >= 0.8), F.coalesce("veredito", F.lit("nenhum"))).otherwise("base").alias("rotulo"))


def h08_containment(s, d):
    t = table(s, d, "corpo_lido").where("length(texto_completo) > 0 AND length(trecho_corpo) > 0")
    a, b = n.word_shingles(F.col("trecho_corpo"), 5), n.word_shingles(F.col("texto_completo"), 5)
    return t.select("corpo_id", a.alias("a"), b.alias("b")).select("corpo_id", F.round(F.when(F.size("a") >= 8, F.size(F.array_intersect("a", "b")) / F.size("a")), 6).alias("contido"))


def h11_independent(s, d):
    t = _items(s, d).where("classe IS NOT NULL").select("consulta_id", u.registrable(F.col("url")).alias("dominio"))
    return t.groupBy("consulta_id").agg(F.countDistinct("dominio").cast("long").alias("independentes"), F.count("*").alias("n"))


def i07_baselines(s, d):
    g = _judged(s, d).agg(F.avg("y").alias("r"), F.count("*").alias("n"))
    return g.select(F.inline(F.array(F.struct(F.lit("sempre_falso").alias("nome"), F.round("r", 6).alias("acuracia"), F.col("n").alias("n")), F.struct(F.lit("sempre_verdadeiro").alias("nome"), F.round(1 - F.col("r"), 6).alias("acuracia"), F.col("n").alias("n")))))


def i20_indicators(s, d):
    t = _items(s, d).withColumn("ok", (ev.gate() == "aplicavel").cast("double"))
    out = t.groupingSets([["classe"], ["confiabilidade"], []], "classe", "confiabilidade").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("aplicavel"), F.grouping_id().cast("int").alias("nivel"))
    return out.select("classe", "confiabilidade", "n", "aplicavel", "nivel")


def i24_recall(s, d):
    found = se.best(_index(s, d), _queries(s, d), 3).where("query = doc")
    total = _queries(s, d).select("query").distinct().agg(F.count("*").alias("n"))
    g = found.agg(F.count_if(F.col("rank") == 1).alias("a"), F.count("*").alias("b"))
    return g.join(total, F.lit(True)).select("n", F.round(F.col("a") / F.col("n"), 6).alias("r1"), F.round(F.col("b") / F.col("n"), 6).alias("r3"))


def i25_padding(s, d):
    t = table(s, d, "v6_pool").select(F.least("word_len", F.lit(192)).alias("t"), "rid")
    b = t.withColumn("b", F.floor((F.row_number().over(Window.partitionBy(F.floor(F.col("rid") / 4096)).orderBy(F.desc("t"), "rid")) - 1) / 32)).withColumn("m", F.floor(F.col("rid") / 4096))
    return b.groupBy("m", "b").agg(F.sum("t").alias("u"), (F.max("t") * F.count("*")).alias("p")).agg(F.sum("u").alias("uteis"), F.sum("p").alias("com_enchimento"))


def i26_signs(s, d):
    t = _items(s, d).where("classe IN ('SUSTENTA','REFUTA')").select("consulta_id", "afirmacao", "cluster_ind", "classe")
    return t.groupBy("classe").agg(F.countDistinct(F.struct("consulta_id", "afirmacao", "cluster_ind")).alias("votos"))


def j09_first(s, d):
    order = F.when(F.col("classe") == "REFUTA", 0).when(F.col("classe") == "SUSTENTA", 1).otherwise(2)
    w = Window.partitionBy("consulta_id").orderBy(order, "url", "item_id")
    return _items(s, d).withColumn("pos", F.row_number().over(w)).where("pos <= 12").select("consulta_id", "item_id", "pos")


def k10_samples(s, d):
    g = _items(s, d).where("classe IS NOT NULL").groupBy("consulta_id", "afirmacao").agg(F.count_if(F.col("classe") == "REFUTA").alias("r"), F.count_if(F.col("classe") == "SUSTENTA").alias("u"), F.count("*").alias("k"))
    return g.select("consulta_id", "afirmacao", F.when((F.col("r") > 0) & (F.col("u") > 0), "RELATA").when(2 * F.col("r") > F.col("k"), "REFUTA").when(2 * F.col("u") > F.col("k"), "SUSTENTA").otherwise("RELATA").alias("voto"))


def l06_split(s, d):
    h = F.sha2(F.col("rid").cast("string"), 256)
    return table(s, d, "v6_pool").select("rid", F.when(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 10 < 7, "a").otherwise("b").alias("lado"))


def m03_ordered(s, d):
    t = _items(s, d).where("alegacoes_checadas IS NOT NULL")
    return t.select("item_id", F.size(F.array_distinct(F.concat("alegacoes_checadas", F.array(F.coalesce("veredito", F.lit("-")))))).alias("n"))


def m04_members(s, d):
    src = table(s, d, "fonte_evidencia").select("url").distinct()
    t = _items(s, d)
    return t.join(src, "url", "left_semi").agg(F.count("*").alias("dentro")).join(t.join(src, "url", "left_anti").agg(F.count("*").alias("fora")), F.lit(True))


def n06_deeper(s, d):
    g = _items(s, d).groupBy("consulta_id").agg(F.avg((F.coalesce("classe", F.lit("")).isin("SUSTENTA", "REFUTA")).cast("double")).alias("p"), F.avg((ev.gate() == "fora_do_tema").cast("double")).alias("q"))
    return g.where("p = 0 AND q > 0.5").select("consulta_id")


def o03_platt(s, d):
    p = F.least(F.greatest("p", F.lit(0.01)), F.lit(0.99))
    z = PLATT_A * F.log(p / (1 - p)) + PLATT_B
    return _judged(s, d).select("item_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p_cal"))


def gates_p02_regression(s, d):
    r = _judged(s, d).agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("acc"), F.avg("y").alias("base"), F.count_if((F.col("p") >= 0.9) & (F.col("y") == 0)).alias("graves"))
    return r.select(F.round("acc", 6).alias("acuracia"), "graves", F.array_join(F.filter(F.array(F.when(F.col("graves") > 5, "graves"), F.when(F.col("acc") < F.greatest(F.col("base"), 1 - F.col("base")), "abaixo_do_trivial")), lambda x: x.isNotNull()), ",").alias("motivos"))


def q04_figures(s, d):
    return table(s, d, "v6_pool").groupBy("era", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "fake").alias("fake"))


QUERIES = {f.__name__: f for f in (b20_rating, b23_patterns, d10_display, f08_tier, f12_outcome, f13_override, h08_containment, h11_independent, i07_baselines, i20_indicators, i24_recall, i25_padding, i26_signs, j09_first, k10_samples, l06_split, m03_ordered, m04_members, n06_deeper, o03_platt, gates_p02_regression, q04_figures)}

_SH = lambda c: f"(SELECT corpo_id, w, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) ELSE [] END g FROM (SELECT corpo_id, string_split({_plain(c)}, ' ') w FROM corpo_lido WHERE length(texto_completo) > 0 AND length(trecho_corpo) > 0))"
_DOMAIN = f"(SELECT consulta_id, CASE WHEN array_to_string(p[-2:],'.') IN ({','.join(repr(x) for x in u.SUFFIXES)}) THEN array_to_string(p[-3:],'.') ELSE array_to_string(p[-2:],'.') END dominio FROM (SELECT consulta_id, string_split({_HOST.format('url')},'.') p FROM {_IT} WHERE classe IS NOT NULL))"
SQL = {
    "b20_rating": "SELECT CASE WHEN r IN ('','nan') THEN 'none' WHEN r LIKE 'fals%' THEN 'false_pure' WHEN r LIKE 'verd%' THEN 'true' WHEN r LIKE 'engan%' OR starts_with(r,'sem_') THEN 'hard' ELSE 'other' END classe, count(*) n FROM (SELECT lower(trim(coalesce(rating_class,''))) r FROM v6_pool) GROUP BY 1",
    "b23_patterns": "SELECT rid, array_to_string(list_filter([" + ",".join(f"CASE WHEN regexp_matches(p,'{p}') THEN '{k}' END" for k, p in PATTERNS.items()) + f"], lambda x: x IS NOT NULL), ',') padroes FROM (SELECT rid, {_plain('text_no_url')} p FROM v6_pool)",
    "d10_display": "SELECT extracao_id, strftime(try_cast(data_pub AS DATE), '%d/%m/%Y') dia FROM extracao WHERE data_pub IS NOT NULL",
    "f08_tier": "SELECT CASE WHEN curada THEN 'curada' WHEN confiabilidade='plataforma' THEN 'plataforma' WHEN confiabilidade IN ('institucional','alto_trafego') THEN confiabilidade ELSE 'baixo_trafego' END nivel, count(*) n FROM fonte_evidencia GROUP BY 1",
    "f12_outcome": f"SELECT CASE WHEN p>=.75 THEN 'falso' WHEN p<=.25 THEN 'verdadeiro' ELSE 'incerto' END resultado, count(*) n, round(avg(y),6) y FROM {_JUDGED} GROUP BY 1",
    "f13_override": "SELECT fonte_id, CASE WHEN NOT isnan(confianca) AND confianca>=.8 THEN coalesce(veredito,'nenhum') ELSE 'base' END rotulo FROM fonte_evidencia",
    "h08_containment": f"SELECT corpo_id, round(CASE WHEN len(a.g)>=8 THEN len(list_intersect(a.g,b.g))/len(a.g) END,6) contido FROM {_SH('trecho_corpo')} a JOIN {_SH('texto_completo')} b USING (corpo_id)",
    "h11_independent": f"SELECT consulta_id, count(DISTINCT dominio) independentes, count(*) n FROM {_DOMAIN} GROUP BY 1",
    "i07_baselines": f"SELECT nome, round(CASE nome WHEN 'sempre_falso' THEN r ELSE 1-r END,6) acuracia, n FROM (SELECT avg(y) r, count(*) n FROM {_JUDGED}), (VALUES ('sempre_falso'),('sempre_verdadeiro')) v(nome)",
    "i20_indicators": f"SELECT classe, confiabilidade, count(*) n, round(avg(({_GATE}='aplicavel')::INT),6) aplicavel, grouping_id(classe,confiabilidade)::INT nivel FROM {_IT} GROUP BY GROUPING SETS ((classe),(confiabilidade),())",
    "i24_recall": f"WITH {_INDEX}, s AS (SELECT query, doc, round(sum(ln((n-df+.5)/(df+.5))*{_PART}),4) score FROM q JOIN df USING (token) JOIN p USING (token) JOIN sz USING (doc), tot GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) k FROM s) SELECT (SELECT count(DISTINCT query) FROM q) n, round(count(*) FILTER (k=1 AND query=doc)/(SELECT count(DISTINCT query) FROM q),6) r1, round(count(*) FILTER (k<=3 AND query=doc)/(SELECT count(DISTINCT query) FROM q),6) r3 FROM r",
    "i25_padding": "WITH b AS (SELECT least(word_len,192) t, rid//4096 m, (row_number() OVER (PARTITION BY rid//4096 ORDER BY least(word_len,192) DESC, rid)-1)//32 b FROM v6_pool) SELECT sum(u)::BIGINT uteis, sum(p)::BIGINT com_enchimento FROM (SELECT sum(t) u, max(t)*count(*) p FROM b GROUP BY m,b)",
    "i26_signs": f"SELECT classe, count(DISTINCT (consulta_id,afirmacao,cluster_ind)) votos FROM {_IT} WHERE classe IN ('SUSTENTA','REFUTA') GROUP BY 1",
    "j09_first": f"SELECT consulta_id, item_id, row_number() OVER (PARTITION BY consulta_id ORDER BY CASE WHEN classe='REFUTA' THEN 0 WHEN classe='SUSTENTA' THEN 1 ELSE 2 END, url, item_id)::INTEGER pos FROM {_IT} QUALIFY pos<=12",
    "k10_samples": f"SELECT consulta_id, afirmacao, CASE WHEN r>0 AND u>0 THEN 'RELATA' WHEN 2*r>k THEN 'REFUTA' WHEN 2*u>k THEN 'SUSTENTA' ELSE 'RELATA' END voto FROM (SELECT consulta_id, afirmacao, count(*) FILTER (classe='REFUTA') r, count(*) FILTER (classe='SUSTENTA') u, count(*) k FROM {_IT} WHERE classe IS NOT NULL GROUP BY 1,2)",
    "l06_split": "SELECT rid, CASE WHEN ('0x'||sha256(rid::VARCHAR)[1:8])::BIGINT % 10 < 7 THEN 'a' ELSE 'b' END lado FROM v6_pool",
    "m03_ordered": f"SELECT item_id, (len(list_distinct(list_concat(alegacoes_checadas,[coalesce(veredito,'-')]))) + (list_has_any(list_transform(alegacoes_checadas, lambda x: x IS NULL),[true]))::INT)::INTEGER n FROM {_IT} WHERE alegacoes_checadas IS NOT NULL",
    "m04_members": f"SELECT count(*) FILTER (url IN (SELECT url FROM fonte_evidencia)) dentro, count(*) FILTER (url NOT IN (SELECT url FROM fonte_evidencia)) fora FROM {_IT}",
    "n06_deeper": f"SELECT consulta_id FROM (SELECT consulta_id, avg((coalesce(classe,'') IN ('SUSTENTA','REFUTA'))::INT) p, avg(({_GATE}='fora_do_tema')::INT) q FROM {_IT} GROUP BY 1) WHERE p=0 AND q>.5",
    "o03_platt": f"SELECT item_id, round(1/(1+exp(-({PLATT_A}*ln(c/(1-c))+({PLATT_B})))),6) p_cal FROM (SELECT item_id, least(greatest(p,.01),.99) c FROM {_JUDGED})",
    "gates_p02_regression": f"SELECT round(acc,6) acuracia, graves, array_to_string(list_filter([CASE WHEN graves>5 THEN 'graves' END, CASE WHEN acc<greatest(base,1-base) THEN 'abaixo_do_trivial' END], lambda x: x IS NOT NULL),',') motivos FROM (SELECT avg(((p>=.5)::INT=y)::INT) acc, avg(y) base, count(*) FILTER (p>=.9 AND y=0) graves FROM {_JUDGED})",
    "q04_figures": "SELECT era, channel, count(*) n, count(*) FILTER (label='fake') fake FROM v6_pool GROUP BY 1,2",
}
