"""Queries of lookups, joins, registry, search, decision, sampling and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lastro.functions import normalise as n
from lastro.functions import urls as u
from lastro.operators import evidence as ev
from lastro.operators import near_duplicates as nd
from lastro.operators import registry as rg
from lastro.operators import search as se
from lastro.plans.text import _H, _P, _Q, _plain, _tokens
from lastro.session import table, written

# Labels of fact-checks in plain form and what they say; one agency's own use of a label is switched off.
LABELS = {"falso": "falso", "e falso": "falso", "fake": "falso", "enganoso": "enganoso", "distorcido": "enganoso", "fora de contexto": "enganoso", "exagerado": "enganoso", "verdadeiro": "verdadeiro", "fato": "verdadeiro", "satira": "satira", "sem provas": "sem_evidencia"}
SWITCHED_OFF = [("Agência Deme", "exagerado")]


def _items(s, d):
    return table(s, d, "item_evidencia").dropDuplicates(["item_id"])


def _timed(s, d):
    """Evidence with the days by which its date lies beyond a window of 15 days before its judgement."""
    late = F.datediff(F.to_date("julgado_em"), F.try_to_date("data_pub")) - 15
    return _items(s, d).withColumn("excess", F.when(late.isNotNull(), F.greatest(late, F.lit(0)))).withColumn("window", F.lit(15))


def d03_day(s, d):
    return _items(s, d).select("item_id", F.date_format(F.col("recebido_em") - F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd").alias("dia"))


def d04_window(s, d):
    return table(s, d, "link_lido").select("link_id", ev.window_days(n.plain(F.col("texto"))).cast("double").alias("dias"))


def d06_excess(s, d):
    return _timed(s, d).where("excess IS NOT NULL").select("item_id", "excess")


def d09_best_date(s, d):
    tier = F.when(F.col("data_pub_precisao") == "dia", 5).when(F.col("data_pub_precisao") == "ano", 2).otherwise(4)
    t = _items(s, d).where("data_pub IS NOT NULL")
    return t.groupBy("url").agg(F.max(F.struct(tier.alias("tier"), "data_pub")).alias("b")).select("url", "b.tier", "b.data_pub")


def f01_labels(s, d):
    known = F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])
    key = n.plain(F.col("selo_original"))
    off = F.lit(False)
    for agency, label in SWITCHED_OFF:
        off = off | ((F.col("agencia") == agency) & (key == label))
    return table(s, d, "checagens").select("checagem_id", F.when(~off, F.try_element_at(known, key)).alias("veredito_norm"))


def f02_direction(s, d):
    return table(s, d, "checagens").groupBy("veredito").agg(F.count("*").alias("n"), F.round(F.avg(ev.direction(F.col("veredito"))), 6).alias("direcao"))


def f06_portal(s, d):
    portals = table(s, d, "portais").select("portal_id", F.col("dominio").alias("host"))
    return table(s, d, "link_lido").select("link_id", u.host(F.col("url")).alias("host")).join(F.broadcast(portals), "host", "left").select("link_id", "portal_id")


def f10_gate(s, d):
    return _items(s, d).groupBy(ev.gate().alias("motivo")).agg(F.count("*").alias("n"))


def g02_split_counts(s, d):
    pool = table(s, d, "v6_pool").select("rid", "label")
    side = table(s, d, "v6_splits").select("rid", F.regexp_replace(F.lower(F.trim("split_full_iid")), r"[-\s]+", "_").alias("lado")).distinct()
    return pool.join(side, "rid", "left").groupBy("lado", "label").agg(F.count("*").alias("n"))


def g03_upsert(s, d):
    t = table(s, d, "checagens").select("lote", "checagem_id", u.dedupe_key(F.col("url")).alias("chave"), "origem", "veredito", "titulo")
    old = rg.latest(t.where("lote = 0"), ["chave"], [F.desc("checagem_id")]).drop("lote")
    new = rg.latest(t.where("lote > 0"), ["chave"], [F.desc("checagem_id")]).drop("lote")
    keep_old = (F.col("o_origem") == "manual") | (F.col("o_veredito").isNotNull() & F.col("n_veredito").isNull()) | ((F.col("o_origem") == "claimreview") & (F.col("n_origem") != "claimreview"))
    return rg.upsert(old, new, ["chave"], ~F.coalesce(keep_old, F.lit(False)))


def g04_fusion(s, d):
    t = table(s, d, "fonte_evidencia")
    out = rg.fused(t, u.canonical(F.col("url")), ["tipo_fonte"], ["titulo", "veredito"], "fonte_id")
    return out.select("chave", "n", F.array_join("tipo_fonte", ",").alias("tipos"), "titulo", "veredito")


def h05_clusters(s, d):
    return nd.clusters(table(s, d, "v6_pool"), "rid", "text_no_url").select(F.col("id").alias("rid"), F.col("cluster").alias("classe"))


def h07_majority(s, d):
    t = table(s, d, "v6_pool").withColumn("chave", n.plain(F.col("text_no_url")))
    return nd.majority_kept(t.select("rid", "label", "chave"), "chave", "label", "rid").select("rid", "label")


def h09_title_jaccard(s, d):
    t = table(s, d, "checagens").where("afirmacao_checada IS NOT NULL")
    a, b = F.array_distinct(n.tokens(F.col("titulo"))), F.array_distinct(n.tokens(F.col("afirmacao_checada")))
    return t.select("checagem_id", F.round(n.jaccard(a, b), 6).alias("jaccard"), F.round(n.dice(a, b), 6).alias("dice"))


def h12_cluster_conflicts(s, d):
    g = _items(s, d).where("veredito IS NOT NULL").groupBy("consulta_id", "cluster_ind").agg(F.countDistinct("veredito").alias("v"), F.countDistinct(F.substring("data_pub", 1, 4)).alias("anos"))
    return g.where("v > 1 OR anos > 1")


def _queries(s, d):
    """Claims of every twentieth registry record, as queries against all."""
    return table(s, d, "checagens").where("checagem_id % 20 = 0").select(F.col("checagem_id").alias("query"), F.explode(F.array_distinct(n.tokens(F.col("titulo")))).alias("token"))


def _index(s, d, most=80):
    """Claim, title and excerpt of each registry record, of the excerpt its first ``most`` tokens, or all where None."""
    t, excerpt = table(s, d, "checagens"), n.tokens(F.col("trecho"))
    return se.index(t, "checagem_id", [(n.tokens(F.col("afirmacao_checada")), 3, 0), (n.tokens(F.col("titulo")), 2, 0), (excerpt if most is None else F.slice(excerpt, 1, most), 1, 0)])


def _sentence(c):
    """First sentence of an excerpt, up to a mark before a capital; its first 250 characters where none ends."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^(?:Boato|Hoax)\s*[–—-]\s*", "")
    found = F.regexp_extract(t, r"(?s)^(.+?[.!?])(?=\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ“\"]|\s*$)", 1)
    return F.trim(F.when(found != "", found).otherwise(F.substring(t, 1, 250)))


def j01_bm25(s, d):
    t = table(s, d, "checagens").select("checagem_id", "titulo", "afirmacao_checada", "trecho", _sentence(F.col("trecho")).alias("frase"))
    core = F.concat_ws(" ", "afirmacao_checada", "titulo")
    numbers = lambda c: se.number_tokens(n.numbers(c))
    index = se.index(t, "checagem_id", [
        (n.content_tokens(F.col("afirmacao_checada")), 3, se.CORE | se.WIDE), (n.content_tokens(F.col("titulo")), 2, se.CORE | se.WIDE), (F.slice(n.content_tokens(F.col("trecho")), 1, 80), 1, 0), (n.content_tokens(F.col("frase")), 0, se.WIDE),
        (numbers(core), 0, se.CORE_NUMBER), (numbers(F.concat_ws(" ", core, "frase")), 0, se.WIDE_NUMBER),
    ])
    asked = t.where("checagem_id % 20 = 0")
    queries = asked.select(F.col("checagem_id").alias("query"), F.explode(F.array_distinct(n.content_tokens(F.col("titulo")))).alias("token"))
    return se.registry_search(index, queries, asked.select(F.col("checagem_id").alias("query"), n.numbers(F.col("titulo")).alias("numbers")))


def j02_bm25_plus(s, d):
    return se.best(_index(s, d, None), _queries(s, d), 3, plus=1.0).select("query", "doc", "rank", "score")


def j04_interleave(s, d):
    t = _items(s, d)
    bonus = F.when(F.col("veredito").isNotNull(), 0.3).otherwise(0.0) + F.when(F.coalesce("curada", F.lit(False)), 0.15).otherwise(0.0) + F.when(F.coalesce("agencia", F.lit(False)), 0.1).otherwise(0.0)
    return ev.interleaved(t.withColumn("query", F.concat_ws("/", "consulta_id", "afirmacao")), "query", bonus, "item_id").where("turn <= 12").select("item_id", "turn")


def j06_best(s, d):
    order = F.when(F.col("classe") == "REFUTA", 0).when(F.col("classe") == "SUSTENTA", 1).when(F.col("classe").isNotNull(), 2).otherwise(3)
    return _items(s, d).groupBy("consulta_id", "url").agg(F.min(F.struct(order.alias("ordem"), "item_id")).alias("b")).select("consulta_id", "url", "b.ordem", "b.item_id")


def j07_lag(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(s, d, "events").withColumn("antes", F.lag("ts").over(w))
    return t.where("antes IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("antes").cast("timestamp"))) / 1e6), 2).alias("segundos"))


def j10_sliding(s, d):
    t = table(s, d, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3600, 0)
    return t.select("event_id", F.count("*").over(w).alias("na_hora"))


def k02_contributions(s, d):
    return ev.contributions(_timed(s, d)).where("contribution IS NOT NULL").select("item_id", F.round("contribution", 4).alias("contribuicao"))


def k03_votes(s, d):
    return ev.votes(ev.contributions(_timed(s, d))).select("consulta_id", "afirmacao", "cluster_ind", "vote")


def k05_discounted(s, d):
    t = ev.contributions(_timed(s, d)).where("contribution IS NOT NULL AND excess > 0")
    return t.select("item_id", F.round(ev.discounted(F.col("contribution"), F.col("window"), F.col("excess")), 6).alias("contribuicao"))


def k01_levels(s, d):
    return ev.decide(_timed(s, d)).select("consulta_id", F.round("log_odds", 6).alias("log_odds"), "nivel")


def l01_split(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL")
    w = Window.partitionBy("grupo", "label").orderBy(F.sha2(F.col("rid").cast("string"), 256))
    q = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("grupo", "label"))
    return t.select("rid", F.when(q < 0.7, "train").when(q < 0.8, "val").otherwise("test").alias("lado"))


def l04_balanced(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL")
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("grupo", "label").orderBy(F.sha2(F.col("rid").cast("string"), 256))))
    cells = t.groupBy("grupo", "label").agg(F.count("*").alias("n"))
    mid = cells.agg(F.percentile("n", F.lit(0.5)).alias("mid"))
    return r.join(F.broadcast(mid), F.lit(True)).where("r <= mid").groupBy("grupo", "label").agg(F.count("*").alias("n"))


def l05_quotas(s, d):
    t = table(s, d, "v6_pool").groupBy("channel").agg(F.count("*").alias("n"))
    share = t.withColumn("x", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    share = share.withColumn("base", F.floor("x")).withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.col("x") - F.floor("x")), "channel")))
    left = 100 - F.sum("base").over(Window.partitionBy())
    return share.select("channel", (F.col("base") + F.when(F.col("r") <= left, 1).otherwise(0)).cast("long").alias("quota"))


def l07_per_class(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL AND length(text_no_url) BETWEEN 20 AND 600")
    one = t.groupBy("text_no_url", "label").agg(F.min("rid").alias("rid"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.sha2(F.col("rid").cast("string"), 256)))).where("r <= 50").select("rid", "label")


def m01_union(s, d):
    parts = [table(s, d, t).select(u.canonical(F.col("url")).alias("chave"), F.lit(t).alias("origem")) for t in ("checagens", "fonte_evidencia", "link_lido")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("chave").agg(F.array_join(F.array_sort(F.collect_set("origem")), ",").alias("origens"), F.count("*").alias("n"))


def m02_pruned(s, d):
    t = table(s, d, "checagens").select("checagem_id", "veredito", u.canonical(F.col("url")).alias("chave"))
    listing = table(s, d, "fonte_evidencia").select(u.canonical(F.col("url")).alias("chave"))
    return rg.pruned(t, listing, ["chave"], F.col("veredito").isNull()).select("checagem_id")


def n03_limiter(s, d):
    """Requests with whether a limiter of two an hour per user, which counts every request, lets them pass."""
    t = table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    n_ = F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000 + 1, 0))
    return t.select("event_id", "user_id", (n_ <= 2).alias("passa"))


def n05_stop(s, d):
    t = _items(s, d)
    stance = F.col("classe").isin("SUSTENTA", "REFUTA")
    g = t.groupBy("consulta_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(stance, F.col("cluster_ind"))).alias("c"), F.bool_or(ev.gate() == "aplicavel").alias("ap"))
    return g.select("consulta_id", F.when(F.col("ap"), "veredito").when(F.col("c") >= 2, "posturas").when(F.col("n") >= 12, "teto").otherwise("outra_onda").alias("parada"))


# Signs of a doubtful text and their weights.
SIGNS = [
    (r"(?i)(?:^|[^\p{L}\p{N}_])(?:urgente|compartilhe|repasse|não deixe de|acabou de sair)(?:$|[^\p{L}\p{N}_])", 0.12),
    (r"[A-ZÁÉÍÓÚÇ ]{15,}", 0.08),
    (r"[!?]{2,}", 0.06),
    (r"(?i)(?:^|[^\p{L}\p{N}_])(?:mídia esconde|não querem que você saiba|vazou|bomba)(?:$|[^\p{L}\p{N}_])", 0.15),
]


def o02_score(s, d):
    """0.5 without any sign; else 0.5 and the signs' weights, and 0.05 for texts below thirty words."""
    t = F.coalesce("text_no_url", F.lit(""))
    extra = sum((F.when(t.rlike(p.replace("(?i)", "(?iu)")), w).otherwise(0.0) for p, w in SIGNS), F.lit(0.0))
    words = F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+")))
    p = F.when(extra == 0, 0.5).otherwise(F.least(F.greatest(0.5 + extra + F.when(words < 30, 0.05).otherwise(0.0), F.lit(0.05)), F.lit(0.95)))
    return table(s, d, "v6_pool").select("rid", F.round(p, 3).alias("prob"))


def gates_p01(s, d):
    pool, split = table(s, d, "v6_pool"), table(s, d, "v6_splits")
    a = pool.agg(F.count("*").alias("n"), F.countDistinct("rid").alias("u"), F.count_if(F.col("text_no_url").isNull()).alias("nulos"))
    b = split.join(pool.select("rid"), "rid", "left_anti").agg(F.count("*").alias("orfaos"))
    one = a.join(b, F.lit(True))
    checks = F.array(F.struct(F.lit("rid_unico").alias("nome"), (F.col("n") - F.col("u")).alias("valor")), F.struct(F.lit("texto_nulo").alias("nome"), F.col("nulos").alias("valor")), F.struct(F.lit("sem_registro").alias("nome"), F.col("orfaos").alias("valor")))
    return one.select(F.inline(checks)).select("nome", "valor", (F.col("valor") == 0).alias("ok"))


def gates_p04_forbidden(s, d):
    t = n.plain(F.col("titulo"))
    return table(s, d, "fonte_evidencia").where(t.rlike(r"\b(?:e falso|fake|mentira)\b")).groupBy("portal_id").agg(F.count("*").alias("n"))


def q06_recovered(s, d):
    t = table(s, d, "corpo_lido").where("length(texto_completo) > 0")
    gold, got = F.array_distinct(n.tokens(F.col("texto_completo"))), F.array_distinct(n.tokens(F.col("trecho_corpo")))
    return t.select("corpo_id", F.round(F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, got)) / F.size(gold)).otherwise(0.0), 6).alias("share"))


def q07_unknown(s, d):
    known = table(s, d, "portais").where("tipo = 'geral'").select(F.col("dominio").alias("dominio"))
    t = _items(s, d).where("classe IS NOT NULL").select("consulta_id", u.registrable(F.col("url")).alias("dominio")).distinct().join(F.broadcast(known), "dominio", "left_anti")
    return t.withColumn("r", F.row_number().over(Window.partitionBy("consulta_id").orderBy("dominio"))).where("r <= 2").select("consulta_id", "dominio")


QUERIES = {f.__name__: f for f in (d03_day, d04_window, d06_excess, d09_best_date, f01_labels, f02_direction, f06_portal, f10_gate, g02_split_counts, g03_upsert, g04_fusion, h05_clusters, h07_majority, h09_title_jaccard, h12_cluster_conflicts, j01_bm25, j02_bm25_plus, j04_interleave, j06_best, j07_lag, j10_sliding, k01_levels, k02_contributions, k03_votes, k05_discounted, l01_split, l04_balanced, l05_quotas, l07_per_class, m01_union, m02_pruned, n03_limiter, n05_stop, o02_score, gates_p01, gates_p04_forbidden, q06_recovered, q07_unknown)}

_IT = "(SELECT DISTINCT ON (item_id) * FROM item_evidencia)"
_CANON = f"CASE WHEN {_H} <> '' THEN 'https://' || {_H} || {_P} || CASE WHEN {_Q} <> '' THEN '?' || {_Q} ELSE '' END END"
_KEY = f"lower({_H} || regexp_replace({_P}, '\\.(html|ghtml|htm|php)$', ''))"
_EXC = "CASE WHEN try_cast(data_pub AS DATE) IS NOT NULL THEN greatest(date_diff('day', try_cast(data_pub AS DATE), julgado_em::DATE) - 15, 0) END"
_DIR = "CASE veredito WHEN 'falso' THEN 1.0 WHEN 'enganoso' THEN 0.7 WHEN 'sem_evidencia' THEN 0.4 WHEN 'verdadeiro' THEN -1.0 ELSE 0.0 END"
_case = lambda m, d: "CASE confiabilidade " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE {d} END"
_CONTRIB = f"""i AS (SELECT *, {_EXC} excess, NOT coalesce(motor LIKE 'fallback%', false) AND classe IS NOT NULL AND coalesce(corpo_lido, false) usable, coalesce(agencia,false) AND coalesce(curada,false) ag,
 CASE WHEN isnan(prob_fake_pagina) THEN NULL ELSE prob_fake_pagina END pf FROM {_IT}),
i2 AS (SELECT *, max((usable AND ag AND classe='REFUTA' AND coalesce(excess,0)<=0)::INT) OVER (PARTITION BY consulta_id, afirmacao)=1 muted, CASE WHEN ag AND classe='REFUTA' THEN 1.5 ELSE {_case(ev.STANCE_FACTOR, 0.3)} END base FROM i),
i3 AS (SELECT *, base*(1-least(greatest(coalesce(pf,0),0),1)) w FROM i2),
i4 AS (SELECT *, CASE WHEN w >= .05*base THEN CASE WHEN classe='REFUTA' THEN w WHEN classe='SUSTENTA' AND NOT (muted AND NOT ag) THEN -w END END st,
 CASE WHEN veredito IS NOT NULL AND classe IN ('SUSTENTA','REFUTA') AND coalesce(origem_veredito,'')<>'pagina' AND {_DIR}<>0 THEN {_DIR}*1.5*{_case(ev.LABEL_FACTOR, 0.4)} END lb FROM i3),
c AS (SELECT *, CASE WHEN usable THEN CASE WHEN st IS NULL THEN lb WHEN lb IS NULL THEN st WHEN sign(st)<>sign(lb) THEN NULL WHEN abs(st)>=abs(lb) THEN st ELSE lb END END contribution FROM i4)"""
# Claims with their guards and the level of each query: late items discounted by 15 / (15 + excess), votes of clusters, two caps, conjunction.
_LATE = "CASE WHEN coalesce(excess,0)>0 THEN CASE WHEN abs(sign(contribution)*ln(15/(15+excess)*exp(abs(contribution))+1-15/(15+excess)))>=.05*abs(contribution) THEN sign(contribution)*ln(15/(15+excess)*exp(abs(contribution))+1-15/(15+excess)) END ELSE contribution END"
_GUARD = f"""g1 AS (SELECT consulta_id, afirmacao, coalesce(cluster_ind,url) k, contribution c, {{0}} v, {{1}} past, coalesce(confiabilidade,'') IN ('curada','institucional','alto_trafego') rel FROM c WHERE contribution IS NOT NULL),
g2 AS (SELECT consulta_id, afirmacao, round(sum(v),9) s, max(v) hi, min(v) lo, round(sum(c),9) rs, bool_and(past) late, coalesce(bool_or(v>0 AND rel AND NOT past),false) ru, coalesce(bool_or(v<0 AND rel AND NOT past),false) rd, bool_or(c>0 AND NOT past) cu, bool_or(c<0 AND NOT past) cd FROM g1 GROUP BY 1,2,k),
g3 AS (SELECT *, round(CASE WHEN s>0 THEN hi WHEN s<0 THEN lo END,4) vote FROM g2),
g4 AS (SELECT consulta_id, afirmacao, count(vote) n_votes, count(*) FILTER (rs<>0) n_raw, bool_and(late) late, round(coalesce(sum(vote),0),9) raw, coalesce(bool_or(vote>0 AND ru),false) ru, coalesce(bool_or(vote<0 AND rd),false) rd, coalesce(bool_or(vote>0 AND cu),false) cu, coalesce(bool_or(vote<0 AND cd),false) cd FROM g3 GROUP BY 1,2),
g5 AS (SELECT *, abs(raw)>={ev.TAU} AND NOT CASE WHEN raw>0 THEN ru ELSE rd END unreliable, {{2}} AND abs(raw)>={ev.TAU} AND NOT CASE WHEN raw>0 THEN cu ELSE cd END other_period FROM g4),
g AS (SELECT *, CASE WHEN unreliable OR other_period THEN sign(raw)*.99*{ev.TAU} ELSE raw END l FROM g5)"""
_GUARDED, _UNDISCOUNTED = _GUARD.format(_LATE, "coalesce(excess,0)>0", "true"), _GUARD.format("contribution", "false", "false")
_DECISION = f"""h AS (SELECT *, (n_votes>0 OR (n_raw>0 AND late)) AND late AND abs(l)<{ev.TAU} AND count(*) FILTER (n_votes>0 OR (n_raw>0 AND late)) OVER (PARTITION BY consulta_id)>1 fora FROM g),
j AS (SELECT consulta_id, count(*) FILTER (l>=0) n, max(l) top, least(greatest(1-exp(coalesce(sum(ln(1/(1+exp(l)))) FILTER (l>=0),0)),1e-12),1-1e-12) p FROM h WHERE NOT fora AND n_votes>0 GROUP BY 1),
x AS (SELECT q.consulta_id, CASE WHEN n<=1 THEN top ELSE ln(p/(1-p)) END l, coalesce(f,false) f FROM (SELECT DISTINCT consulta_id FROM item_evidencia) q LEFT JOIN j USING (consulta_id) LEFT JOIN (SELECT consulta_id, bool_or(fora) f FROM h GROUP BY 1) USING (consulta_id)),
y AS (SELECT consulta_id, l, CASE WHEN l IS NULL THEN 'indeterminada' WHEN l>={ev.TAU} THEN 'alta' WHEN l<=-{ev.TAU} THEN CASE WHEN f THEN 'media' ELSE 'baixa' END ELSE 'media' END nivel FROM x)"""
_DECIDED = f", {_DECISION} SELECT consulta_id, round(l,6) log_odds, nivel FROM y"
_FRASE = '(?s)^(.+?[.!?])(?:\\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ“"]|\\s*$)'


def _content(c):
    """Registry search tokens of a column, in SQL."""
    stop = ",".join(f"'{w}'" for w in n.STOP_SEARCH + n.FRAMING)
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({c},'')),'[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_replace(strip_accents(w),'[^\\x00-\\x7F]','','g')), lambda b: length(b) >= CASE WHEN regexp_matches(b,'[0-9]') THEN 2 ELSE 3 END AND b NOT IN ({stop}))"


def _numbers(c):
    """Numbers that stand for themselves, in SQL: separators are doubled, so that each number has its own on both sides."""
    return f"list_distinct(regexp_extract_all(' ' || regexp_replace(coalesce({c},''),'([^\\p{{L}}\\p{{N}}_-])','\\1\\1','g') || ' ','[^\\p{{L}}\\p{{N}}_-]([0-9]+)[^\\p{{L}}\\p{{N}}]',1))"


_VOTES = "v AS (SELECT consulta_id, afirmacao, cluster_ind, round(CASE WHEN s>0 THEN hi WHEN s<0 THEN lo END, 4) vote FROM (SELECT consulta_id, afirmacao, cluster_ind, sum(contribution) s, max(contribution) hi, min(contribution) lo FROM c WHERE contribution IS NOT NULL GROUP BY 1,2,3) WHERE s<>0)"
_GATE = f"CASE WHEN NOT coalesce(corpo_lido,false) THEN 'nao_lido' WHEN classe IS NULL OR coalesce(motor LIKE 'fallback%',false) THEN 'sem_juiz' WHEN classe NOT IN ('SUSTENTA','REFUTA') AND classe NOT LIKE 'RELATA%' THEN 'fora_do_tema' WHEN classe LIKE 'RELATA%' THEN 'relata' WHEN NOT coalesce(citacao_verificada,false) THEN 'sem_citacao' WHEN {_DIR}=0 THEN 'sem_direcao' ELSE 'aplicavel' END"
_INDEX = f"""p AS (SELECT checagem_id doc, token, sum(w) tf FROM (SELECT checagem_id, unnest({_tokens('afirmacao_checada')}) token, 3 w FROM checagens UNION ALL SELECT checagem_id, unnest({_tokens('titulo')}), 2 FROM checagens UNION ALL SELECT checagem_id, unnest(({_tokens('trecho')})[1:80]), 1 FROM checagens) GROUP BY 1,2),
sz AS (SELECT doc, sum(tf) len FROM p GROUP BY 1), tot AS (SELECT count(*) n, avg(len) av FROM sz), df AS (SELECT token, count(*) df FROM p GROUP BY 1),
q AS (SELECT DISTINCT checagem_id query, unnest({_tokens('titulo')}) token FROM checagens WHERE checagem_id % 20 = 0)"""
_PART = "tf*2.5/(tf+1.5*(0.25+0.75*len/av))"

SQL = {
    "d03_day": f"SELECT item_id, strftime(recebido_em - INTERVAL 3 HOUR, '%Y-%m-%d') dia FROM {_IT}",
    "d04_window": "SELECT link_id, list_min(list_filter([" + ",".join(f"CASE WHEN regexp_matches(p,'\\b(?:{p})\\b') THEN {d} END" for p, d in ev.WINDOWS) + f"], lambda x: x IS NOT NULL))::DOUBLE dias FROM (SELECT link_id, {_plain('texto')} p FROM link_lido)",
    "d06_excess": f"SELECT item_id, {_EXC}::INTEGER excess FROM {_IT} WHERE try_cast(data_pub AS DATE) IS NOT NULL",
    "d09_best_date": f"SELECT url, b.tier::INTEGER tier, b.data_pub FROM (SELECT url, max({{'tier': CASE data_pub_precisao WHEN 'dia' THEN 5 WHEN 'ano' THEN 2 ELSE 4 END, 'data_pub': data_pub}}) b FROM {_IT} WHERE data_pub IS NOT NULL GROUP BY 1)",
    "f01_labels": f"SELECT checagem_id, CASE WHEN NOT coalesce(agencia='Agência Deme' AND p='exagerado', false) THEN CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + f" END END veredito_norm FROM (SELECT *, {_plain('selo_original')} p FROM checagens)",
    "f02_direction": f"SELECT veredito, count(*) n, round(avg({_DIR}),6) direcao FROM checagens GROUP BY 1",
    "f06_portal": f"SELECT link_id, p.portal_id FROM (SELECT link_id, {_H} h FROM link_lido) l LEFT JOIN portais p ON p.dominio = l.h",
    "f10_gate": f"SELECT {_GATE} motivo, count(*) n FROM {_IT} GROUP BY 1",
    "g02_split_counts": "SELECT lado, label, count(*) n FROM v6_pool LEFT JOIN (SELECT DISTINCT rid, regexp_replace(lower(trim(split_full_iid)),'[-\\s]+','_','g') lado FROM v6_splits) USING (rid) GROUP BY 1,2",
    "g03_upsert": f"""WITH t AS (SELECT lote, checagem_id, {_KEY} chave, origem, veredito, titulo FROM checagens),
o AS (SELECT DISTINCT ON (chave) * FROM t WHERE lote=0 ORDER BY chave, checagem_id DESC), n AS (SELECT DISTINCT ON (chave) * FROM t WHERE lote>0 ORDER BY chave, checagem_id DESC),
b AS (SELECT coalesce(o.chave,n.chave) chave, o, n, o.chave IS NULL OR (n.chave IS NOT NULL AND NOT coalesce(o.origem='manual' OR (o.veredito IS NOT NULL AND n.veredito IS NULL) OR (o.origem='claimreview' AND n.origem<>'claimreview'), false)) tk FROM o FULL JOIN n ON o.chave=n.chave)
SELECT chave, CASE WHEN tk THEN n.checagem_id ELSE o.checagem_id END checagem_id, CASE WHEN tk THEN n.origem ELSE o.origem END origem, CASE WHEN tk THEN n.veredito ELSE o.veredito END veredito, CASE WHEN tk THEN n.titulo ELSE o.titulo END titulo FROM b""",
    "g04_fusion": f"SELECT chave, count(*) n, array_to_string(list_sort(list_distinct(list(tipo_fonte))), ',') tipos, arg_min(titulo, fonte_id) FILTER (titulo<>'') titulo, arg_min(veredito, fonte_id) FILTER (veredito<>'') veredito FROM (SELECT *, {_CANON} chave FROM fonte_evidencia) WHERE chave<>'' GROUP BY 1",
    "h07_majority": f"WITH t AS (SELECT rid, label, {_plain('text_no_url')} k FROM v6_pool), c AS (SELECT *, count(*) OVER (PARTITION BY k, label) n FROM t), m AS (SELECT *, max(n) OVER (PARTITION BY k) mx FROM c) SELECT rid, label FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN n=mx THEN 0 ELSE 1 END, rid)=1",
    "h09_title_jaccard": f"WITH t AS (SELECT checagem_id, list_distinct({_tokens('titulo')}) a, list_distinct({_tokens('afirmacao_checada')}) b FROM checagens WHERE afirmacao_checada IS NOT NULL) SELECT checagem_id, round(CASE WHEN len(list_distinct(a||b))>0 THEN len(list_intersect(a,b))/len(list_distinct(a||b)) ELSE 0.0 END,6) jaccard, round(CASE WHEN len(a)+len(b)>0 THEN 2*len(list_intersect(a,b))/(len(a)+len(b)) ELSE 0.0 END,6) dice FROM t",
    "h12_cluster_conflicts": f"SELECT * FROM (SELECT consulta_id, cluster_ind, count(DISTINCT veredito) v, count(DISTINCT data_pub[1:4]) anos FROM {_IT} WHERE veredito IS NOT NULL GROUP BY 1,2) WHERE v>1 OR anos>1",
    "j01_bm25": f"""WITH d AS (SELECT checagem_id doc, titulo, afirmacao_checada, trecho, regexp_replace(trim(coalesce(trecho,'')),'^(?:Boato|Hoax)\\s*[–—-]\\s*','') t FROM checagens),
e AS (SELECT *, trim(CASE WHEN regexp_extract(t,'{_FRASE}',1)<>'' THEN regexp_extract(t,'{_FRASE}',1) ELSE t[1:250] END) frase, concat_ws(' ',afirmacao_checada,titulo) cerne FROM d),
o AS (SELECT doc, unnest({_content('afirmacao_checada')}) token, 3 w, 1 c, 1 b FROM e UNION ALL SELECT doc, unnest({_content('titulo')}), 2, 1, 1 FROM e UNION ALL SELECT doc, unnest(({_content('trecho')})[1:80]), 1, 0, 0 FROM e UNION ALL SELECT doc, unnest({_content('frase')}), 0, 0, 1 FROM e),
p AS (SELECT doc, token, sum(w) tf, max(c) core, max(b) wide FROM o GROUP BY 1,2),
sz AS (SELECT doc, sum(tf) len FROM p WHERE tf>0 GROUP BY 1), tot AS (SELECT count(*) n, avg(len) av FROM sz),
i0 AS (SELECT token, ln((n-df+.5)/(df+.5)) idf FROM (SELECT token, count(*) df FROM p WHERE tf>0 GROUP BY 1), tot),
i AS (SELECT token, CASE WHEN idf<0 THEN .25*(SELECT avg(idf) FROM i0) ELSE idf END idf FROM i0),
q AS (SELECT DISTINCT doc query, unnest({_content('titulo')}) token FROM e WHERE doc % 20 = 0), nq AS (SELECT query, count(*) n_q FROM q GROUP BY 1),
al AS (SELECT query, sum(greatest(idf,0)) al FROM q JOIN i USING (token) GROUP BY 1),
s AS (SELECT query, doc, round(sum(idf*{_PART}),4) score, sum(core) nc, sum(wide) nw, sum(greatest(idf,0)*core) cc, sum(greatest(idf,0)*wide) cw FROM q JOIN i USING (token) JOIN p USING (token) JOIN sz USING (doc), tot GROUP BY 1,2),
r AS (SELECT *, max(score) OVER (PARTITION BY query) best, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM s WHERE score>0),
m AS (SELECT query, quantile_cont(score,.5) mid FROM r WHERE rank>1 GROUP BY 1),
u AS (SELECT doc, {_numbers('cerne')} a, {_numbers("concat_ws(' ',cerne,frase)")} b FROM e), un AS (SELECT doc query, list_filter({_numbers('titulo')}, lambda x: NOT (length(x)<=9 AND x::INT BETWEEN 1900 AND 2100)) nums FROM e),
f AS (SELECT r.query, r.doc, score, round(cc/coalesce(nullif(al,0),1),6) cc, round(cw/coalesce(nullif(al,0),1),6) cw, nc, nw, n_q, nums, a, b FROM r LEFT JOIN m USING (query) JOIN nq USING (query) JOIN al USING (query) JOIN u ON u.doc=r.doc JOIN un ON un.query=r.query WHERE score >= round(greatest(4, 2*coalesce(mid,0), .5*best),4)),
g AS (SELECT *, nw>=least(3,n_q) AND cw>=.8 AND (len(nums)=0 OR list_has_any(nums,b)) pw, nc>=least(3,n_q) AND cc>=.6 AND (len(nums)=0 OR list_has_any(nums,a)) pc FROM f)
SELECT query, doc, score, CASE WHEN pw THEN cw ELSE cc END score_rel, (CASE WHEN pw THEN nw ELSE nc END)::BIGINT n_terms FROM g WHERE pw OR pc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)<=5""",
    "j02_bm25_plus": f"WITH {_INDEX}, s AS (SELECT query, doc, round(sum(ln((n+1)/df)*({_PART}+1)),4) score FROM q JOIN df USING (token) JOIN p USING (token) JOIN sz USING (doc), tot GROUP BY 1,2) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER rank, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)<=3",
    "j04_interleave": f"SELECT item_id, row_number() OVER (PARTITION BY consulta_id, afirmacao ORDER BY CASE WHEN veredito IS NOT NULL THEN .3 ELSE 0 END + CASE WHEN coalesce(curada,false) THEN .15 ELSE 0 END + CASE WHEN coalesce(agencia,false) THEN .1 ELSE 0 END DESC, item_id)::INTEGER turn FROM {_IT} QUALIFY turn<=12",
    "j06_best": f"SELECT consulta_id, url, b.o ordem, b.i item_id FROM (SELECT consulta_id, url, min({{'o': CASE WHEN classe='REFUTA' THEN 0 WHEN classe='SUSTENTA' THEN 1 WHEN classe IS NOT NULL THEN 2 ELSE 3 END, 'i': item_id}}) b FROM {_IT} GROUP BY 1,2)",
    "j07_lag": "SELECT event_type, count(*) n, round(avg((epoch_us(ts)-epoch_us(antes))/1e6),2) segundos FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) antes FROM events) WHERE antes IS NOT NULL GROUP BY 1",
    "j10_sliding": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) na_hora FROM (SELECT *, floor(epoch_us(ts)/1000000)::BIGINT t FROM events)",
    "k01_levels": f"WITH {_CONTRIB}, {_GUARDED} {_DECIDED}",
    "k02_contributions": f"WITH {_CONTRIB} SELECT item_id, round(contribution,4) contribuicao FROM c WHERE contribution IS NOT NULL",
    "k03_votes": f"WITH {_CONTRIB}, {_VOTES} SELECT * FROM v",
    "k05_discounted": f"WITH {_CONTRIB}, x AS (SELECT item_id, contribution c, sign(contribution)*ln(15/(15+excess)*exp(abs(contribution))+1-15/(15+excess)) l FROM c WHERE contribution IS NOT NULL AND excess>0) SELECT item_id, round(CASE WHEN abs(l)>=.05*abs(c) THEN l END,6) contribuicao FROM x",
    "l01_split": "SELECT rid, CASE WHEN q<.7 THEN 'train' WHEN q<.8 THEN 'val' ELSE 'test' END lado FROM (SELECT rid, (row_number() OVER (PARTITION BY grupo,label ORDER BY sha256(rid::VARCHAR))-1)/(count(*) OVER (PARTITION BY grupo,label)) q FROM v6_pool WHERE label IS NOT NULL)",
    "l04_balanced": "WITH c AS (SELECT grupo,label,count(*) n FROM v6_pool WHERE label IS NOT NULL GROUP BY 1,2), m AS (SELECT quantile_cont(n,.5) mid FROM c) SELECT grupo,label,least(n,floor(mid))::BIGINT n FROM c, m",
    "l05_quotas": "WITH t AS (SELECT channel, 100.0*count(*)/(SELECT count(*) FROM v6_pool) x FROM v6_pool GROUP BY 1), r AS (SELECT *, floor(x) b, row_number() OVER (ORDER BY x-floor(x) DESC, channel) r FROM t) SELECT channel, (b + CASE WHEN r <= 100-(sum(b) OVER ()) THEN 1 ELSE 0 END)::BIGINT quota FROM r",
    "l07_per_class": "WITH o AS (SELECT text_no_url, label, min(rid) rid FROM v6_pool WHERE label IS NOT NULL AND length(text_no_url) BETWEEN 20 AND 600 GROUP BY 1,2) SELECT rid, label FROM o QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(rid::VARCHAR))<=50",
    "m01_union": f"SELECT chave, array_to_string(list_sort(list_distinct(list(origem))),',') origens, count(*) n FROM (SELECT {_CANON} chave, 'checagens' origem FROM checagens UNION ALL SELECT {_CANON}, 'fonte_evidencia' FROM fonte_evidencia UNION ALL SELECT {_CANON}, 'link_lido' FROM link_lido) GROUP BY 1",
    "m02_pruned": f"SELECT checagem_id FROM (SELECT *, {_CANON} chave FROM checagens) WHERE veredito IS NOT NULL OR chave IN (SELECT {_CANON} FROM fonte_evidencia)",
    "n03_limiter": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)<=2 passa FROM (SELECT *, epoch_us(ts) t FROM events)",
    "n05_stop": f"SELECT consulta_id, CASE WHEN ap THEN 'veredito' WHEN c>=2 THEN 'posturas' WHEN n>=12 THEN 'teto' ELSE 'outra_onda' END parada FROM (SELECT consulta_id, count(*) n, count(DISTINCT CASE WHEN classe IN ('SUSTENTA','REFUTA') THEN cluster_ind END) c, bool_or({_GATE}='aplicavel') ap FROM {_IT} GROUP BY 1)",
    "o02_score": "SELECT rid, CASE WHEN e=0 THEN .5 ELSE round(least(greatest(.5+e+CASE WHEN n<30 THEN .05 ELSE 0 END,.05),.95),3) END::DOUBLE prob FROM (SELECT rid, " + " + ".join(f"CASE WHEN regexp_matches(coalesce(text_no_url,''), '{p}') THEN {w} ELSE 0 END" for p, w in SIGNS) + " e, CASE WHEN trim(coalesce(text_no_url,''))='' THEN 0 ELSE len(regexp_split_to_array(trim(text_no_url),'\\s+')) END n FROM v6_pool)",
    "gates_p01": "SELECT nome, valor, valor=0 ok FROM (SELECT 'rid_unico' nome, count(*)-count(DISTINCT rid) valor FROM v6_pool UNION ALL SELECT 'texto_nulo', count(*) FILTER (text_no_url IS NULL) FROM v6_pool UNION ALL SELECT 'sem_registro', count(*) FROM v6_splits WHERE rid NOT IN (SELECT rid FROM v6_pool))",
    "gates_p04_forbidden": f"SELECT portal_id, count(*) n FROM fonte_evidencia WHERE regexp_matches({_plain('titulo')}, '\\b(?:e falso|fake|mentira)\\b') GROUP BY 1",
    "q06_recovered": f"WITH t AS (SELECT corpo_id, list_distinct({_tokens('texto_completo')}) a, list_distinct({_tokens('trecho_corpo')}) b FROM corpo_lido WHERE length(texto_completo)>0) SELECT corpo_id, round(CASE WHEN len(a)>0 THEN len(list_intersect(a,b))/len(a) ELSE 0.0 END,6) share FROM t",
    "q07_unknown": f"WITH t AS (SELECT DISTINCT consulta_id, CASE WHEN array_to_string(p[-2:],'.') IN ({','.join(repr(x) for x in u.SUFFIXES)}) THEN array_to_string(p[-3:],'.') ELSE array_to_string(p[-2:],'.') END dominio FROM (SELECT consulta_id, string_split({_H},'.') p FROM {_IT} WHERE classe IS NOT NULL)) SELECT consulta_id, dominio FROM t WHERE dominio NOT IN (SELECT dominio FROM portais WHERE tipo='geral') QUALIFY row_number() OVER (PARTITION BY consulta_id ORDER BY dominio)<=2",
}
