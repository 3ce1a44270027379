"""Queries of further text rules, joins, guards, registry listings and rule outputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lastro.functions import normalise as n
from lastro.functions import urls as u
from lastro.operators import evidence as ev
from lastro.operators import metrics as m
from lastro.plans.evidence import _CANON, _CONTRIB, _DECISION, _GUARDED, _IT, _UNDISCOUNTED, _content, _items, _timed
from lastro.plans.metrics import _JUDGED, _judged
from lastro.plans.text import _plain
from lastro.session import table

# Units of relative dates in days (none for months and years) and number words of the grammar.
DAYS = {"minuto": 0, "minutos": 0, "hora": 0, "horas": 0, "hour": 0, "hours": 0, "minute": 0, "minutes": 0, "dia": 1, "dias": 1, "day": 1, "days": 1, "semana": 7, "semanas": 7, "week": 7, "weeks": 7}
MONTHS, YEARS = ["mes", "meses", "month", "months"], ["ano", "anos", "year", "years"]
COUNTS = {"um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10}
_UNIT = "|".join([*DAYS, *MONTHS, *YEARS])
_AMOUNT = "[0-9]{1,5}|" + "|".join(COUNTS)


def b05_label_keys(s, d):
    return table(s, d, "checagens").select("checagem_id", F.trim(F.regexp_replace(F.lower(n.ascii_deleted(F.coalesce("selo_original", F.lit("")))), "[^a-z0-9]+", " ")).alias("chave"))


def b08_content_tokens(s, d):
    return table(s, d, "checagens").select("checagem_id", F.array_join(n.content_tokens(F.col("titulo")), " ").alias("tokens"))


def b25_longest_half(s, d):
    """Last step of the relaxation ladder: half of a query's words, at least two, the longest first and then in their order."""
    w = F.split(F.trim("titulo"), r"\s+")
    ranked = F.array_sort(F.transform(w, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x"))))
    kept = F.slice(ranked, F.lit(1), F.greatest(F.lit(2), F.ceil(F.size(w) / 2).cast("int")))
    back = F.array_sort(F.transform(kept, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x"))))
    return table(s, d, "checagens").where("length(trim(titulo)) > 0").select("checagem_id", F.array_join(F.transform(back, lambda y: y["x"]), " ").alias("consulta"))


def b29_usable(s, d):
    """Whether a headline serves as a user's message: 25 to 180 characters, no question, no 'mas', no hashtag, no section verb."""
    t = F.trim(F.coalesce("titulo", F.lit("")))
    bad = ~F.length(t).between(25, 180) | t.endswith("?") | F.lower(t).contains(" mas ") | t.contains("#") | F.lower(t).rlike(r"^(?:verificamos|checamos|veja|confira|mensagem sobre|post sobre|texto sobre)(?:$|[^\p{L}\p{N}_])")
    return table(s, d, "checagens").select("checagem_id", (~bad).alias("serve"))


def _page(c):
    """Host without www and path without its last slashes, lower case: the key by which evaluation leaves pages out."""
    return F.lower(F.concat(F.regexp_replace(F.regexp_extract(F.trim(c), r"^[A-Za-z]+://([^/?#:]+)", 1), r"(?i)^www\.", ""), F.regexp_replace(F.regexp_extract(F.trim(c), r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")))


_PAGE = r"lower(regexp_replace(regexp_extract(trim({0}), '^[A-Za-z]+://([^/?#:]+)', 1), '(?i)^www\.', '') || regexp_replace(regexp_extract(trim({0}), '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''))"


def c05_excluded(s, d):
    """Pages read that no user has sent as a link."""
    sent = table(s, d, "link_lido").where("url IS NOT NULL").select(_page(F.col("url")).alias("k"))
    return table(s, d, "corpo_lido").withColumn("k", _page(F.col("url"))).join(sent, "k", "left_anti").select("corpo_id")


def d02_relative(s, d):
    """Day of relative raw dates, counted from the day of reading; months and years end their calendar month or year."""
    t = table(s, d, "corpo_lido").select("corpo_id", n.plain(F.col("data_pub")).alias("t"), F.to_date("lido_em").alias("base"))
    got = t.select("corpo_id", "base", F.regexp_extract("t", rf"^(?:ha ({_AMOUNT}) ({_UNIT})|({_AMOUNT}) ({_UNIT}) (?:atras|ago))$", 1).alias("a1"), F.regexp_extract("t", rf"^ha (?:{_AMOUNT}) ({_UNIT})$", 1).alias("u1"), F.regexp_extract("t", rf"^({_AMOUNT}) (?:{_UNIT}) (?:atras|ago)$", 1).alias("a2"), F.regexp_extract("t", rf"^(?:{_AMOUNT}) ({_UNIT}) (?:atras|ago)$", 1).alias("u2"))
    got = got.select("corpo_id", "base", F.when(F.col("u1") != "", F.col("a1")).otherwise(F.col("a2")).alias("a"), F.when(F.col("u1") != "", F.col("u1")).otherwise(F.col("u2")).alias("u")).where("u <> ''")
    count = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTS.items() for x in kv]), F.col("a")), F.col("a").try_cast("int"))
    day = F.try_element_at(F.create_map(*[F.lit(x) for kv in DAYS.items() for x in kv]), F.col("u"))
    when = F.when(F.col("u").isin(MONTHS), F.last_day(F.add_months("base", -count))).when(F.col("u").isin(YEARS), F.make_date(F.year("base") - count, F.lit(12), F.lit(31))).otherwise(F.date_sub("base", count * day))
    return got.select("corpo_id", F.date_format(when, "yyyy-MM-dd").alias("dia"), F.when(F.col("u").isin(MONTHS + YEARS), "ano").otherwise("dia").alias("precisao"))


def e13_cited(s, d):
    """Whether a page's title stands in its text once both are plain."""
    t = table(s, d, "corpo_lido").where("length(titulo) > 0 AND length(texto_completo) > 0")
    return t.select("corpo_id", n.plain(F.col("texto_completo")).contains(n.plain(F.col("titulo"))).alias("citado"))


def g11_pending(s, d):
    """Pieces and claims of each query that no judge has seen."""
    t = _items(s, d).where("url IS NOT NULL AND consulta_id IS NOT NULL")
    pieces, claims = t.select("consulta_id", "url").distinct(), t.select("consulta_id", "afirmacao").distinct()
    done = t.where("classe IS NOT NULL").select("consulta_id", "url", "afirmacao")
    return pieces.join(claims, "consulta_id").join(done, ["consulta_id", "url", "afirmacao"], "left_anti")


def g12_portal(s, d):
    """Portal of each source by the longest domain that its host ends in; hosts are cut into their endings, so the join is one of equals."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1))
    ends = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))
    t = table(s, d, "fonte_evidencia").select("fonte_id", F.split(host, r"\.").alias("p")).select("fonte_id", F.explode(ends).alias("dominio"))
    hit = t.join(table(s, d, "portais").select("dominio", F.col("portal_id").alias("portal")), "dominio")
    best = F.min(F.struct((-F.length("dominio")).alias("l"), "portal")).alias("b")
    return hit.groupBy("fonte_id").agg(best).select("fonte_id", F.col("b.portal").alias("portal"))


def h13_accumulated(s, d):
    t = _items(s, d).withColumn("chave", u.canonical(F.col("url"))).where("chave IS NOT NULL")
    return t.groupBy("consulta_id", "chave").agg(F.array_join(F.array_sort(F.collect_set("afirmacao")), ",").alias("afirmacoes"), F.date_format(F.min("julgado_em"), "yyyy-MM-dd HH:mm:ss").alias("primeira"), F.count("*").alias("n"))


def i09_weight_stats(s, d):
    """Spread of the cell weights and the prior they leave: share of fakes before and after weighting, class weights n / (2 n_c)."""
    t = table(s, d, "v6_pool").where("label IS NOT NULL")
    c = m.group_weights(t, ["grupo", "label"])
    fake = F.when(F.col("label") == "fake", F.col("n")).otherwise(0)
    out = c.agg(F.max("weight").alias("wmax"), F.min("weight").alias("wmin"), F.max("n").alias("maior"), F.min("n").alias("menor"), F.sum("n").alias("t"), F.sum(fake).alias("f"), F.sum(F.col("weight") * F.col("n")).alias("wt"), F.sum(F.col("weight") * fake).alias("wf"))
    return out.select("maior", "menor", F.round("wmax", 6).alias("wmax"), F.round("wmin", 6).alias("wmin"), F.round(F.col("f") / F.col("t"), 6).alias("priori"), F.round(F.col("wf") / F.col("wt"), 6).alias("priori_efetiva"), F.round(F.col("t") / (2 * F.col("f")), 6).alias("peso_fake"), F.round(F.col("t") / (2 * (F.col("t") - F.col("f"))), 6).alias("peso_true"))


def i27_flags(s, d):
    has = lambda k: F.bool_or(F.col("event_type") == k)
    return table(s, d, "events").groupBy("user_id").agg(has("error").alias("erro"), has("purchase").alias("compra"), F.bool_and(F.col("event_type") == "view").alias("so_visita"))


def a18_runs(s, d):
    """The fifty newest runs (users) with their events of two kinds."""
    t = table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("ultimo"), F.count_if(F.col("event_type").isin("error", "purchase")).alias("n"))
    return t.orderBy(F.desc("ultimo"), "user_id").limit(50).select("user_id", F.date_format("ultimo", "yyyy-MM-dd HH:mm:ss").alias("ultimo"), "n")


def j05_round_robin(s, d):
    """Distinct documents of each query in turns of its claims, twelve per claim at most, with the claims that asked for each."""
    t = _items(s, d).where("url IS NOT NULL").groupBy("consulta_id", "afirmacao", "url").agg(F.min("item_id").alias("i"))
    t = t.withColumn("vez", F.row_number().over(Window.partitionBy("consulta_id", "afirmacao").orderBy("i"))).where("vez <= 12")
    g = t.groupBy("consulta_id", "url").agg(F.min(F.struct("vez", "afirmacao")).alias("k"), F.array_join(F.array_sort(F.collect_set("afirmacao")), ",").alias("afirmacoes"))
    return g.select("consulta_id", "url", F.row_number().over(Window.partitionBy("consulta_id").orderBy("k", "url")).alias("ordem"), "afirmacoes")


def k06_guards(s, d):
    """Claims with the sum of their votes, what the guards leave of it, and which guard cut."""
    g = ev.guarded(ev.contributions(_timed(s, d))).where("n_votes > 0")
    return g.select("consulta_id", "afirmacao", F.round("raw", 4).alias("bruto"), F.round("log_odds", 4).alias("l"), F.col("unreliable").alias("sem_fonte_confiavel"), F.col("other_period").alias("outro_periodo"))


def q02_without_dates(s, d):
    """Levels with and without the discount of late sources, where they differ."""
    t = _timed(s, d)
    a, b = ev.decide(t).select("consulta_id", F.col("nivel").alias("com")), ev.decide(t, late=False).select("consulta_id", F.col("nivel").alias("sem"))
    return a.join(b, "consulta_id").where("com <> sem")


def k11_lowered(s, d):
    """The undiscounted level, lowered to the discounted one where that may be."""
    t = _timed(s, d)
    a, b = ev.decide(t).select("consulta_id", F.col("nivel").alias("com")), ev.decide(t, late=False).select("consulta_id", F.col("nivel").alias("sem"))
    return a.join(b, "consulta_id").select("consulta_id", ev.lowered(F.col("sem"), F.col("com")).alias("nivel"))


def l02_channel_out(s, d):
    """The channel with most rows as test; one in ten of the rest, by hash, as validation."""
    t = table(s, d, "v6_pool").where("channel IS NOT NULL")
    held = t.groupBy("channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(1).select(F.col("channel").alias("fora"))  # one row
    side = F.when(F.col("channel") == F.col("fora"), "test").when(F.conv(F.substring(F.sha2(F.col("rid").cast("string"), 256), 1, 4), 16, 10).cast("int") % 10 == 0, "val").otherwise("train")
    return t.join(F.broadcast(held), F.lit(True)).select("rid", side.alias("lado"))


def o04_platt(s, d):
    """Calibration of page probabilities by verdicts: slope and intercept on their log-odds, fitted on every judged item."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    a, b = m.platt(_judged(s, d).withColumn("z", F.log(p / (1 - p))), "z", "y")
    return s.createDataFrame([(round(a, 6), round(b, 6))], "inclinacao double, intercepto double")


def o05_verified(s, d):
    """Classes after the citation rule: a stance whose citation was not found treats nothing."""
    classe = F.when(F.col("classe").isNotNull() & (F.col("citacao_verificada") == F.lit(False)), "NAO_TRATA").otherwise(F.col("classe"))
    return _items(s, d).groupBy(F.col("classe").alias("antes"), classe.alias("depois")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (a18_runs, b05_label_keys, b08_content_tokens, b25_longest_half, b29_usable, c05_excluded, d02_relative, e13_cited, g11_pending, g12_portal, h13_accumulated, i09_weight_stats, i27_flags, j05_round_robin, k06_guards, k11_lowered, l02_channel_out, o04_platt, o05_verified, q02_without_dates)}

_AB = f"WITH {_CONTRIB}, {_GUARDED}, {_DECISION}, w AS (WITH {_UNDISCOUNTED}, {_DECISION} SELECT consulta_id, nivel sem FROM y), z AS (SELECT consulta_id, nivel com, sem FROM y JOIN w USING (consulta_id))"
_SAYS = "CASE {0} WHEN 'alta' THEN 2 WHEN 'baixa' THEN 2 WHEN 'media' THEN 1 ELSE 0 END"
SQL = {
    "a18_runs": "SELECT user_id, strftime(u, '%Y-%m-%d %H:%M:%S') ultimo, n FROM (SELECT user_id, max(ts) u, count(*) FILTER (event_type IN ('error','purchase')) n FROM events GROUP BY 1) ORDER BY u DESC, user_id LIMIT 50",
    "b05_label_keys": "SELECT checagem_id, trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(selo_original,'')),'[^\\x00-\\x7F]','','g')),'[^a-z0-9]+',' ','g')) chave FROM checagens",
    "b08_content_tokens": f"SELECT checagem_id, array_to_string({_content('titulo')}, ' ') tokens FROM checagens",
    "b25_longest_half": "WITH w AS (SELECT checagem_id, regexp_split_to_array(trim(titulo),'\\s+') w FROM checagens WHERE length(trim(titulo))>0), r AS (SELECT checagem_id, len(w) n, unnest(range(1,len(w)+1)) i, unnest(w) x FROM w), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY checagem_id ORDER BY length(x) DESC, i) <= greatest(2, ceil(n/2))) SELECT checagem_id, string_agg(x,' ' ORDER BY i) consulta FROM k GROUP BY 1",
    "b29_usable": "SELECT checagem_id, NOT (NOT length(t) BETWEEN 25 AND 180 OR suffix(t,'?') OR contains(lower(t),' mas ') OR contains(t,'#') OR regexp_matches(lower(t),'^(?:verificamos|checamos|veja|confira|mensagem sobre|post sobre|texto sobre)(?:$|[^\\p{L}\\p{N}_])')) serve FROM (SELECT checagem_id, trim(coalesce(titulo,'')) t FROM checagens)",
    "c05_excluded": f"SELECT corpo_id FROM corpo_lido c WHERE NOT EXISTS (SELECT 1 FROM link_lido l WHERE {_PAGE.format('l.url')} = {_PAGE.format('c.url')})",
    "d02_relative": f"""WITH t AS (SELECT corpo_id, {_plain("coalesce(data_pub,'')")} t, lido_em::DATE base FROM corpo_lido),
g AS (SELECT corpo_id, base, CASE WHEN regexp_matches(t,'^ha ({_AMOUNT}) ({_UNIT})$') THEN string_split(t,' ')[2] ELSE string_split(t,' ')[1] END a, CASE WHEN regexp_matches(t,'^ha ({_AMOUNT}) ({_UNIT})$') THEN string_split(t,' ')[3] ELSE string_split(t,' ')[2] END u FROM t WHERE regexp_matches(t,'^ha ({_AMOUNT}) ({_UNIT})$') OR regexp_matches(t,'^({_AMOUNT}) ({_UNIT}) (?:atras|ago)$')),
k AS (SELECT corpo_id, base, u, CASE a {" ".join(f"WHEN '{w}' THEN {v}" for w, v in COUNTS.items())} ELSE try_cast(a AS INT) END n, CASE u {" ".join(f"WHEN '{w}' THEN {v}" for w, v in DAYS.items())} END dd FROM g)
SELECT corpo_id, strftime(CASE WHEN u IN ('mes','meses','month','months') THEN last_day(date_trunc('month',base) - to_months(n)) WHEN u IN ('ano','anos','year','years') THEN make_date(year(base)-n,12,31) ELSE base - (n*dd)::INT END, '%Y-%m-%d') dia, CASE WHEN dd IS NULL THEN 'ano' ELSE 'dia' END precisao FROM k""",
    "e13_cited": f"SELECT corpo_id, contains({_plain('texto_completo')}, {_plain('titulo')}) citado FROM corpo_lido WHERE length(titulo)>0 AND length(texto_completo)>0",
    "g11_pending": f"WITH t AS (SELECT * FROM {_IT} WHERE url IS NOT NULL AND consulta_id IS NOT NULL) SELECT consulta_id, url, afirmacao FROM (SELECT DISTINCT consulta_id, url FROM t) JOIN (SELECT DISTINCT consulta_id, afirmacao FROM t) USING (consulta_id) ANTI JOIN (SELECT consulta_id, url, afirmacao FROM t WHERE classe IS NOT NULL) USING (consulta_id, url, afirmacao)",
    "g12_portal": "SELECT fonte_id, arg_min(p.portal_id, {'l': -length(dominio), 'p': p.portal_id}) portal FROM (SELECT fonte_id, lower(regexp_extract(url,'^[A-Za-z]+://([^/?#:]+)',1)) h FROM fonte_evidencia) f JOIN portais p ON f.h = p.dominio OR suffix(f.h, '.' || p.dominio) GROUP BY 1",
    "h13_accumulated": f"SELECT consulta_id, chave, array_to_string(list_sort(list_distinct(list(afirmacao))),',') afirmacoes, strftime(min(julgado_em),'%Y-%m-%d %H:%M:%S') primeira, count(*) n FROM (SELECT *, {_CANON} chave FROM {_IT}) WHERE chave IS NOT NULL GROUP BY 1,2",
    "i09_weight_stats": "WITH c AS (SELECT grupo,label,count(*) n FROM v6_pool WHERE label IS NOT NULL GROUP BY 1,2), r AS (SELECT *, least((sum(n) OVER ())/(count(*) OVER ())/n,25) raw, sum(n) OVER () tot FROM c), w AS (SELECT *, raw/((sum(raw*n) OVER ())/tot) w FROM r) SELECT max(n) maior, min(n) menor, round(max(w),6) wmax, round(min(w),6) wmin, round(sum(n) FILTER (label='fake')/sum(n),6) priori, round(sum(w*n) FILTER (label='fake')/sum(w*n),6) priori_efetiva, round(sum(n)/(2*sum(n) FILTER (label='fake')),6) peso_fake, round(sum(n)/(2*sum(n) FILTER (label<>'fake')),6) peso_true FROM w",
    "i27_flags": "SELECT user_id, bool_or(event_type='error') erro, bool_or(event_type='purchase') compra, bool_and(event_type='view') so_visita FROM events GROUP BY 1",
    "j05_round_robin": f"WITH t AS (SELECT consulta_id, afirmacao, url, min(item_id) i FROM {_IT} WHERE url IS NOT NULL GROUP BY 1,2,3), v AS (SELECT *, row_number() OVER (PARTITION BY consulta_id, afirmacao ORDER BY i) vez FROM t QUALIFY vez<=12), g AS (SELECT consulta_id, url, min({{'v': vez, 'a': afirmacao}}) k, array_to_string(list_sort(list_distinct(list(afirmacao))),',') afirmacoes FROM v GROUP BY 1,2) SELECT consulta_id, url, row_number() OVER (PARTITION BY consulta_id ORDER BY k, url)::INTEGER ordem, afirmacoes FROM g",
    "k06_guards": f"WITH {_CONTRIB}, {_GUARDED} SELECT consulta_id, afirmacao, round(raw,4) bruto, round(l,4) l, unreliable sem_fonte_confiavel, other_period outro_periodo FROM g WHERE n_votes>0",
    "k11_lowered": f"{_AB} SELECT consulta_id, CASE WHEN com IN ('media','indeterminada') AND {_SAYS.format('com')} < {_SAYS.format('sem')} THEN com ELSE sem END nivel FROM z",
    "l02_channel_out": "WITH h AS (SELECT channel fora FROM v6_pool WHERE channel IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT rid, CASE WHEN channel=fora THEN 'test' WHEN ('0x' || sha256(rid::VARCHAR)[1:4])::INT % 10 = 0 THEN 'val' ELSE 'train' END lado FROM v6_pool, h WHERE channel IS NOT NULL",
    "o05_verified": f"SELECT classe antes, CASE WHEN classe IS NOT NULL AND citacao_verificada=false THEN 'NAO_TRATA' ELSE classe END depois, count(*) n FROM {_IT} GROUP BY 1,2",
    "q02_without_dates": f"{_AB} SELECT consulta_id, com, sem FROM z WHERE com<>sem",
}
