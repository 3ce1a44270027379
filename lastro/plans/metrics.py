"""Queries of the evaluation measures, over judged evidence, the training pool and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastro.functions import normalise as n
from lastro.operators import metrics as m
from lastro.plans.text import _tokens
from lastro.session import table


def _judged(s, d):
    """Evidence with a page probability and a decided verdict: y = 1 for false and misleading."""
    y = F.when(F.col("veredito").isin("falso", "enganoso"), 1).when(F.col("veredito") == "verdadeiro", 0)
    rows = table(s, d, "item_evidencia").dropDuplicates(["item_id"])
    return rows.select("item_id", "consulta_id", "afirmacao", "confiabilidade", F.when(~F.isnan("prob_fake_pagina"), F.col("prob_fake_pagina")).alias("p"), y.alias("y")).where("p IS NOT NULL AND y IS NOT NULL")


_JUDGED = "(SELECT DISTINCT ON (item_id) item_id, consulta_id, afirmacao, confiabilidade, prob_fake_pagina AS p, CASE WHEN veredito IN ('falso','enganoso') THEN 1 WHEN veredito = 'verdadeiro' THEN 0 END AS y FROM item_evidencia) WHERE p IS NOT NULL AND NOT isnan(p) AND y IS NOT NULL"


def i01_registry(s, d):
    t = table(s, d, "checagens")
    return t.groupBy("agencia").agg(F.count("*").alias("n"), F.count("veredito").alias("com_veredito"), F.count_if(F.col("origem") == "claimreview").alias("claimreview"), F.count_if(F.col("veredito") == "falso").alias("falso"))


def i02_events(s, d):
    t = table(s, d, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("erros"), F.round(F.sum("value"), 4).alias("valor"), last.alias("ultimo"))


def i03_blocks(s, d):
    r = _judged(s, d).withColumn("ok", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))
    g = r.rollup("confiabilidade", "y").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("acuracia"), F.grouping_id().cast("int").alias("nivel")).withColumn("y", F.col("y").cast("double"))
    return g


def i04_wilson(s, d):
    r = _judged(s, d).groupBy("confiabilidade").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return r.select("confiabilidade", "k", "n", m.wilson(F.col("k"), F.col("n")).alias("w")).select("confiabilidade", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def i05_balanced(s, d):
    r = _judged(s, d).withColumn("ok", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")).groupBy("y").agg(F.avg("ok").alias("recall"))
    return r.agg(F.round(F.avg("recall"), 6).alias("acuracia_balanceada"), F.round(F.min("recall"), 6).alias("pior"))


def i06_auc(s, d):
    return m.auc(_judged(s, d), "p", "y", ["confiabilidade"]).select("confiabilidade", F.round("auc", 6).alias("auc"))


def i08_percentiles(s, d):
    t = table(s, d, "documents").where("n_chars > 0")
    return t.groupBy("tipo").agg(F.count("*").alias("n"), *[F.round(F.percentile("n_chars", F.lit(q)), 4).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)], F.round(F.avg((F.col("n_chars") > 2000).cast("double")), 6).alias("acima"))


def i10_weights(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL")
    return m.group_weights(t, ["grupo", "label"]).select("grupo", "label", "n", F.round("weight", 6).alias("weight"))


def i11_vocabulary(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL")
    return m.vocabulary(t, n.tokens(F.col("text_no_url")), "label").select("label", "tokens", "types", "hapax", F.round("ttr", 6).alias("ttr"), F.round("hapax_pct", 6).alias("hapax_pct"))


def i12_log_odds(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL")
    return m.log_odds(t, n.tokens(F.col("text_no_url")), F.col("label") == "fake").select("bigram", "a", "b", F.round("delta", 5).alias("delta"), F.round("z", 5).alias("z"))


def i13_lengths(s, d):
    t = table(s, d, "v6_pool")
    return t.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("word_len"), 6).alias("media"), F.round(F.median("word_len"), 6).alias("mediana"), F.round(F.stddev_samp("word_len"), 6).alias("desvio"), F.round(F.percentile("word_len", F.lit(0.75)), 6).alias("p75"), F.round(F.percentile("word_len", F.lit(0.95)), 6).alias("p95"))


def i13_pivot(s, d):
    t = table(s, d, "v6_pool").groupBy("channel").pivot("label", ["fake", "true"]).agg(F.count(F.lit(1)))
    t = t.fillna(0, ["fake", "true"])
    return t.withColumn("pct_fake", F.round(100 * F.col("fake") / (F.col("fake") + F.col("true")), 6))


def i14_groups(s, d):
    t = table(s, d, "v6_pool").where("label IS NOT NULL").groupBy("grupo").agg(F.count("*").alias("n"), F.avg((F.col("label") == "fake").cast("double")).alias("f"))
    return t.select("grupo", "n", F.round(F.least(F.col("f"), 1 - F.col("f")), 6).alias("minoria")).where("n >= 200 AND minoria >= 0.15")


def i15_classification(s, d):
    r = _judged(s, d)
    a = m.classification(r, "p", "y")
    return a.join(m.auc(r, "p", "y"), F.lit(True)).join(m.average_precision(r, "p", "y"), F.lit(True)).select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "f1_pos", "f1_neg", "brier", "auc", "average_precision")])


def i16_ece(s, d):
    return m.calibration_error(_judged(s, d), "p", "y").select(F.round("ece", 6).alias("ece"))


def i16_reliability(s, d):
    return m.reliability(_judged(s, d), "p", "y").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("share", 6).alias("share"))


def i17_group_metrics(s, d):
    g = m.classification(_judged(s, d), "p", "y", ["confiabilidade"]).where("n >= 30")
    reliable = (F.col("n") >= 100) & (F.least(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")) >= 20)
    return g.select("confiabilidade", "n", F.round("macro_f1", 6).alias("macro_f1"), reliable.alias("confiavel"))


def i18_thresholds(s, d):
    return m.threshold_sweep(_judged(s, d), "p", "y").select("threshold", F.round("macro_f1", 6).alias("macro_f1"))


def i19_claims(s, d):
    t = table(s, d, "item_evidencia").dropDuplicates(["item_id"])
    stance = F.col("classe").isin("SUSTENTA", "REFUTA")
    return t.groupBy("consulta_id", "afirmacao").agg(F.count("*").alias("n"), F.count_if(F.col("classe") == "SUSTENTA").alias("sustenta"), F.count_if(F.col("classe") == "REFUTA").alias("refuta"), F.countDistinct(F.when(stance, F.col("cluster_ind"))).alias("clusters"), F.coalesce(F.bool_or(F.col("veredito").isNotNull() & stance), F.lit(False)).alias("algum"))


def i21_flips(s, d):
    t = table(s, d, "item_evidencia").dropDuplicates(["item_id"]).where("classe IS NOT NULL")
    g = t.groupBy("url", "afirmacao", "classe").agg(F.count("*").alias("c")).groupBy("url", "afirmacao").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.max("c").alias("mx"))
    g = g.where("n > 1").select((F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), "same", (F.col("mx") * 2 > F.col("n")).cast("double").alias("maj"))
    return g.agg(F.count("*").alias("casos"), F.round(1 - F.sum("same") / F.sum("pairs"), 6).alias("discordancia"), F.round(F.avg("maj"), 6).alias("maioria"))


def i22_mcnemar(s, d):
    r = _judged(s, d).withColumns({"a": ((F.col("p") >= 0.5).cast("int") == F.col("y")), "b": ((F.col("p") >= 0.8).cast("int") == F.col("y"))})
    g = r.groupBy("confiabilidade").agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c"))
    return g.select("confiabilidade", "b", "c", F.round(m.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def i23_rollup(s, d):
    t = table(s, d, "events").groupBy(F.to_date("ts").alias("dia"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return t.groupBy("event_type").agg(F.count("*").alias("dias"), F.sum("n").alias("n"), F.max("n").alias("pico"), F.round(F.sum("v"), 3).alias("valor"))


QUERIES = {f.__name__: f for f in (i01_registry, i02_events, i03_blocks, i04_wilson, i05_balanced, i06_auc, i08_percentiles, i10_weights, i11_vocabulary, i12_log_odds, i13_lengths, i13_pivot, i14_groups, i15_classification, i16_ece, i16_reliability, i17_group_metrics, i18_thresholds, i19_claims, i21_flips, i22_mcnemar, i23_rollup)}

_ITEMS = "(SELECT DISTINCT ON (item_id) * FROM item_evidencia)"
_CELLS = "sum((p>=.5 AND y=1)::INT) tp, sum((p>=.5 AND y=0)::INT) fp, sum((p<.5 AND y=1)::INT) fn, sum((p<.5 AND y=0)::INT) tn, count(*) n"
_F1P, _F1N = "CASE WHEN 2*tp+fp+fn>0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END", "CASE WHEN 2*tn+fp+fn>0 THEN 2.0*tn/(2*tn+fp+fn) ELSE 0 END"
_AUC = "SELECT {0} sum(pos*(below+neg/2.0))/nullif(sum(pos)*sum(neg),0) AS auc FROM (SELECT *, coalesce(sum(neg) OVER ({1} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM (SELECT {0} p, sum(y) pos, sum(1-y) neg FROM j GROUP BY ALL)) GROUP BY ALL"

SQL = {
    "i01_registry": "SELECT agencia, count(*) n, count(veredito) com_veredito, count(*) FILTER (origem='claimreview') claimreview, count(*) FILTER (veredito='falso') falso FROM checagens GROUP BY 1",
    "i02_events": "SELECT user_id, count(*) n, count(*) FILTER (event_type='error') erros, round(sum(value),4) valor, arg_max(event_type, {'t':ts,'i':event_id}) ultimo FROM events GROUP BY 1",
    "i03_blocks": f"SELECT confiabilidade, y::DOUBLE y, count(*) n, round(avg(((p>=.5)::INT=y)::INT),6) acuracia, grouping_id(confiabilidade,y)::INT nivel FROM {_JUDGED} GROUP BY ROLLUP(confiabilidade,y)",
    "i04_wilson": f"SELECT confiabilidade, k::BIGINT k, n, round(greatest(0,(p+z*z/(2*n)-z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n)),6) low, round(least(1,(p+z*z/(2*n)+z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n)),6) high FROM (SELECT confiabilidade, sum(y) k, count(*) n, sum(y)/count(*) p, 1.96 z FROM {_JUDGED} GROUP BY 1)",
    "i05_balanced": f"SELECT round(avg(r),6) acuracia_balanceada, round(min(r),6) pior FROM (SELECT avg(((p>=.5)::INT=y)::INT) r FROM {_JUDGED} GROUP BY y)",
    "i06_auc": f"WITH j AS (SELECT * FROM {_JUDGED}) SELECT confiabilidade, round(auc,6) auc FROM ({_AUC.format('confiabilidade,', 'PARTITION BY confiabilidade')})",
    "i08_percentiles": "SELECT tipo, count(*) n, round(quantile_cont(n_chars,.5),4) p50, round(quantile_cont(n_chars,.9),4) p90, round(quantile_cont(n_chars,.95),4) p95, round(avg((n_chars>2000)::INT),6) acima FROM documents WHERE n_chars>0 GROUP BY 1",
    "i10_weights": "WITH c AS (SELECT grupo,label,count(*) n FROM v6_pool WHERE label IS NOT NULL GROUP BY 1,2), r AS (SELECT *, least((sum(n) OVER ())/(count(*) OVER ())/n,25) raw, sum(n) OVER () tot FROM c) SELECT grupo,label,n,round(raw/((sum(raw*n) OVER ())/tot),6) weight FROM r",
    "i11_vocabulary": f"WITH t AS (SELECT label, unnest({_tokens('text_no_url')}) t FROM v6_pool WHERE label IS NOT NULL), c AS (SELECT label,t,count(*) c FROM t GROUP BY 1,2) SELECT label, sum(c)::BIGINT tokens, count(*) types, count(*) FILTER (c=1) hapax, round(100.0*count(*)/sum(c),6) ttr, round(100.0*(count(*) FILTER (c=1))/count(*),6) hapax_pct FROM c GROUP BY 1",
    "i12_log_odds": f"""WITH t AS (SELECT rid, label='fake' s, {_tokens('text_no_url')} t FROM v6_pool WHERE label IS NOT NULL),
b AS (SELECT rid, s, unnest(list_transform(range(1,len(t)), lambda i: t[i] || ' ' || t[i+1])) bigram FROM t WHERE len(t)>1),
g AS (SELECT bigram, count(*) FILTER (s) a, count(*) FILTER (NOT s) b, count(DISTINCT rid) df FROM b GROUP BY 1 HAVING count(DISTINCT rid)>=10),
x AS (SELECT *, .1*(a+b) al, sum(a) OVER () na, sum(b) OVER () nb, .1*(sum(a) OVER ()+sum(b) OVER ()) a0 FROM g),
y AS (SELECT *, ln((a+al)/(na+a0-a-al))-ln((b+al)/(nb+a0-b-al)) delta FROM x) SELECT bigram, a, b, round(delta,5) delta, round(delta/sqrt(1/(a+al)+1/(b+al)),5) z FROM y""",
    "i13_lengths": "SELECT label, count(*) n, round(avg(word_len),6) media, round(median(word_len),6) mediana, round(stddev_samp(word_len),6) desvio, round(quantile_cont(word_len,.75),6) p75, round(quantile_cont(word_len,.95),6) p95 FROM v6_pool GROUP BY 1",
    "i13_pivot": "SELECT channel, count(*) FILTER (label='fake') fake, count(*) FILTER (label='true') \"true\", round(100.0*count(*) FILTER (label='fake')/(count(*) FILTER (label IN ('fake','true'))),6) pct_fake FROM v6_pool GROUP BY 1",
    "i14_groups": "SELECT * FROM (SELECT grupo, count(*) n, round(least(avg((label='fake')::INT),1-avg((label='fake')::INT)),6) minoria FROM v6_pool WHERE label IS NOT NULL GROUP BY 1) WHERE n>=200 AND minoria>=.15",
    "i15_classification": f"""WITH j AS (SELECT * FROM {_JUDGED}), c AS (SELECT {_CELLS}, avg((p-y)**2) brier FROM j), a AS ({_AUC.format('', '')}),
ap AS (SELECT sum(pos*tp/seen)/sum(pos) ap FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) tp, sum(n) OVER (ORDER BY p DESC) seen FROM (SELECT p, sum(y) pos, count(*) n FROM j GROUP BY 1)))
SELECT n, round((tp+tn)/n,6) accuracy, round(({_F1P}+{_F1N})/2,6) macro_f1, round({_F1P},6) f1_pos, round({_F1N},6) f1_neg, round(brier,6) brier, round(auc,6) auc, round(ap,6) average_precision FROM c, a, ap""",
    "i16_ece": f"SELECT round(sum(n*abs(acc-conf))/sum(n),6) ece FROM (SELECT count(*) n, avg(r) acc, avg(c) conf FROM (SELECT ((p>=.5)::INT=y)::INT r, CASE WHEN p>=.5 THEN p ELSE 1-p END c FROM {_JUDGED}) GROUP BY ceil(c*15))",
    "i16_reliability": f"SELECT greatest(ceil(p*10),1)::INT bin, count(*) n, round(avg(p),6) mean_p, round(avg(y),6) share FROM {_JUDGED} GROUP BY 1",
    "i17_group_metrics": f"SELECT confiabilidade, n, round(({_F1P}+{_F1N})/2,6) macro_f1, n>=100 AND least(tp+fn,tn+fp)>=20 confiavel FROM (SELECT confiabilidade, {_CELLS} FROM {_JUDGED} GROUP BY 1) WHERE n>=30",
    "i18_thresholds": f"WITH c AS (SELECT floor(round(p*100,6)) c, y FROM {_JUDGED}), g AS (SELECT t, sum((c>=t AND y=1)::INT) tp, sum((c>=t AND y=0)::INT) fp, sum((c<t AND y=1)::INT) fn, sum((c<t AND y=0)::INT) tn FROM c, range(5,96) r(t) GROUP BY 1) SELECT t/100 threshold, round(({_F1P}+{_F1N})/2,6) macro_f1 FROM g",
    "i19_claims": f"SELECT consulta_id, afirmacao, count(*) n, count(*) FILTER (classe='SUSTENTA') sustenta, count(*) FILTER (classe='REFUTA') refuta, count(DISTINCT CASE WHEN classe IN ('SUSTENTA','REFUTA') THEN cluster_ind END) clusters, coalesce(bool_or(veredito IS NOT NULL AND classe IN ('SUSTENTA','REFUTA')),false) algum FROM {_ITEMS} GROUP BY 1,2",
    "i21_flips": f"SELECT count(*) casos, round(1-sum(same)/sum(n*(n-1)/2),6) discordancia, round(avg((mx*2>n)::INT),6) maioria FROM (SELECT sum(c) n, sum(c*(c-1)/2) same, max(c) mx FROM (SELECT url,afirmacao,classe,count(*) c FROM {_ITEMS} WHERE classe IS NOT NULL GROUP BY 1,2,3) GROUP BY url,afirmacao) WHERE n>1",
    "i22_mcnemar": f"WITH g AS (SELECT confiabilidade, count(*) FILTER ((p>=.5)::INT=y AND (p>=.8)::INT<>y) b, count(*) FILTER ((p>=.5)::INT<>y AND (p>=.8)::INT=y) c FROM {_JUDGED} GROUP BY 1) SELECT confiabilidade, b, c, round(CASE WHEN b+c=0 THEN 1 ELSE least(1, 2*list_sum(list_transform(range(0, least(b,c)+1), lambda i: exp(lgamma(b+c+1)-lgamma(i+1)-lgamma(b+c-i+1)-(b+c)*ln(2))))) END,6) p FROM g",
    "i23_rollup": "SELECT event_type, count(*) dias, sum(n)::BIGINT n, max(n) pico, round(sum(v),3) valor FROM (SELECT ts::DATE d, event_type, count(*) n, sum(value) v FROM events GROUP BY 1,2) GROUP BY 1",
}
