"""Evidence decision: signed item weights, one vote per independent cluster, claims joined to a level, discount of late evidence.

Items: consulta_id, afirmacao, cluster_ind, classe, motor, curada, corpo_lido, veredito, origem_veredito, confiabilidade,
prob_fake_pagina, agencia, and the days by which an item lies beyond its claim's window (``excess``) of ``window`` days,
null where not measurable. Null probabilities leave weights whole; unread and fallback items carry none. The plan is three
groupings (item, cluster, claim) with partial sums; a claim of very many items is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds, base weights and reliability factors of the decision.
TAU = 1.0986122886681098
LABEL, STANCE, LEAST = 1.5, 1.0, 0.05
STANCE_FACTOR = {"curada": 1.0, "institucional": 0.6, "alto_trafego": 0.6, "plataforma": 0.45, "baixo_trafego": 0.3}
LABEL_FACTOR = {"curada": 1.0, "institucional": 0.8, "alto_trafego": 0.8, "plataforma": 0.55, "baixo_trafego": 0.4}
RELIABLE = ["curada", "institucional", "alto_trafego"]
DIRECTION = {"falso": 1.0, "enganoso": 0.7, "sem_evidencia": 0.4, "verdadeiro": -1.0}
WINDOWS = [("hoje|agora", 2), ("ontem", 3), ("anteontem", 4), ("esta semana|nesta semana", 8), ("semana passada", 15), ("este mes|neste mes", 32)]


def _of(c: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def direction(verdict: Column) -> Column:
    """What a verdict says of a claim: 1 false to -1 true, 0 for satire and unknown ones."""
    return _of(verdict, DIRECTION, 0.0)


def contributions(items: DataFrame, denied: Column | None = None) -> DataFrame:
    """``items`` with contribution: the signed weight of each, null for none; ``denied`` tells items of a claim that is stated in the negative, whose signs turn."""
    tier = F.coalesce("confiabilidade", F.lit(""))
    usable = ~F.coalesce(F.col("motor").startswith("fallback"), F.lit(False)) & F.col("classe").isNotNull() & F.coalesce("corpo_lido", F.lit(False))
    agency = F.coalesce("agencia", F.lit(False)) & F.coalesce("curada", F.lit(False))
    strong = usable & agency & (F.col("classe") == "REFUTA") & (F.coalesce("excess", F.lit(0)) <= 0)
    muted = F.max(strong.cast("int")).over(Window.partitionBy("consulta_id", "afirmacao")) == 1
    base = F.when(agency & (F.col("classe") == "REFUTA"), LABEL).otherwise(STANCE * _of(tier, STANCE_FACTOR, 0.3))
    pf = F.when(F.isnan("prob_fake_pagina"), None).otherwise(F.col("prob_fake_pagina"))
    weight = base * (1 - F.least(F.greatest(F.coalesce(pf, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    stance = F.when(F.col("classe") == "REFUTA", weight).when((F.col("classe") == "SUSTENTA") & ~(muted & ~agency), -weight)
    stance = F.when(weight >= LEAST * base, stance)
    told = F.col("veredito").isNotNull() & F.col("classe").isin("SUSTENTA", "REFUTA") & (F.coalesce("origem_veredito", F.lit("")) != "pagina") & (direction(F.col("veredito")) != 0)
    label = F.when(told, direction(F.col("veredito")) * LABEL * _of(tier, LABEL_FACTOR, 0.4))
    both = F.when(stance.isNull(), label).when(label.isNull(), stance).when(F.signum(stance) != F.signum(label), None).when(F.abs(stance) >= F.abs(label), stance).otherwise(label)
    turned = both if denied is None else F.when(F.coalesce(denied, F.lit(False)), -both).otherwise(both)
    return items.withColumn("contribution", F.when(usable, turned))


def discounted(c: Column, window: Column, excess: Column) -> Column:
    """Contribution of an item ``excess`` days beyond its window; null where less than a twentieth is left."""
    r = window / (window + excess)
    late = F.signum(c) * F.log(r * F.exp(F.abs(c)) + 1 - r)
    return F.when((excess.isNull()) | (excess <= 0), c).when(F.abs(late) >= LEAST * F.abs(c), late)


def votes(items: DataFrame, column: str = "contribution") -> DataFrame:
    """(consulta_id, afirmacao, cluster_ind, vote): per cluster the sign of the sum with the largest weight that agrees."""
    key = ["consulta_id", "afirmacao", "cluster_ind"]
    g = items.where(F.col(column).isNotNull()).groupBy(*key).agg(F.sum(column).alias("s"), F.max(column).alias("hi"), F.min(column).alias("lo"))
    vote = F.when(F.col("s") > 0, F.col("hi")).when(F.col("s") < 0, F.col("lo"))
    return g.select(*key, F.round(vote, 4).alias("vote")).where(F.col("vote").isNotNull() & (F.col("vote") != 0))


def joined(claims: DataFrame, by: str = "consulta_id", log_odds: str = "log_odds") -> DataFrame:
    """(by, log_odds): claims joined: none against gives the largest, one against gives itself, several combine as noisy-or."""
    at = F.col(log_odds)
    miss = 1 / (1 + F.exp(at))  # sigma(-L)
    g = claims.groupBy(by).agg(F.count_if(at >= 0).alias("n"), F.max(at).alias("top"), F.exp(F.sum(F.when(at >= 0, F.log(miss)))).alias("none"), F.count("*").alias("all"))
    p = F.least(F.greatest(1 - F.col("none"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return g.select(by, F.when(F.col("n") <= 1, F.col("top")).otherwise(F.log(p / (1 - p))).alias(log_odds))


def level(log_odds: Column) -> Column:
    return F.when(log_odds.isNull(), "indeterminada").when(log_odds >= TAU, "alta").when(log_odds <= -TAU, "baixa").otherwise("media")


def guarded(items: DataFrame, late: bool = True) -> DataFrame:
    """(consulta_id, afirmacao, n_votes, n_raw, only_late, raw, log_odds, unreliable, other_period) of ``contributions``.

    raw is the sum of the claim's votes. It is cut to just below the threshold where no vote of its direction has a reliable
    source inside the window, or none has any source inside it. With ``late`` items beyond the window are discounted; without,
    all count in full and the second guard rests.
    """
    past = F.coalesce("excess", F.lit(0)) > 0
    worth = F.when(past, discounted(F.col("contribution"), F.col("window"), F.col("excess"))).otherwise(F.col("contribution")) if late else F.col("contribution")
    past = past if late else F.lit(False)
    v = items.where(F.col("contribution").isNotNull()).select("consulta_id", "afirmacao", F.coalesce("cluster_ind", "url").alias("cluster"), F.col("contribution").alias("c"), worth.alias("v"), past.alias("past"), F.coalesce("confiabilidade", F.lit("")).isin(RELIABLE).alias("reliable"))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    g = v.groupBy("consulta_id", "afirmacao", "cluster").agg(
        F.round(F.sum("v"), 9).alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.round(F.sum("c"), 9).alias("rs"), F.bool_and("past").alias("only_late"),
        *[some((F.signum("v") == d) & F.col("reliable") & ~F.col("past")).alias(f"rel{n}") for d, n in ((1, "_up"), (-1, "_down"))],
        *[some((F.signum("c") == d) & ~F.col("past")).alias(f"cur{n}") for d, n in ((1, "_up"), (-1, "_down"))],
    )
    up = F.col("s") > 0
    vote = F.round(F.when(up, F.col("hi")).when(F.col("s") < 0, F.col("lo")), 4)
    each = g.select("consulta_id", "afirmacao", "only_late", vote.alias("vote"), (F.col("rs") != 0).alias("raw_vote"), F.when(up, F.col("rel_up")).otherwise(F.col("rel_down")).alias("rel"), F.when(up, F.col("cur_up")).otherwise(F.col("cur_down")).alias("cur"))
    claim = each.groupBy("consulta_id", "afirmacao").agg(
        F.count("vote").alias("n_votes"), F.count_if("raw_vote").alias("n_raw"), F.bool_and("only_late").alias("only_late"), F.round(F.coalesce(F.sum("vote"), F.lit(0.0)), 9).alias("raw"),
        *[some((F.signum("vote") == d) & F.col(f)).alias(f"{f}{n}") for f in ("rel", "cur") for d, n in ((1, "_up"), (-1, "_down"))],
    )
    strong, side = F.abs("raw") >= TAU, F.col("raw") > 0
    unreliable = strong & ~F.when(side, F.col("rel_up")).otherwise(F.col("rel_down"))
    other = strong & ~F.when(side, F.col("cur_up")).otherwise(F.col("cur_down")) if late else F.lit(False)
    cut = F.when(unreliable | other, F.signum("raw") * 0.99 * TAU).otherwise(F.col("raw"))
    return claim.select("consulta_id", "afirmacao", "n_votes", "n_raw", "only_late", "raw", cut.alias("log_odds"), unreliable.alias("unreliable"), other.alias("other_period"))


def decide(items: DataFrame, late: bool = True, denied: Column | None = None) -> DataFrame:
    """(consulta_id, log_odds, nivel) of every query of ``items``; those without votes are undetermined.

    Where several claims have votes, or had them before the discount, a claim that rests on late sources only and does not
    reach the threshold stays out; the text is then never called low by what is left.
    """
    claims = guarded(contributions(items, denied), late)
    part = (F.col("n_votes") > 0) | ((F.col("n_raw") > 0) & F.col("only_late"))
    several = F.sum(part.cast("int")).over(Window.partitionBy("consulta_id")) > 1
    out = claims.withColumn("_out", several & part & F.col("only_late") & (F.abs("log_odds") < TAU))
    joined_ = joined(out.where(~F.col("_out") & (F.col("n_votes") > 0)))
    left_out = out.groupBy("consulta_id").agg(F.bool_or("_out").alias("_out"))
    told = level(F.col("log_odds"))
    nivel = F.when(F.coalesce("_out", F.lit(False)) & (told == "baixa"), "media").otherwise(told)
    return items.select("consulta_id").distinct().join(joined_, "consulta_id", "left").join(left_out, "consulta_id", "left").select("consulta_id", "log_odds", nivel.alias("nivel"))


#: How much a level says, for levels that may only be lowered.
CONVICTION = {"alta": 2, "baixa": 2, "media": 1, "indeterminada": 0}


def lowered(original: Column, proposed: Column) -> Column:
    """The proposed level where it is 'media' or 'indeterminada' and says less than the original; the original otherwise."""
    says = lambda c: _of(c, {k: float(v) for k, v in CONVICTION.items()}, 0.0)
    return F.when(proposed.isin("media", "indeterminada") & (says(proposed) < says(original)), proposed).otherwise(original)


def gate() -> Column:
    """First reason for which an item does not apply, 'aplicavel' where none does."""
    return (
        F.when(~F.coalesce("corpo_lido", F.lit(False)), "nao_lido").when(F.col("classe").isNull() | F.coalesce(F.col("motor").startswith("fallback"), F.lit(False)), "sem_juiz")
        .when(~F.col("classe").isin("SUSTENTA", "REFUTA") & ~F.col("classe").startswith("RELATA"), "fora_do_tema").when(F.col("classe").startswith("RELATA"), "relata")
        .when(~F.coalesce("citacao_verificada", F.lit(False)), "sem_citacao").when(direction(F.col("veredito")) == 0, "sem_direcao").otherwise("aplicavel")
    )


def window_days(text: Column) -> Column:
    """Smallest window among the time markers of a plain text; null where there is none."""
    return F.array_min(F.filter(F.array(*[F.when(text.rlike(rf"\b(?:{p})\b"), d) for p, d in WINDOWS]), lambda x: x.isNotNull()))


def interleaved(rows: DataFrame, by: str, score: Column, tie: str) -> DataFrame:
    """``rows`` with turn: the rank within ``by``, so that ordering by (turn, by) takes one of each in turns."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(score.desc(), F.col(tie))))
