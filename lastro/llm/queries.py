"""Queries pN_ of the corpus operators, over their whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.llm import boilerplate, encoding, history, lines, mixing, overlap, packing, splits, truncation
from lastro.session import shared_dir, table, written

PROPORTIONS = {"train": 0.8, "val_sel": 0.08, "val_calib": 0.04, "test": 0.08}
SPLIT_COLUMNS = ["split_bal_iid", "split_ood_wa"]


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "v6_splits")
    members = written(splits.components(rows, "rid", ["near_dup_cluster"]))
    return rows, members, splits.assign(members, PROPORTIONS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that the given columns divide: components whose rows lie on several sides, then within these each cluster by the rows that name it."""
    rows = table(spark, d, "v6_splits")
    members = written(splits.components(rows, "rid", ["near_dup_cluster"]))
    touched = splits.divided(rows, "rid", SPLIT_COLUMNS, members).select("component").distinct()
    inside = members.join(touched, "component", "left_semi").select(F.col("id").alias("rid"))
    rows = rows.where("near_dup_cluster IS NOT NULL AND near_dup_cluster <> -1").join(inside, "rid", "left_semi")
    # A rid delivered twice may name two clusters, which are one component; each gets the sides of its own row only.
    rows = rows.withColumn("id", F.struct("rid", "near_dup_cluster"))
    named = rows.select("id", F.col("near_dup_cluster").alias("component")).distinct()
    return splits.divided(rows, "id", SPLIT_COLUMNS, named).select(F.col("component").alias("near_dup_cluster"), "coluna")


def p1_sides(spark: SparkSession, d: str) -> DataFrame:
    """A side for every rid, no cluster divided."""
    _, _, assigned = _assigned(spark, d)
    return assigned.select(F.col("id").alias("rid"), "component", "side")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records, components and share of each side."""
    _, _, assigned = _assigned(spark, d)
    total = assigned.count()
    return assigned.groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("component").alias("n_components")).withColumn("share", F.col("n") / F.lit(total))


def _portal_by_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fonte_evidencia").groupBy("url").agg(F.max("portal_id").alias("portal_id"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "corpo_lido").select("corpo_id", "url", "texto_completo", "lido_em")
    return pages.where(F.length("texto_completo") > 0).join(_portal_by_url(spark, d), "url")


def _repeated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = _pages(spark, d)
    # The latest month of reading is the new partition; all before it is the state that it is merged into.
    latest = table(spark, d, "corpo_lido").agg(F.date_trunc("month", F.max("lido_em"))).first()[0]
    new = F.coalesce(F.col("lido_em") >= F.lit(latest), F.lit(False))
    state = lines.State(spark, f"{shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}")
    args = ("corpo_id", "portal_id", "url", "texto_completo", F.lit(0))
    state.append(lines.pairs(pages.where(~new), *args), "0-before")
    repeated = written(state.append(lines.pairs(pages.where(new), *args), "1-latest"))
    return pages.withColumn("_new", new), lines.found(lines.exploded(pages, *args[:-1]), lines.sized(repeated))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, places = _repeated(spark, d)
    return places.select(F.col("doc_id").alias("corpo_id"), "linha_no")


def p7_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The bodies that the latest partition makes necessary to write anew: its own, and earlier ones that hold a line which crossed the threshold with it."""
    pages, places = _repeated(spark, d)
    mine = places.join(pages.select(F.col("corpo_id").alias("doc_id"), "_new"), "doc_id")
    asked = mine.where("_new OR newly").select("doc_id").distinct()
    return lines.rebuilt(table(spark, d, "corpo_lido"), "corpo_id", "texto_completo", places.join(asked, "doc_id", "left_semi")).withColumnRenamed("doc_id", "corpo_id")


def p7_lines(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines per portal with one spelling, their urls and the portal's."""
    pages = _pages(spark, d)
    state = lines.merge(None, lines.pairs(pages, "corpo_id", "portal_id", "url", "texto_completo", F.lit(0)))
    repeated = written(lines.crossed(lines.counts(state, 1)))
    spelt = pages.select(F.col("portal_id").alias("source"), F.explode(F.split("texto_completo", "\n")).alias("linha"))
    spelt = spelt.withColumn("k", F.xxhash64(lines.letters_key(F.col("linha")))).groupBy("source", "k").agg(F.min(F.trim("linha")).alias("linha"))
    return spelt.join(repeated, ["source", "k"]).select(F.col("source").alias("portal_id"), "linha", "n_urls", "urls")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every body with text, without its portal's repeated lines; bodies that hold none or have no portal stay as they are."""
    _, places = _repeated(spark, d)
    return lines.rebuilt(table(spark, d, "corpo_lido"), "corpo_id", "texto_completo", places, every=True).select(F.col("doc_id").alias("corpo_id"), "texto_limpo", "linhas_removidas")


def _capacity(spark: SparkSession, d: str, name: str = "medio") -> int:
    return table(spark, d, "recipientes").where(F.col("nome") == name).first()["capacidade_tokens"]


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text in containers of the middle size."""
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", _capacity(spark, d)).withColumnRenamed("id", "doc_id")


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Room used per container size."""
    out = None
    for r in table(spark, d, "recipientes").orderBy("recipiente_id").collect():  # a fixed table of three rows
        packed = written(packing.pack(table(spark, d, "documents"), "doc_id", "text", r["capacidade_tokens"]))
        row = packing.usage(packed, r["capacidade_tokens"]).withColumn("nome", F.lit(r["nome"]))
        out = row if out is None else out.unionByName(row)
    return out


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: documents with their number of copies."""
    return mixing.mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mistura_alvo"))[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that the mix reaches, per target source."""
    return mixing.mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mistura_alvo"))[1]


def p9_beyond(spark: SparkSession, d: str) -> DataFrame:
    """Shares at eight times the total that all sources can reach: short ones repeat as often as they may and fall short, the others reach theirs of that total."""
    return mixing.mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mistura_alvo"), stretch=8.0)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text").where("cut").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_shares(truncation.judged(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text"))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    texts = written(truncation.with_endings(truncation.measured(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")))
    return truncation.hidden_limits(texts)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The three fields that may be garbled, in one shape."""
    fields = (("checagens", "titulo", "checagem_id"), ("fonte_evidencia", "titulo", "fonte_id"), ("corpo_lido", "texto_completo", "corpo_id"))
    parts = [table(spark, d, t).where(F.length(c) > 0).select(F.lit(t).alias("tabela"), F.col(i).alias("registro_id"), F.col(c).alias("texto")) for t, c, i in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _encoding_model(spark: SparkSession, d: str) -> encoding.Model:
    return encoding.fit(_texts(spark, d).where("tabela <> 'corpo_lido'"), "texto")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.judged(_texts(spark, d), ["tabela", "registro_id"], "texto", _encoding_model(spark, d)).select("tabela", "registro_id")


def p2_chains(spark: SparkSession, d: str) -> DataFrame:
    """Garbled records with the chains their words went through."""
    return encoding.judged(_texts(spark, d), ["tabela", "registro_id"], "texto", _encoding_model(spark, d))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled records with their text restored as far as it can be."""
    done = encoding.restored(_texts(spark, d), ["tabela", "registro_id"], "texto", _encoding_model(spark, d))
    return done.where("mudou OR perda")


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    """The three fields that hold page text, in one shape."""
    fields = (("corpo_lido", "texto_completo", "corpo_id"), ("corpo_lido", "trecho_corpo", "corpo_id"), ("extracao", "texto", "extracao_id"))
    parts = [table(spark, d, t).select(F.lit(f"{t}.{c}").alias("campo"), F.col(i).alias("id"), "url", "titulo", F.col(c).alias("texto")) for t, c, i in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture(_page_rows(spark, d)).select("campo", F.col("id").alias("registro_id"), "linha_no")


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Every page text with only the lines of its story."""
    rows = _page_rows(spark, d)
    return boilerplate.main_text(rows, written(boilerplate.furniture(rows))).withColumnRenamed("id", "registro_id")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return history.keyed(table(spark, d, "checagens"), "checagem_id", ["lote", "checagem_id"], "url", "titulo", "trecho")


def _registry(spark: SparkSession) -> history.Registry:
    return history.Registry(spark, f"{shared_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record that repeats an accepted one, the batches taken through the registry in their order."""
    done = history.fold_batches(_registry(spark), written(_keyed(spark, d)), "lote").where(F.col("duplicate_of").isNotNull())
    return done.select(F.col("duplicate_of").alias("checagem_id_a"), F.col("id").alias("checagem_id_b"))


def p4_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last batch against the registry of all accepted before it, which the earlier batches built."""
    records = written(_keyed(spark, d))
    last = records.agg(F.max("pos.lote")).first()[0]
    earlier = written(records.where(F.col("pos.lote") < last))
    registry = _registry(spark)
    accepted = history.fold_batches(registry, earlier, "lote").where(F.col("duplicate_of").isNull()).select("id")
    registry = history.Registry(spark, f"{registry.path}-all")  # one append, then opened anew
    registry.append(earlier.join(accepted, "id", "left_semi"), "before")
    return history.Registry(spark, registry.path).check(records.where(F.col("pos.lote") == last)).select(F.col("id").alias("checagem_id"), F.col("duplicate_of").alias("repete"))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.overlaps(overlap.sided(table(spark, d, "v6_pool"), table(spark, d, "v6_splits"), "rid", "text_no_url", "split_full_iid"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.expanded(*_overlaps(spark, d))
    return pairs.select(F.least("train_id", "eval_id").alias("rid_a"), F.greatest("train_id", "eval_id").alias("rid_b")).where("rid_a <> rid_b").distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlap per side, publisher and channel."""
    of = table(spark, d, "v6_pool").select(F.col("rid").alias("id"), "publisher", "channel")
    return overlap.counts(*_overlaps(spark, d), of)


QUERIES = {f.__name__: f for f in (p1_found, p1_sides, p1_shares, p2_found, p2_chains, p2_restored, p3_found, p3_main_text, p4_found, p4_batch, p6_found, p6_counts, p7_found, p7_lines, p7_clean, p7_rebuilt, p8_pack, p8_usage, p9_mix, p9_shares, p9_beyond, p10_found, p10_shares, p10_limits)}
SQL = {
    "p1_found": """
WITH lados AS (
  SELECT near_dup_cluster, coluna, regexp_replace(lower(trim(lado)), '[-\\s]+', '_', 'g') AS lado
  FROM (SELECT near_dup_cluster, 'split_bal_iid' AS coluna, split_bal_iid AS lado FROM v6_splits
        UNION ALL SELECT near_dup_cluster, 'split_ood_wa', split_ood_wa FROM v6_splits)
  WHERE near_dup_cluster IS NOT NULL AND near_dup_cluster <> -1)
SELECT near_dup_cluster, coluna FROM lados WHERE lado <> 'unused' AND lado <> '' GROUP BY 1, 2 HAVING count(DISTINCT lado) > 1
""",
    "p7_found": """
WITH portal AS (SELECT url, max(portal_id) AS portal_id FROM fonte_evidencia GROUP BY url),
pag AS (SELECT c.corpo_id, c.url, p.portal_id, string_split(c.texto_completo, chr(10)) AS ls
        FROM corpo_lido c JOIN portal p ON p.url = c.url WHERE length(c.texto_completo) > 0 AND p.portal_id IS NOT NULL),
lin AS (SELECT corpo_id, url, portal_id, i - 1 AS linha_no, regexp_replace(lower(ls[i]), '[^\\p{L}]+', '', 'g') AS k
        FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM pag)),
tot AS (SELECT portal_id, count(DISTINCT url) AS n FROM pag GROUP BY 1),
rep AS (SELECT portal_id, k, count(DISTINCT url) AS n FROM lin WHERE k <> '' GROUP BY 1, 2)
SELECT l.corpo_id, CAST(l.linha_no AS INTEGER) AS linha_no FROM lin l JOIN rep r USING (portal_id, k) JOIN tot t USING (portal_id)
WHERE r.n >= 4 AND r.n * 20 >= t.n
""",
}
