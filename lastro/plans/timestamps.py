"""Queries of the timestamp operator: raw dates of pages, evidence and links as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.operators import timestamps as ts
from lastro.session import table

#: Zones tried for sites whose zone is not declared: those of the declared sites' countries.
CANDIDATE_ZONES = [
    "America/Sao_Paulo", "America/Manaus", "America/Noronha", "America/New_York", "Europe/Lisbon", "Atlantic/Azores",
    "Africa/Luanda", "Africa/Maputo",
]


def _raw_values(spark: SparkSession, d: str) -> DataFrame:
    """All raw values with their portal and, where known, the moment they were ingested (seconds UTC)."""
    portal = table(spark, d, "fonte_evidencia").groupBy("url").agg(F.max("portal_id").alias("portal_id"))
    read = table(spark, d, "corpo_lido").where(F.trim("data_pub") != "").select(F.lit("corpo_lido").alias("tabela"), F.col("corpo_id").alias("registro_id"), "url", F.col("data_pub").alias("raw"), F.col("lido_em").alias("em"))
    item = table(spark, d, "item_evidencia").where(F.trim("data_pub_bruta") != "").select(F.lit("item_evidencia").alias("tabela"), F.col("item_id").alias("registro_id"), "url", F.col("data_pub_bruta").alias("raw"), F.col("recebido_em").alias("em"))
    link = table(spark, d, "link_lido").where(F.trim("data_pub") != "").select(F.lit("link_lido").alias("tabela"), F.col("link_id").alias("registro_id"), "portal_id", F.col("data_pub").alias("raw"), F.lit(None).cast("timestamp").alias("em"))
    both = read.unionByName(item).join(portal, "url", "left").drop("url").unionByName(link)
    seconds = F.unix_micros(F.to_timestamp(F.col("em"))) / 1_000_000
    return both.select("tabela", "registro_id", "portal_id", "raw", F.floor(seconds).cast("long").alias("ingested"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    # The catalogue of portals has a fixed number of rows, so it is broadcast.
    return F.broadcast(table(spark, d, "portais").select("portal_id", "fuso", "ordem_data"))


def _estimated(values: DataFrame) -> DataFrame:
    """Zones of sites by alignment of their zone-less local times with ingestion."""
    parsed = values.withColumn("p", ts.parse_raw(F.col("raw"), F.col("ordem_data")))
    local = parsed.where(F.col("p.local").isNotNull() & F.col("p.offset").isNull() & F.col("p.zone").isNull())
    return ts.estimate_zones(local.select("portal_id", F.col("p.local").alias("local"), "ingested"), "portal_id", "local", "ingested", CANDIDATE_ZONES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every readable raw value with its instant; sites without a declared zone get the one that ingestion order suggests."""
    values = _raw_values(spark, d).join(_sites(spark, d), "portal_id", "left")
    guessed = _estimated(values.where(F.col("fuso").isNull())).select(F.col("site").alias("portal_id"), F.col("zone").alias("guessed"))
    full = values.join(guessed, "portal_id", "left").withColumn("zone", F.coalesce("fuso", "guessed"))
    done = ts.normalise(full, "raw", "zone", "ordem_data").select("tabela", "registro_id", "instante_utc_s")
    # Evidence rows are delivered twice; one row per item counts. The filter stands behind the aggregate, so nothing is parsed twice.
    return done.groupBy("tabela", "registro_id").agg(F.min("instante_utc_s").alias("instante_utc_s")).where(F.col("instante_utc_s").isNotNull())


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """Per site: declared zone, zone estimated from ingestion alone, violations and rows."""
    values = _raw_values(spark, d).join(_sites(spark, d), "portal_id", "left")
    return _estimated(values).select(F.col("site").alias("portal_id"), "zone", "violations", "n").join(_sites(spark, d).select("portal_id", "fuso"), "portal_id", "left")


QUERIES = {"p5_found": p5_found, "p5_zones": p5_zones}
SQL: dict[str, str] = {}
