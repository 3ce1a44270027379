"""Keyed merges of a registry: upserts with precedence, fusion by address, prunes and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], replaces: Column, excluded: DataFrame | None = None) -> DataFrame:
    """Rows of both by key; a new row takes an old one's place where ``replaces`` (over columns o_* and n_*) holds.

    Both sides must hold one row per key (see ``latest``). Excluded keys leave on both sides.
    """
    cols = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("_o"))
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_n"))
    both = o.join(n, key, "full")
    if excluded is not None:
        both = both.join(excluded, key, "left_anti")
    take = F.col("_o").isNull() | (F.col("_n").isNotNull() & F.coalesce(replaces, F.lit(False)))
    return both.select(*key, *[F.when(take, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in cols])


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row per key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def fused(rows: DataFrame, key: Column, sets: list[str], firsts: list[str], order: str) -> DataFrame:
    """One row per key: unions of ``sets`` (arrays or values), the first filled value of ``firsts`` in ``order``."""
    keyed = rows.withColumn("chave", key).where(F.col("chave").isNotNull() & (F.col("chave") != ""))
    union = [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    first = [F.min_by(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c)), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in firsts]
    return keyed.groupBy("chave").agg(F.count("*").alias("n"), *union, *first)


def pruned(rows: DataFrame, listing: DataFrame, key: list[str], doomed: Column) -> DataFrame:
    """``rows`` without those of ``doomed`` whose key the listing lacks; a row it holds stays, whatever it is."""
    seen = listing.select(*key).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, key, "left").where(F.col("_seen").isNotNull() | ~F.coalesce(doomed, F.lit(False))).drop("_seen")
