"""Splits that keep related records together: components, largest-differencing bins, bins to sides.

Defined results: records without any key are their own group; keys that are null or listed as ``none`` link nothing; a
repeated id counts once and all its rows get one side; ids that are null are left out; empty tables give empty results;
columns of other names are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.operators.graph import connected
from lastro.session import written


def side_name(c: Column) -> Column:
    """One spelling per side: trimmed, lower case, hyphens and spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def components(records: DataFrame, id: str, keys: list[str], none: tuple = (-1,)) -> DataFrame:
    """(id, component): records that share a value of any key, directly or through others, share a component.

    Only ids that name two or more different values make edges, between values, so with one key per record there is no
    graph work at all, and a value that a third of all records share costs one pass.
    """
    valid = [F.when(F.col(k).isNotNull() & ~F.col(k).cast("string").isin([str(x) for x in none]), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    named = records.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.filter(F.array(*valid), lambda x: x.isNotNull()).alias("ks"))
    own = named.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ks")))).alias("ks"))
    own = written(own)
    edges = own.where(F.size("ks") > 1).select(F.explode(F.slice("ks", F.lit(2), F.size("ks"))).alias("a"), F.col("ks")[0].alias("b"))
    first = own.select("id", F.when(F.size("ks") > 0, F.get("ks", 0)).alias("node"))
    lone = F.concat(F.lit("id:"), F.col("id").cast("string"))
    if edges.isEmpty():
        return first.select("id", F.coalesce("node", lone).alias("component"))
    return first.join(connected(edges), "node", "left").select("id", F.coalesce("root", "node", lone).alias("component"))


def largest_differencing(weights: list[tuple], bins: int) -> tuple[list[list], list[int]]:
    """Items (weight, key) into ``bins`` bins: the two partial divisions with the widest spread are merged, largest bin with smallest, until one is left."""
    heap = []
    for i, (w, key) in enumerate(sorted(weights, key=lambda x: (-x[0], str(x[1])))):
        heap.append((-w, i, [(0, [])] * (bins - 1) + [(w, [key])]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x + y, (p + q) if p and q else (p or q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda t: t[0])
        base = merged[0][0]
        n += 1
        heapq.heappush(heap, (-(merged[-1][0] - base), n, merged))
    last = heap[0][2] if heap else [(0, [])] * bins
    return [keys for _, keys in last], [w for w, _ in last]


def to_sides(bin_weights: list[int], proportions: dict[str, float]) -> list[str]:
    """A side for each bin, heaviest bins first, each to the side that is furthest below its share."""
    total, got, out = sum(bin_weights) or 1, dict.fromkeys(proportions, 0), [""] * len(bin_weights)
    for i in sorted(range(len(bin_weights)), key=lambda i: (-bin_weights[i], i)):
        side = max(proportions, key=lambda s: (proportions[s] * total - got[s], proportions[s]))
        out[i], got[side] = side, got[side] + bin_weights[i]
    return out


def assign(members: DataFrame, proportions: dict[str, float], bins: int = 100, shard_rows: int = 1_000_000) -> DataFrame:
    """(id, component, side) with no component divided and sides near their proportions.

    Components of equal weight are dealt level over all bins without any task seeing them together; fewer than ``bins`` of
    each weight and shard are left over, and those go through largest differencing, one task per shard of at most about
    ``shard_rows`` components. Only the sums of each shard's bins come to the driver, where largest differencing joins
    the shards and whole bins go to sides.
    """
    units = written(members.groupBy("component").agg(F.count("*").alias("w")))
    n = units.count()
    shards = max(1, -(-n // shard_rows))
    placed = units.withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)).cast("int"))
    w = Window.partitionBy("shard", "w")
    placed = placed.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("component"), "component")) - 1).withColumn("n", F.count("*").over(w))
    placed = placed.withColumn("level", F.col("r") < F.col("n") - F.col("n") % bins)

    def differenced(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sums = largest_differencing(list(zip(pdf["w"].tolist(), pdf["component"].tolist(), strict=True)), bins)
        rows = [(int(key[0]), c, i, int(s)) for i, (cs, s) in enumerate(zip(keys, sums, strict=True)) for c in cs]
        return pd.DataFrame(rows, columns=["shard", "component", "bin", "sum"])

    rest = written(placed.where(~F.col("level")).select("shard", "component", "w").groupBy("shard").applyInPandas(differenced, "shard int, component string, bin int, sum long"))
    sums = rest.groupBy("shard", "bin").agg(F.max("sum").alias("sum")).collect()  # shards x bins numbers
    level_sum = placed.where("level").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    by_shard: dict[int, list] = {}
    for s in sums:
        by_shard.setdefault(s["shard"], []).append((s["sum"], (s["shard"], s["bin"])))
    total = [(level_sum // bins, [])] * bins
    for s in sorted(by_shard):  # largest of one with smallest of the other
        add = sorted(by_shard[s] + [(0, None)] * (bins - len(by_shard[s])), key=lambda t: -t[0])
        total = [(x + y, keys + ([k] if k else [])) for (x, keys), (y, k) in zip(sorted(total, key=lambda t: t[0]), add, strict=True)]
    sides = to_sides([x for x, _ in total], proportions)
    spark = members.sparkSession
    bin_side = spark.createDataFrame([(s, b, side) for (_, keys), side in zip(total, sides, strict=True) for s, b in keys] or [(-1, -1, "")], "shard int, bin int, side string")
    level_side = spark.createDataFrame([(i, side) for i, side in enumerate(sides)], "bin int, side string")
    level = placed.where("level").withColumn("bin", (F.col("r") % bins).cast("int")).join(F.broadcast(level_side), "bin").select("component", "side")
    odd = rest.join(F.broadcast(bin_side) if shards * bins <= 200_000 else bin_side, ["shard", "bin"]).select("component", "side")
    return members.join(level.unionByName(odd), "component").select("id", "component", "side")


def divided(rows: DataFrame, id: str, columns: list[str], members: DataFrame, unused: tuple[str, ...] = ("unused",)) -> DataFrame:
    """(component, coluna, sides): components whose rows lie on two or more sides of a split column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), side_name(F.col(c)).alias("side")) for c in columns])).alias("x")
    sides = rows.select(F.col(id).alias("id"), each).select("id", "x.coluna", "x.side").where(F.col("side").isNotNull() & (F.col("side") != "") & ~F.col("side").isin(*unused))
    return sides.join(members, "id").groupBy("component", "coluna").agg(F.sort_array(F.collect_set("side")).alias("sides")).where(F.size("sides") > 1)
