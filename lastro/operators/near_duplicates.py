"""Near-duplicate clusters by MinHash bands over word shingles, and the rows to keep of exact copies.

Exact copies are one document before any signature is made, so a text that a third of all rows share costs one. Pairs come
from equal bands of different documents and are verified on their whole shingle sets; only links go on to the components.
Texts without words have no cluster; texts of fewer than five words cluster with their equals only.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastro.functions.text import fold, words
from lastro.operators.graph import connected
from lastro.session import written

PRIME = (1 << 31) - 1
BANDS, ROWS, SHINGLE = 16, 4, 5


def _coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def distinct_documents(df: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc, hashes) of distinct folded texts, hashes being the sorted CRC-32 of their five-word shingles; and the members (id, doc)."""
    folded = df.select(F.col(id).alias("id"), fold(F.col(text)).alias("f")).where(F.length("f") > 0)
    members = written(folded.select("id", F.xxhash64("f").alias("doc"), words(F.col("f")).alias("w")))
    once = members.groupBy("doc").agg(F.first("w").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - SHINGLE + 1, F.lit(1))), lambda i: F.crc32(F.array_join(F.slice("w", i, SHINGLE), " ").cast("binary")))
    docs = once.where(F.size("w") >= SHINGLE).select("doc", F.array_sort(F.array_distinct(runs)).alias("hashes"))
    return docs, members.select("id", "doc")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, hashes, sig): the least of (a x + b) mod p over the hashes, for each of the fixed coefficients, in Arrow batches."""
    pairs = _coefficients(BANDS * ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = (np.array(x, np.int64)[:, None] for x in zip(*pairs, strict=True))
        for pdf in batches:
            pdf["sig"] = [((a * (np.asarray(h, np.int64) % PRIME)[None, :] + b) % PRIME).min(axis=1) for h in pdf["hashes"]]
            yield pdf[["doc", "hashes", "sig"]]

    return docs.select("doc", "hashes").mapInPandas(run, "doc long, hashes array<long>, sig array<long>")


def links(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Verified pairs (a, b, jaccard) of different documents with an equal band."""
    signed = written(signatures(docs))
    bands = signed.select("doc", F.posexplode(F.array(*[F.xxhash64(F.slice("sig", i * ROWS + 1, ROWS), F.lit(i)) for i in range(BANDS)])).alias("i", "band"))
    pairs = bands.alias("x").join(bands.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.doc") < F.col("y.doc"))).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    h = signed.select("doc", "hashes")
    both = written(pairs).join(h.withColumnsRenamed({"doc": "a", "hashes": "ha"}), "a").join(h.withColumnsRenamed({"doc": "b", "hashes": "hb"}), "b")
    inter = F.size(F.array_intersect("ha", "hb"))
    return both.withColumn("jaccard", inter / (F.size("ha") + F.size("hb") - inter)).where((F.col("jaccard") >= similarity) & (inter >= 2)).select("a", "b", "jaccard")


def clusters(df: DataFrame, id: str, text: str, similarity: float = 0.8) -> DataFrame:
    """(id, cluster) of all rows with text; the cluster is the least id of the component."""
    docs, members = distinct_documents(df, id, text)
    found = written(links(docs, similarity))
    root = connected(found.select("a", "b"))
    named = members.join(root, members["doc"] == root["node"], "left").select("id", F.coalesce("root", "doc").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("cluster"))
    return named.join(least, "root").select("id", "cluster")


def majority_kept(df: DataFrame, key: str, label: str, id: str) -> DataFrame:
    """One row per key: of the label that most of its rows have, the smallest id; on ties the smallest id of all."""
    n = F.count("*").over(Window.partitionBy(key, label))
    ranked = df.where(F.col(key).isNotNull()).withColumn("_n", n)
    top = F.max("_n").over(Window.partitionBy(key))
    ranked = ranked.withColumn("_top", top)
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("_n") == F.col("_top"), 0).otherwise(1), id))).where("_r = 1").drop("_n", "_top", "_r")
