"""Items into containers of fixed capacity, neighbours on a space-filling curve together.

Documents become hashed vectors of their word pairs, projected to a few dimensions; the Hilbert key of the projection puts
like beside like. Documents are range-sorted by it and packed along the curve, each into the fullest open container that
still takes it. Only texts larger than a container are split, into full containers and one remainder, which is packed like
any other item. What each task leaves far from full is packed once more, together.

Defined results: texts without tokens need no room and get no container; equal texts lie side by side on the curve and are
told apart by id; a capacity below one is an error; empty tables give empty results.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.text import fold, words
from lastro.llm.tokens import n_tokens
from lastro.session import written

DIMENSIONS = 4
BITS = 12
#: Open containers per task: an item goes to the fullest of them that takes it.
OPEN = 512


def projection(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Means of +-1 over hashed word pairs, one per dimension: a random projection of the hashed vector of pairs, computed without the vector."""
    start = F.array(*[F.lit(0.0)] * dimensions)
    sign = lambda h, i: F.when(F.shiftrightunsigned(h, 7 * i + 1).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)

    def summed(w: Column) -> Column:
        follow = F.slice(F.concat(w, F.array(F.lit(""))), F.lit(2), F.greatest(F.size(w), F.lit(1)))
        pairs = F.zip_with(w, follow, lambda a, b: F.xxhash64(a, b))
        total = F.aggregate(pairs, start, lambda acc, h: F.array(*[acc[i] + sign(h, i) for i in range(dimensions)]))
        return F.transform(total, lambda x: x / F.sqrt(F.greatest(F.size(w), F.lit(1)).cast("double")))

    # The words are bound once; a text's words must not be cut anew for each of its pairs.
    return F.element_at(F.transform(F.array(words(fold(text))), summed), 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of integer points (n, d) on the Hilbert curve, for all points at once (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(point: Column, bits: int = BITS) -> Column:
    """Hilbert key of points whose coordinates lie about within -4 and 4."""

    @F.pandas_udf("long")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            p = np.stack(s.to_list()) if len(s) else np.zeros((0, DIMENSIONS))
            cells = np.clip((p + 4.0) / 8.0 * (1 << bits), 0, (1 << bits) - 1)
            yield pd.Series(hilbert(cells, bits))

    return key(point)


def fill(items: Iterator[tuple], capacity: int, open_limit: int = OPEN) -> Iterator[tuple[list[tuple], int]]:
    """Containers (items, used) of items (size, ...) in order, each put into the fullest open container that takes it.

    A full container is closed at once; beyond ``open_limit`` the fullest is.
    """
    rooms: list[tuple[int, int]] = []  # (free, number), ascending
    inside: dict[int, list[tuple]] = {}
    n = 0
    for item in items:
        size = item[0]
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            free, number = rooms.pop(at)
        else:
            free, number = capacity, n
            inside[number] = []
            n += 1
        inside[number].append(item)
        free -= size
        if free:
            bisect.insort(rooms, (free, number))
            if len(rooms) > open_limit:
                free, number = rooms.pop(0)
                yield inside.pop(number), capacity - free
        else:
            yield inside.pop(number), capacity
    for free, number in rooms:
        yield inside.pop(number), capacity - free


def pack(docs: DataFrame, id: str, text: str, capacity: int, good: float = 0.98) -> DataFrame:
    """(container, id, parte, tokens): containers named by task and number; parts count from 0 where a text is split.

    The first pass closes containers filled to ``good`` and hands on the items of the others, which a second pass packs
    largest first over the curve order; those are few: at most the open containers of each task.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    points = written(docs.where(F.length(text) > 0).select(F.col(id).alias("id"), n_tokens(F.col(text)).alias("tokens"), projection(F.col(text)).alias("point")))
    sized = written(points.where("tokens > 0").select("id", "tokens", keys(F.col("point")).alias("key")))
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = F.col("tokens") - whole * capacity
    full = sized.where(whole > 0).select("id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("parte")).select(F.concat_ws("-", F.lit("c"), "id", "parte").alias("container"), "id", "parte", F.lit(capacity).alias("tokens"))
    loose = sized.where(rest > 0).select("key", "id", whole.alias("parte"), rest.cast("int").alias("tokens"))
    kind = docs.schema[id].dataType.simpleString()
    schema = f"container string, key long, id {kind}, parte int, tokens int"

    def packer(name: str, keep: float):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first: list[str] = []

            def rows() -> Iterator[tuple]:
                for pdf in batches:
                    if not first and len(pdf):
                        first.append(f"{pdf['key'].iloc[0]}-{pdf['id'].iloc[0]}")
                    yield from zip(pdf["tokens"].tolist(), pdf["key"].tolist(), pdf["id"].tolist(), pdf["parte"].tolist(), strict=True)

            out: list[tuple] = []
            for n, (items, used) in enumerate(fill(rows(), capacity)):
                box = f"{name}-{first[0]}-{n}" if used >= keep * capacity else None
                out += [(box, k, i, part, size) for size, k, i, part in items]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["container", "key", "id", "parte", "tokens"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["container", "key", "id", "parte", "tokens"])

        return run

    along = loose.repartitionByRange("key", "id", "parte").sortWithinPartitions("key", "id", "parte")
    once = written(along.mapInPandas(packer("a", good), schema))
    left = once.where("container IS NULL")
    # Containers short of good are a share of the open ones; they are gathered by curve order into tasks of many containers.
    tasks = max(1, int(left.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // (capacity * 20_000)))
    twice = left.repartitionByRange(tasks, "key", "id", "parte").sortWithinPartitions(F.desc("tokens"), "key", "id", "parte").mapInPandas(packer("b", 0.0), schema)
    return full.unionByName(once.where("container IS NOT NULL").select("container", "id", "parte", "tokens")).unionByName(twice.select("container", "id", "parte", "tokens"))


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the fewest containers that could hold them, and the share of room used."""
    box = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    out = box.agg(F.count("*").alias("recipientes"), F.sum("n").alias("itens"), F.sum("t").alias("tokens"), F.max("t").alias("maior"))
    return out.withColumn("minimo", F.ceil(F.col("tokens") / capacity)).withColumn("uso", F.col("tokens") / (F.col("recipientes") * capacity))
