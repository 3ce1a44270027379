"""Sources mixed to target shares of tokens, by balanced sampling with the cube method.

Each source's rate (copies per document) follows from its target; whole copies are certain, the fraction is an inclusion
probability. The flight phase moves the probabilities of three documents at a time along the null space of the constraints
(documents and tokens of the source), so every step fixes one at 0 or 1 and leaves both totals as they were. Sources are
cut into blocks of bounded size that fly on their own; what a block cannot fix (at most two documents) flies on with the
other blocks' rests, and the last two of a source land on the choice nearest to its tokens. Documents fly largest first, so
that those left to land are small; where one larger than its source's whole share lands, what it leaves open is closed with
small documents.

The total is the largest at which every source that has documents reaches its share within its repetitions, unless a
smaller or larger one is asked for; beyond it, short sources give all their repetitions and their shares come out low.

Defined results: a source without documents or with weight 0 gives nothing and its weight is spread over the others;
documents without text or of a source that isn't listed take no part; repeated ids are drawn row by row; ties are settled by
id; empty tables give empty results.
"""

from __future__ import annotations

import random
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.tokens import n_tokens
from lastro.session import written

BLOCK_ROWS = 50_000
EPS = 1e-9
#: How many times the next size makes an outlier.
OUTLIER = 3


def flight(pi: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Probabilities moved to 0 or 1 with the sum of pi x size unchanged, and their own sum but for outliers; at most two are left between.

    Sizes descend; each step keeps every probability's expectation.
    """
    pi = list(pi)
    active: list[int] = []
    for k in [*range(len(pi)), None]:
        if k is not None and EPS < pi[k] < 1 - EPS:
            active.append(k)
        while len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (c - b, a - c, b - a)
            if not any(u):  # equal sizes: any two may trade
                u = (1, -1, 0)
            elif a > OUTLIER * b:
                # One far larger than the rest hardly moves while their number is kept, so it trades tokens alone.
                u = (b / a, -1, 0)
            up = min((1 - pi[i]) / d if d > 0 else pi[i] / -d for i, d in zip(active, u, strict=True) if d)
            down = min(pi[i] / d if d > 0 else (1 - pi[i]) / -d for i, d in zip(active, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in zip(active, u, strict=True):
                pi[i] = min(1.0, max(0.0, pi[i] + step * d))
            active = [i for i in active if EPS < pi[i] < 1 - EPS]
    return [round(x) if x <= EPS or x >= 1 - EPS else x for x in pi]


def landing(pi: list[float], size: list[int]) -> list[int]:
    """The 0/1 choice for the last few whose tokens, then documents, come nearest to those expected."""
    tokens, n = sum(p * s for p, s in zip(pi, size, strict=True)), sum(pi)
    return list(min(product((0, 1), repeat=len(pi)), key=lambda x: (abs(sum(c * s for c, s in zip(x, size, strict=True)) - tokens), abs(sum(x) - n), x)))


def rates(per_source: list[tuple[str, float, int, int]], total: float | None = None, stretch: float = 1.0) -> dict[str, tuple[float, float]]:
    """source -> (copies per document, target tokens) from (source, weight, repetitions, tokens)."""
    live = [(s, w, r, t) for s, w, r, t in per_source if t and w > 0 and r > 0]
    share = sum(w for _, w, _, _ in live)
    if not live:
        return {}
    reachable = min(r * t / (w / share) for _, w, r, t in live)
    want = reachable * stretch if total is None else total
    return {s: (min(float(r), want * w / share / t), want * w / share) for s, w, r, t in live}


def closed(landed: DataFrame, goals: dict[str, float]) -> DataFrame:
    """(source, id, tokens, flip): the few documents to take or leave so that a landing on a very large one is made good.

    A source that landed short takes, and one that landed over leaves, documents in hash order as long as they fit into what
    is missing. That is at most one document's size, so the documents asked are a hash sample of a few times as many tokens,
    whatever the size of the source.
    """
    spark = landed.sparkSession
    had = {r["source"]: r["t"] for r in landed.groupBy("source").agg(F.sum((F.col("whole") + F.col("pi")) * F.col("tokens")).alias("t")).collect()}
    gaps = spark.createDataFrame([(s, float(t - had.get(s, 0.0))) for s, t in goals.items()], "source string, gap double")
    fits = landed.join(F.broadcast(gaps), "source").where((F.col("tokens") <= F.abs("gap")) & (F.col("pi") == F.when(F.col("gap") > 0, 0.0).otherwise(1.0)))
    supply = fits.groupBy("source").agg(F.sum("tokens").alias("supply"))
    share = F.least(F.lit(1.0), 8 * F.abs("gap") / F.col("supply"))
    asked = fits.join(F.broadcast(supply), "source").withColumn("o", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000))).where(F.col("o") < share * 1_000_000)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        left, rows = abs(pdf["gap"].iloc[0]), []
        for r in pdf.sort_values(["o", "id"]).itertuples():
            if r.tokens <= left:
                rows.append((r.source, r.id, r.tokens, True))
                left -= r.tokens
        return pd.DataFrame(rows, columns=["source", "id", "tokens", "flip"])

    kind = landed.schema["id"].dataType.simpleString()
    return asked.select("source", "id", "tokens", "gap", "o").groupBy("source").applyInPandas(take, f"source string, id {kind}, tokens int, flip boolean")


def mix(docs: DataFrame, id: str, source: str, text: str, targets: DataFrame, total: float | None = None, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, tokens, copias; rows with copies only) and its report per source of ``targets`` (source, peso_alvo, max_repeticoes).

    The total is ``total`` tokens, or ``stretch`` times the largest that all sources can reach.

    The targets and one sum per source come to the driver: as many rows as there are targets.
    """
    wanted = {r["source"]: (float(r["peso_alvo"]), int(r["max_repeticoes"])) for r in targets.where("source IS NOT NULL AND peso_alvo IS NOT NULL").select("source", "peso_alvo", F.coalesce("max_repeticoes", F.lit(1)).alias("max_repeticoes")).collect()}
    listed = F.broadcast(targets.select(F.col("source")).distinct())
    sized = docs.where((F.length(text) > 0) & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("_t")).join(listed, "source")
    sized = written(sized.select("id", "source", n_tokens(F.col("_t")).alias("tokens")).where("tokens > 0"))
    sums = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    rate = rates([(s, w, r, sums.get(s, (0, 0))[0]) for s, (w, r) in wanted.items()], total, stretch)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, int(r + EPS), max(0.0, r - int(r + EPS)), max(1, -(-sums[s][1] // BLOCK_ROWS))) for s, (r, _) in rate.items()], "source string, whole int, pi double, blocks int")
    kind = sized.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, tokens int, whole int, pi double"

    def fly(last: bool):  # noqa: ANN202
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["tokens", "o", "id"], ascending=[False, True, True], kind="stable")
            sizes = pdf["tokens"].tolist()
            pi = flight(pdf["pi"].tolist(), sizes, random.Random(f"{pdf['source'].iloc[0]}:{len(pdf)}:{sum(sizes)}"))
            if last:
                left = [i for i, p in enumerate(pi) if 0 < p < 1]
                for i, x in zip(left, landing([pi[i] for i in left], [sizes[i] for i in left]), strict=True):
                    pi[i] = x
            pdf["pi"] = [float(p) for p in pi]
            return pdf[["id", "source", "tokens", "whole", "pi"]]

        return run

    order = F.xxhash64("id").alias("o")
    rows = sized.join(F.broadcast(plan), "source").withColumn("block", F.pmod(F.xxhash64("id", "tokens"), F.col("blocks")))
    first = written(rows.select("id", "source", "tokens", "whole", "pi", "block", order).groupBy("source", "block").applyInPandas(fly(False), schema))
    rest = first.where("pi > 0 AND pi < 1").select("*", order).groupBy("source").applyInPandas(fly(True), schema)
    landed = written(first.where("pi = 0 OR pi = 1").unionByName(rest))
    flipped = closed(landed, {s: t for s, (r, t) in rate.items() if r < wanted[s][1]})
    pi = F.when(F.col("flip"), 1 - F.col("pi")).otherwise(F.col("pi"))
    out = landed.join(F.broadcast(flipped), ["source", "id", "tokens"], "left").withColumn("copias", F.col("whole") + pi.cast("int")).where("copias > 0").select("id", "source", "tokens", "copias")
    out = written(out)
    got = out.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("copias")).alias("tokens_obtidos"), F.count("*").alias("documentos"), F.sum("copias").alias("copias"), F.max("copias").alias("mais_repetido"))
    goal = spark.createDataFrame([(s, w, r, sums.get(s, (0, 0))[1], float(rate.get(s, (0.0, 0.0))[1])) for s, (w, r) in wanted.items()], "source string, peso_alvo double, max_repeticoes int, documentos_fonte long, tokens_alvo double")
    report = goal.join(got, "source", "left").fillna(0, ["tokens_obtidos", "documentos", "copias", "mais_repetido"])
    all_tokens = out.agg(F.coalesce(F.sum(F.col("tokens").cast("long") * F.col("copias")), F.lit(0))).first()[0] or 1
    return out, report.withColumn("peso_obtido", F.col("tokens_obtidos") / F.lit(all_tokens))
