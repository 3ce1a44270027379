"""Evaluation measures as grouped DataFrame aggregates: intervals, classification, ranking, calibration, paired tests.

Frames of predictions hold a probability and a 0/1 target; rows with a null in either are left out. Groups are any list of
columns, empty for the whole table. Each measure is one or two groupings with partial sums; none pairs rows up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.session import written


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of the Wilson interval of k of n, clipped to 0..1; null for n = 0."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def _rated(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(p).alias("_p"), F.col(y).cast("int").alias("_y"))


def classification(df: DataFrame, p: str, y: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per group: n, accuracy, precision, recall and F1 of both classes, macro-F1, Brier score."""
    by = by or []
    r = _rated(df, p, y, by).withColumn("_h", (F.col("_p") >= threshold).cast("int"))
    cell = lambda h, t: F.sum(F.when((F.col("_h") == h) & (F.col("_y") == t), 1).otherwise(0))
    g = r.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"), F.count("*").alias("n"), F.avg((F.col("_p") - F.col("_y")) ** 2).alias("brier")).where("n > 0")
    f1 = lambda t, a, b: F.when(2 * F.col(t) + F.col(a) + F.col(b) > 0, 2 * F.col(t) / (2 * F.col(t) + F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    g = g.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / F.col("n"), "f1_pos": f1("tp", "fp", "fn"), "f1_neg": f1("tn", "fn", "fp")})
    return g.withColumn("macro_f1", (F.col("f1_pos") + F.col("f1_neg")) / 2)


def _before(df: DataFrame, by: list[str], order: Column, sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums (name -> column) of the rows before each, per group in an order, without a task per group.

    Rows are range-sorted, summed within their partition, and the partitions' sums are added up: one row per group and partition.
    """
    ordered = written(df.withColumn("_o", order).repartitionByRange(*by, "_o").sortWithinPartitions(*by, "_o").withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    within = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_in"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    same = F.col("_part") == F.col("_in")
    for c in by:  # a null group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = ordered.join(parts, same)
    return out.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}).drop("_o", "_row", "_part", "_in", *[f"_{n}" for n in sums], *[f"_by_{c}" for c in by])


def auc(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Per group the area under the ROC curve, ties counted half, by ranks of distinct scores; null where a class is missing."""
    by = by or []
    g = _rated(df, p, y, by).groupBy(*by, "_p").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    g = _before(g, by, F.col("_p"), {"below": "neg"})
    out = g.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return out.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def average_precision(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Per group the step-wise area under the precision-recall curve."""
    by = by or []
    g = _rated(df, p, y, by).groupBy(*by, "_p").agg(F.sum("_y").alias("pos"), F.count("*").alias("n"))
    g = _before(g, by, -F.col("_p"), {"tp0": "pos", "seen0": "n"}).withColumns({"tp": F.col("tp0") + F.col("pos"), "seen": F.col("seen0") + F.col("n")})
    return g.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.sum("pos").alias("np")).select(*by, F.when(F.col("np") > 0, F.col("s") / F.col("np")).alias("average_precision"))


def calibration_error(df: DataFrame, p: str, y: str, by: list[str] | None = None, bins: int = 15) -> DataFrame:
    """Per group the expected calibration error over ``bins`` right-closed bins of confidence."""
    by = by or []
    r = _rated(df, p, y, by)
    conf = F.when(F.col("_p") >= 0.5, F.col("_p")).otherwise(1 - F.col("_p"))
    right = (F.when(F.col("_p") >= 0.5, 1).otherwise(0) == F.col("_y")).cast("double")
    g = r.select(*by, conf.alias("c"), right.alias("r")).withColumn("bin", F.ceil(F.col("c") * bins)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("r").alias("acc"), F.avg("c").alias("conf"))
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Per bin of probability (right-closed, the first closed): n, mean probability, share of positives."""
    b = F.greatest(F.ceil(F.col("_p") * bins), F.lit(1)).cast("int")
    return _rated(df, p, y, []).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("_p").alias("mean_p"), F.avg("_y").alias("share"))


def threshold_sweep(df: DataFrame, p: str, y: str, low: int = 5, high: int = 95) -> DataFrame:
    """(threshold, macro_f1) for thresholds low..high in hundredths; the rows are first cut down to counts per hundredth."""
    r = _rated(df, p, y, []).groupBy(F.floor(F.round(F.col("_p") * 100, 6)).cast("int").alias("c")).agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    steps = F.broadcast(df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t")))
    g = r.join(steps, F.lit(True)).groupBy("t").agg(*[F.sum(F.when((F.col("c") >= F.col("t")) == hit, F.col(k)).otherwise(0)).alias(name) for name, k, hit in (("tp", "pos", True), ("fp", "neg", True), ("fn", "pos", False), ("tn", "neg", False))])
    f1 = lambda t, a, b: F.when(2 * F.col(t) + F.col(a) + F.col(b) > 0, 2 * F.col(t) / (2 * F.col(t) + F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    return g.select((F.col("t") / 100).alias("threshold"), ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("macro_f1"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar probability of b and c discordant pairs; 1 where there are none."""
    n, k = b + c, F.least(b, c)
    log_term = lambda i: F.aggregate(F.when(i > 0, F.sequence(F.lit(1), F.greatest(i, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, j: a + F.log((n - j + 1) / j))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda a, i: a + F.exp(log_term(i) - n * F.log(F.lit(2.0))))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(F.lit(1.0))


def nearest_rank(values: Column, q: float) -> Column:
    """Percentile by nearest rank, the index rounded half to even."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.bround(q * (F.size(ordered) - 1)).cast("int"))


def group_weights(df: DataFrame, cell: list[str], clip: float = 25.0) -> DataFrame:
    """(cell columns, n, weight): inverse cell sizes scaled to mean 1, clipped, and scaled to mean 1 again."""
    cells = df.groupBy(*cell).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row per cell
    total, k = F.sum("n").over(w), F.count("*").over(w)
    cells = cells.withColumn("_raw", F.least(total / k / F.col("n"), F.lit(clip))).withColumn("_mean", F.sum(F.col("_raw") * F.col("n")).over(w) / total)
    return cells.select(*cell, "n", (F.col("_raw") / F.col("_mean")).alias("weight"))


def vocabulary(df: DataFrame, tokens: Column, by: str) -> DataFrame:
    """Per class: tokens, types, type-token ratio and hapaxes in per cent."""
    counted = df.select(F.col(by), F.explode(tokens).alias("t")).groupBy(by, "t").agg(F.count("*").alias("c"))
    return counted.groupBy(by).agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("c") == 1).alias("hapax")).withColumn("ttr", 100 * F.col("types") / F.col("tokens")).withColumn("hapax_pct", 100 * F.col("hapax") / F.col("types"))


def log_odds(df: DataFrame, tokens: Column, side: Column, least: int = 10) -> DataFrame:
    """(bigram, a, b, delta, z): log-odds with an informative Dirichlet prior of bigrams on side true against side false.

    Bigrams in fewer than ``least`` rows are left out; the prior is a tenth of each bigram's count.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("t", i - 1), F.get("t", i)))
    seen = df.where(side.isNotNull()).select(side.alias("s"), F.monotonically_increasing_id().alias("r"), F.explode(F.array(tokens)).alias("t")).where(F.size("t") > 1)
    each = seen.select("s", "r", F.explode(pairs).alias("bigram")).groupBy("bigram", "r", "s").agg(F.count("*").alias("c"))
    g = each.groupBy("bigram").agg(F.sum(F.when(F.col("s"), F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("s"), F.col("c")).otherwise(0)).alias("b"), F.count("*").alias("df")).where(F.col("df") >= least)
    total = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # one row
    al = 0.1 * (F.col("a") + F.col("b"))
    a0 = 0.1 * (F.col("na") + F.col("nb"))
    delta = F.log((F.col("a") + al) / (F.col("na") + a0 - F.col("a") - al)) - F.log((F.col("b") + al) / (F.col("nb") + a0 - F.col("b") - al))
    return g.join(F.broadcast(total), F.lit(True)).select("bigram", "a", "b", delta.alias("delta"), (delta / F.sqrt(1 / (F.col("a") + al) + 1 / (F.col("b") + al))).alias("z"))


def platt(df: DataFrame, z: str, y: str, rounds: int = 25, ridge: float = 1e-6) -> tuple[float, float]:
    """(slope, intercept) of a logistic calibration of one score, by Newton steps on five sums over all rows per round."""
    rows = df.where(F.col(z).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(z).cast("double").alias("z"), F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
    rows = written(rows)
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("z") + F.lit(b))))
        w, e = F.col("n") * p * (1 - p), F.col("n") * (F.col("y") - p)
        s = rows.agg(F.sum(e * F.col("z")), F.sum(e), F.sum(w * F.col("z") * F.col("z")), F.sum(w * F.col("z")), F.sum(w)).first()
        if s[1] is None:
            return 0.0, 0.0
        g0, g1, h00, h01, h11 = s[0] - ridge * a, s[1], s[2] + ridge, s[3], s[4] + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b
