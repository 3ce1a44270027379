"""The same or almost the same text on two sides of a split.

Evaluation texts store hashes of word runs, training texts are scanned for them, and hits are judged by containment and
exact word distance (see ``segments``). Work is on distinct texts; memberships expand at the end, and only into the pairs
that the result names.

Defined results: texts that are null or without words overlap with nothing; a row delivered twice counts once; rows of no
named side (such as 'unused') are left out; an id on two sides is judged on each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm import segments
from lastro.llm.splits import side_name
from lastro.session import written

TRAIN, EVALUATION = "train", ("val_sel", "val_calib", "test")


def sided(pool: DataFrame, splits: DataFrame, id: str, text: str, column: str) -> DataFrame:
    """(id, side, content, f, n) of the rows on training and evaluation sides; only their texts are folded."""
    side = splits.select(F.col(id).alias("id"), side_name(F.col(column)).alias("side")).where(F.col("side").isin(TRAIN, *EVALUATION)).distinct()
    rows = pool.select(F.col(id).alias("id"), F.col(text).alias("_text")).join(side, "id")
    return segments.contents(rows, F.col("_text")).select("id", "side", "content", "f", "n")


def overlaps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of contents (a of evaluation, b of training; distance, containment), equal ones included, and the members (id, side, content).

    Evaluation texts store their segments' hashes, which are broadcast if they are few; training texts are scanned for them
    before anything of theirs is shuffled. Containment of the evaluation text in the training text decides first.
    """
    rows = written(rows)
    evaluation = written(segments.distinct_texts(rows.where(F.col("side") != TRAIN)))
    # Copies within training are looked up like any row: their pairs are one once contents are compared.
    train = rows.where(F.col("side") == TRAIN).select("content", "f", "n")
    near = segments.near_pairs(evaluation, train)
    same = rows.where(F.col("side") == TRAIN).select("content").join(evaluation.select("content"), "content", "left_semi").distinct().select(F.col("content").alias("a"), F.col("content").alias("b"), F.lit(0).alias("distance"), F.lit(1.0).alias("containment"))
    return written(near.unionByName(same).distinct()), rows.select("id", "side", "content")


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(train_id, eval_id, side, distance, containment): pairs of contents as pairs of rows."""
    e = members.where(F.col("side") != TRAIN).select(F.col("content").alias("a"), F.col("id").alias("eval_id"), "side")
    t = members.where(F.col("side") == TRAIN).select(F.col("content").alias("b"), F.col("id").alias("train_id"))
    return pairs.join(e, "a").join(t, "b").select("train_id", "eval_id", "side", "distance", "containment")


def counts(pairs: DataFrame, members: DataFrame, of: DataFrame) -> DataFrame:
    """Per side and the columns of ``of`` (keyed by id): evaluation rows and how many of them stand in training too; pairs are not expanded."""
    hit = pairs.select(F.col("a").alias("content")).distinct().withColumn("hit", F.lit(1))
    rows = members.where(F.col("side") != TRAIN).join(hit, "content", "left").join(of, "id", "left")
    by = [c for c in of.columns if c != "id"]
    return rows.groupBy("side", *by).agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("n_overlap"))
