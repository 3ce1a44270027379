"""Streams of events and registry batches: windowed counts with watermarks, idempotent merges, a per-key limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(inicio, by, n) of a stream or table: events per window, those later than the watermark left out of closed windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("inicio"), by, "n")


def limited(events: DataFrame, key: str, id: str, ts: str, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, id, t, passa) of a stream: at most ``most`` events per key pass within ``seconds``, by event time.

    State is the times of the last passes of each key, ``most`` of them; it goes once the watermark has left them behind.
    Events of one batch are taken by time, then id.
    """
    kind, id_kind = events.schema[key].dataType.simpleString(), events.schema[id].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        rows = []
        for t, i in sorted(x for pdf in batches for x in zip(pdf["_t"], pdf["_id"], strict=True)):
            passed = [p for p in passed if p > t - seconds]
            ok = len(passed) < most
            if ok:
                passed.append(t)
            rows.append((k[0], i, t, ok))
        state.update((passed,))
        state.setTimeoutTimestamp(max(1000 * (max(passed, default=0) + seconds), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, id, "t", "passa"])

    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    asked = timed.select(F.col(key), F.col(id).alias("_id"), F.unix_seconds("_ts").alias("_t"), "_ts")
    return asked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {id} {id_kind}, t long, passa boolean", "passed array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merging(path: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into the table of versions under ``path``; a batch that comes again changes nothing.

    Each version is written beside the last and named by its batch, so a failed write leaves the last version whole.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = versions(spark, path)
        if done and done[-1] >= number:
            return
        batch = batch.dropDuplicates(key)
        new = merge(spark.read.parquet(f"{path}/v={done[-1]}"), batch) if done else batch
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return run


def versions(spark, path: str) -> list[int]:  # noqa: ANN001
    """Numbers of the whole versions under a path, ascending."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath() for x in fs.listStatus(at)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
