"""File sources and sinks: JSON lines, CSV dimensions, parquet pairs, deterministic exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (also gzipped) with a fixed schema; lines that are no such object are left out, a missing path gives no rows."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_ranks(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(dominio, posicao) of a rank file, lower case, down to position ``most``."""
    t = spark.read.schema("posicao int, dominio string").csv(path)
    return t.where(F.col("posicao") <= most).select(F.lower(F.trim("dominio")).alias("dominio"), "posicao")


def read_pool(spark: SparkSession, pool: str, splits: str | None, id: str = "rid") -> DataFrame:
    """A pool of records with their split columns where there are any."""
    p = spark.read.parquet(pool)
    return p if splits is None else p.join(spark.read.parquet(splits).dropDuplicates([id]), id, "left")


def write_jsonl(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """JSON lines in a fixed order of rows and columns, range-split into ``files`` files; the commit protocol makes it all or nothing."""
    df.select(*sorted(df.columns)).repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").json(path)


def cassette_key(method: str, url: str, body: str) -> F.Column:
    """Content address of a request: SHA-256 of method, address with its parameters in order and secrets dropped, and body."""
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:api_?key|token|key|secret)="))), "&")
    return F.sha2(F.concat_ws("\n", F.upper(F.col(method)), F.regexp_replace(F.col(url), r"[?#].*$", ""), query, F.coalesce(F.col(body), F.lit(""))), 256)
