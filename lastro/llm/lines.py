"""Lines repeated across one source's documents, from line-count tables that grow by deltas.

State is one row per (source, line key, url hash) with the number of the delta that brought it; merging a delta is one
grouping of state and delta together, so a line that a url already had is not counted twice. Out of it come the per-source
line counts before and after the delta, the lines that crossed the threshold, and the documents to rebuild.

Defined results: null texts, null urls and null sources have no lines; a line without letters has no key; repeated rows of
one url count once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions.text import letters_key

#: Rows of a crossed-lines table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def exploded(docs: DataFrame, doc_id: str, source: str, url: str, text: str) -> DataFrame:
    """One row per line with letters: doc_id, source, url hash, line number, hash of its letters."""
    keys = F.transform(F.split(F.col(text), "\n"), lambda x: letters_key(x))
    rows = docs.where(F.col(text).isNotNull() & F.col(source).isNotNull() & F.col(url).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(url).alias("u"), F.posexplode(keys).alias("linha_no", "letters"))
    return rows.where(F.col("letters") != "").select("doc_id", "source", "u", "linha_no", F.xxhash64("letters").alias("k"))


def pairs(docs: DataFrame, doc_id: str, source: str, url: str, text: str, delta: Column) -> DataFrame:
    """The state's rows of some documents: each line key of each url once, with the delta it came by.

    A row with a null key stands for the url itself, so that the number of urls with text needs no pass of its own.
    """
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: F.when(letters_key(x) != "", F.xxhash64(letters_key(x)))))
    keys = F.array_union(F.filter(keys, lambda x: x.isNotNull()), F.array(F.lit(None).cast("long")))
    good = docs.where((F.length(F.col(text)) > 0) & F.col(source).isNotNull() & F.col(url).isNotNull())
    return good.select(F.col(source).alias("source"), F.explode(keys).alias("k"), F.xxhash64(url).alias("u"), delta.alias("delta"))


def merge(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """State after a delta: each (source, key, url) once, with the first delta that brought it."""
    both = delta if state is None else state.unionByName(delta)
    return both.groupBy("source", "k", "u").agg(F.min("delta").alias("delta"))


def counts(state: DataFrame, now: int) -> DataFrame:
    """Per source and line key the urls before and after delta ``now``, beside the source's urls before and after."""
    each = state.groupBy("source", "k").agg(F.sum(F.when(F.col("delta") < now, 1).otherwise(0)).alias("before"), F.count("*").alias("after"))
    urls = each.where(F.col("k").isNull()).select("source", F.col("before").alias("urls_before"), F.col("after").alias("urls"))
    return each.where(F.col("k").isNotNull()).join(urls, "source")


def over(n: Column, urls: Column, least: int, share: int) -> Column:
    """Whether a line in n of a source's urls is repeated excessively: in ``least`` urls and one in ``share`` of all."""
    return (n >= least) & (n * share >= urls)


def crossed(counted: DataFrame, least: int = 4, share: int = 20) -> DataFrame:
    """Lines over the threshold now, with ``newly`` for those that were not before the delta."""
    was = over(F.col("before"), F.col("urls_before"), least, share)
    return counted.where(over(F.col("after"), F.col("urls"), least, share)).select("source", "k", F.col("after").alias("n_urls"), "urls", (~was).alias("newly"))


class State:
    """Line counts under ``path``, grown by deltas: which (source, line, url) each delta brought first, and the counts after it.

    A delta is compared with what its own urls had before, so that a page read again counts once; then counts are added up.
    Nothing lives outside the folder; a delta that is tried again under its name replaces what it left then. Names must sort
    in the order of the deltas.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def append(self, rows: DataFrame, name: str) -> DataFrame:
        """Merge ``pairs`` of a delta; the lines over the threshold after it, with ``newly`` (see ``crossed``)."""
        earlier = [x for x in self._names() if x < name]
        delta = rows.select("source", "k", "u").distinct()
        if earlier:
            known = self.spark.read.parquet(*[f"{self.path}/pairs/{x}" for x in earlier]).alias("o")
            again = known.join(delta.select("source", "u").distinct(), ["source", "u"], "left_semi").alias("o")
            same = (F.col("d.source") == F.col("o.source")) & (F.col("d.u") == F.col("o.u")) & F.col("d.k").eqNullSafe(F.col("o.k"))
            delta = delta.alias("d").join(again, same, "left_anti")
        delta.write.mode("overwrite").parquet(f"{self.path}/pairs/{name}")
        new = self.spark.read.parquet(f"{self.path}/pairs/{name}").groupBy("source", "k").agg(F.count("*").alias("n")).withColumn("old", F.lit(0).cast("long"))
        if earlier:
            new = new.unionByName(self.spark.read.parquet(f"{self.path}/counts/{earlier[-1]}").select("source", "k", F.lit(0).cast("long").alias("n"), F.col("after").alias("old")))
        new.groupBy("source", "k").agg(F.sum("old").alias("before"), (F.sum("old") + F.sum("n")).alias("after")).write.mode("overwrite").parquet(f"{self.path}/counts/{name}")
        each = self.spark.read.parquet(f"{self.path}/counts/{name}")
        urls = each.where(F.col("k").isNull()).select("source", F.col("before").alias("urls_before"), F.col("after").alias("urls"))
        return crossed(each.where(F.col("k").isNotNull()).join(urls, "source"))


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table), marked for broadcast only where its rows were counted and found few."""
    return F.broadcast(df) if df.count() <= rows else df


def found(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """The places (doc_id, linha_no, newly) of repeated lines."""
    return lines.join(repeated.select("source", "k", "newly"), ["source", "k"]).select("doc_id", "linha_no", "newly", "source", "k")


def rebuilt(docs: DataFrame, doc_id: str, text: str, places: DataFrame, every: bool = False) -> DataFrame:
    """The documents that hold repeated lines, each with its text without them; ``every`` adds all others with text as they are, 0 lines removed."""
    drop = places.groupBy("doc_id").agg(F.collect_set("linha_no").alias("drop"))
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("drop"), i))
    asked = docs.where(F.length(F.col(text)) > 0) if every else docs
    out = asked.select(F.col(doc_id).alias("doc_id"), F.col(text)).join(drop, "doc_id", "left" if every else "inner")
    clean = F.when(F.col("drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.select("doc_id", clean.alias("texto_limpo"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("linhas_removidas"))
