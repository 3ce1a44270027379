"""New batches against everything accepted before, without reprocessing it.

An accepted record leaves its page key, its content and its word segments in three tables of a folder (``Registry``), which
any later session can open. A batch looks its own pages, contents and runs of words up there: what is asked is the batch's,
broadcast where its counted rows allow it, so the tables of the history are scanned for a few columns but neither shuffled
nor read as text, but for the texts of candidates; what is new is appended. Within a batch (``resolve``) records are taken
in order: a record is a duplicate where an accepted one before it has the same page or a near content.

Defined results: a record without url has no page; one without title and excerpt has no content; two records that both lack
the excerpt must agree in the whole title; ties are settled by the order given; columns of other names are ignored; empty
batches give empty results; a batch of a name that was appended before replaces what it left then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.llm import segments
from lastro.session import dropped, written

#: Query parameters that do not select a page.
TRACKING = r"(?i)^(?:utm_\w+|fbclid|gclid|dclid|gbraid|wbraid|msclkid|mc_[ce]id|igshid|yclid|twclid|ref|ref_src|origem|source|cmpid|ocid|xtor|amp|outputtype|_ga|spm|share|si)(?:=|$)"


def page_key(url: Column) -> Column:
    """What of an address selects the page: host without www, m or amp, path without its ending, parameters in order without tracking."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(u, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(?:80|443)$|\.$", "")
    host = F.regexp_replace(host, r"^(?:(?:www\d?|m|mobile|amp)\.)+", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/{2,}", "/")
    path = F.regexp_replace(path, r"(?i)(?:/amp)?/*$", "")
    path = F.regexp_replace(path, r"(?i)(?:/(?:index|default)\.[a-z]{2,5}|(?:\.amp)?\.(?:[gsx]?html?|php|aspx?|jsp))?$", "")
    path = F.regexp_replace(path, r"(?i)^/amp(?=/)|(?:/amp)?/*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.array_distinct(F.filter(F.split(query, "[&;]"), lambda x: (x != "") & ~x.rlike(TRACKING))))
    key = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", key)


def keyed(records: DataFrame, id: str, order: list[str], url: str, title: str, excerpt: str) -> DataFrame:
    """(id, pos, page, content, f, n, lone): page key and content of each record; ``lone`` marks those without an excerpt."""
    lone = F.length(F.trim(F.coalesce(F.col(excerpt), F.lit("")))) == 0
    text = F.concat_ws(" ", F.col(title), F.col(excerpt))
    base = records.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.struct(*[F.col(c) for c in order]).alias("pos"), page_key(F.col(url)).alias("_page"), lone.alias("lone"), segments.fold(text).alias("_f"))
    filled = F.length("_f") > 0
    # Without excerpts titles must agree fully, with one they need not: the mark keeps such contents apart.
    return base.select("id", "pos", F.when(F.col("_page").isNotNull(), F.xxhash64("_page")).alias("page"), F.when(filled, F.xxhash64("_f", "lone")).alias("content"), F.when(filled, F.col("_f")).alias("f"), F.when(filled, segments.n_words(F.col("_f"))).alias("n"), "lone")


def texts_of(records: DataFrame) -> DataFrame:
    """One row (content, f, n, lone) per content of ``keyed`` records."""
    return records.where(F.col("f").isNotNull()).groupBy("content").agg(F.min("f").alias("f"), F.min("n").alias("n"), F.max("lone").alias("lone"))


def _not_lone(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Near pairs (a, b) but for those of two contents without an excerpt; ``pairs`` is small beside the texts."""
    la, lb = (t.where("lone").select(F.col("content").alias(c), F.lit(True).alias(f"l{c}")) for t, c in ((a, "a"), (b, "b")))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where("la IS NULL OR lb IS NULL").select("a", "b")


def content_links(records: DataFrame) -> DataFrame:
    """Links (a, b) both ways between different near contents of ``keyed`` records."""
    texts = written(texts_of(records))
    near = _not_lone(segments.near_pairs(texts, texts), texts, texts)
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    return written(near.select(both).select("x.a", "x.b").distinct())


def resolve(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, duplicate_of) of ``keyed`` records (a written table): null for accepted records, else the first accepted one that the record repeats.

    Records of the same page and content are one node, at its first position. Nodes that share neither page nor content nor a
    link with any other are accepted at once and take no further part. Of the others a node is rejected once an accepted node
    before it shares its page or a near content, and accepted once no unsettled node before it does. Each round works on
    minima per page and per content, so neither hot pages nor large families of copies are paired up.
    """
    rows = records.select("id", "pos", "page", "content")
    node = rows.groupBy("page", "content").agg(F.min(F.struct("pos", "id")).alias("me"), F.count("*").alias("n"))
    node = written(node)
    shared_page = node.where(F.col("page").isNotNull()).groupBy("page").agg(F.count("*").alias("_n")).where("_n > 1").select("page", F.lit(True).alias("by_page"))
    linked = links.select(F.col("a").alias("content"))
    linked = node.where(F.col("content").isNotNull()).groupBy("content").agg(F.count("*").alias("_n")).where("_n > 1").select("content").unionByName(linked).distinct().select("content", F.lit(True).alias("by_content"))
    marked = node.join(shared_page, "page", "left").join(linked, "content", "left")
    contested = marked.where("by_page OR by_content").select("page", "content", "me")
    family = written(links.unionByName(contested.where(F.col("content").isNotNull()).select(F.col("content").alias("a"), F.col("content").alias("b")).distinct()))
    kind = node.schema["me"].dataType
    state = written(contested.withColumn("state", F.lit(0)).withColumn("of", F.lit(None).cast(kind)))  # 0 open, 1 accepted, 2 rejected
    while not state.where("state = 0").isEmpty():
        me = F.col("me")
        by_page = state.where(F.col("page").isNotNull()).groupBy("page").agg(F.min(F.when(F.col("state") == 1, me)).alias("acc_p"), F.min(F.when(F.col("state") == 0, me)).alias("open_p"))
        by_content = state.where(F.col("content").isNotNull()).groupBy("content").agg(F.min(F.when(F.col("state") == 1, me)).alias("acc"), F.min(F.when(F.col("state") == 0, me)).alias("open"))
        around = family.join(by_content, family["b"] == by_content["content"]).groupBy("a").agg(F.min("acc").alias("acc_c"), F.min("open").alias("open_c")).withColumnRenamed("a", "content")
        seen = state.join(by_page, "page", "left").join(around, "content", "left")
        acc, first_open = F.least("acc_p", "acc_c"), F.least("open_p", "open_c")
        settled = F.when(F.col("state") != 0, F.col("state")).when(acc < me, 2).when(first_open.isNull() | (first_open >= me), 1).otherwise(0)
        before = F.when(F.col("state") == 0, F.when(acc < me, acc)).otherwise(F.col("of"))
        old, state = state, written(seen.select("page", "content", "me", settled.alias("state"), before.alias("of")))
        dropped(old)
    # Rows that are not their node's first repeat it, or what it repeats; single rows of accepted nodes need no join.
    same = lambda a, b: F.col(f"{a}page").eqNullSafe(F.col(f"{b}page")) & F.col(f"{a}content").eqNullSafe(F.col(f"{b}content"))
    rejected = state.where("state = 2").select(F.col("page").alias("r_page"), F.col("content").alias("r_content"), "of")
    nodes = node.select(F.col("page").alias("n_page"), F.col("content").alias("n_content"), "me", "n").join(rejected, same("n_", "r_"), "left").where("n > 1 OR of IS NOT NULL").select("n_page", "n_content", "me", "of")
    joined = rows.join(nodes, same("n_", ""), "left")
    alone = F.col("page").isNull() & F.col("content").isNull()
    duplicate_of = F.when(alone | F.col("me").isNull(), None).when(F.col("of").isNotNull(), F.col("of.id")).when(F.col("id") != F.col("me.id"), F.col("me.id"))
    return joined.select("id", duplicate_of.alias("duplicate_of"))


class Registry:
    """Accepted records as parquet tables under ``path``: pages, contents and segments, each batch in a folder of its own.

    pages (page, first), contents (content, f, n, lone, first) and segments as ``segments.index`` gives them; first is the
    position and id of the first accepted record. Nothing lives outside the folder, so a registry can be opened again by any
    session; an append that is tried again replaces its batch.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(hadoop)) if fs.exists(hadoop) else []

    def read(self, name: str) -> DataFrame | None:
        """One of the tables over all batches appended in full; None before the first."""
        paths = [f"{self.path}/{name}/{b}" for b in self._batches()]
        return self.spark.read.schema(self._schema(paths[0])).parquet(*paths) if paths else None

    def _schema(self, path: str):  # noqa: ANN202
        return self.spark.read.parquet(path).schema

    def append(self, accepted: DataFrame, batch: str) -> None:
        """Add ``keyed`` records; their segments are chosen by rarity among themselves, which any choice of segments may be."""
        new = written(accepted)
        first = F.min(F.struct("pos", "id")).alias("first")
        texts = new.where(F.col("f").isNotNull()).groupBy("content").agg(F.min("f").alias("f"), F.min("n").alias("n"), F.max("lone").alias("lone"), first)
        texts.write.mode("overwrite").parquet(f"{self.path}/contents/{batch}")
        texts = self.spark.read.parquet(f"{self.path}/contents/{batch}")
        segments.index(texts).write.mode("overwrite").parquet(f"{self.path}/segments/{batch}")
        new.where(F.col("page").isNotNull()).groupBy("page").agg(first).write.mode("overwrite").parquet(f"{self.path}/pages/{batch}")
        # The mark comes last: a batch without it was not appended.
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/{batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()

    def check(self, batch: DataFrame) -> DataFrame:
        """(id, duplicate_of) of a ``keyed`` batch (a written table or a part of one): against the registry first, then the rest among themselves."""
        known = self.read("contents")
        if known is None:
            return resolve(batch, content_links(batch))
        texts = written(texts_of(batch))
        stored = self.read("segments")
        pairs = written(segments.candidates(stored, segments.probes(texts), stored.count(), segments.n_probes(texts)))
        near = _not_lone(segments.verified(pairs, known, texts), known, texts)
        n = batch.count()
        asked = lambda c: F.broadcast(batch.select(c).distinct()) if n <= segments.BROADCAST_ROWS else batch.select(c).distinct()
        firsts = lambda df, c: df.groupBy(c).agg(F.min("first").alias("of"))
        # The history is scanned for keys only; what matches is no larger than the batch.
        near_first = known.select("content", "first").join(near.select(F.col("a").alias("content"), "b"), "content").select(F.col("b").alias("content"), "first")
        same = known.select("content", "first").join(asked("content"), "content")
        by_content = firsts(near_first.unionByName(same), "content").withColumnRenamed("of", "of_c")
        by_page = firsts(self.read("pages").join(asked("page"), "page"), "page").withColumnRenamed("of", "of_p")
        seen = written(batch.join(by_content, "content", "left").join(by_page, "page", "left").withColumn("of", F.least("of_c", "of_p")).drop("of_c", "of_p"))
        fresh = seen.where(F.col("of").isNull()).drop("of")
        inside = resolve(fresh, content_links(fresh))
        return seen.where(F.col("of").isNotNull()).select("id", F.col("of.id").alias("duplicate_of")).unionByName(inside)


def fold_batches(registry: Registry, records: DataFrame, batch: str, least_rows: int = 100_000) -> DataFrame:
    """(id, duplicate_of) of ``keyed`` records (a written table) whose batches, numbered in ``pos.<batch>``, go through the registry one after the other.

    The first batch is the history. Later ones that follow each other and are small are checked together until they hold
    ``least_rows``: within one check records are taken in order as well, so the result is the same for every grouping, and a
    step's fixed cost is spread. One number per batch comes to the driver.
    """
    of = F.col(f"pos.{batch}")
    sizes = [(r[0], r[1]) for r in records.groupBy(of.alias("b")).agg(F.count("*").alias("n")).orderBy(F.col("b").asc_nulls_first()).collect()]
    steps: list[list] = [[b] for b, _ in sizes[:1]]
    rows = least_rows
    for b, n in sizes[1:]:
        if rows >= least_rows:
            steps.append([])
            rows = 0
        steps[-1].append(b)
        rows += n
    out = None
    for k, step in enumerate(steps):
        part = records.where(of.isin([b for b in step if b is not None]) | (of.isNull() if None in step else F.lit(False)))
        done = written(registry.check(part))
        out = done if out is None else out.unionByName(done)
        if k + 1 < len(steps):
            registry.append(part.join(done.where(F.col("duplicate_of").isNull()).select("id"), "id", "left_semi"), f"b{k:06d}")
    return out if out is not None else records.select("id", F.col("id").alias("duplicate_of")).limit(0)
