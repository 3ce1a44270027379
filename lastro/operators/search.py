"""Registry search by BM25 over boosted fields, with relative thresholds.

The index is a table of blocks of documents, each with its postings sorted by token. Blocks meet blocks of queries, and a task
adds up a query's scores over one block at a time, in arrays of one number per document: pairs of query and document are never
rows, and what leaves a task is the best documents, or counts, per query. Every pair is scored in full; nothing is left out by
the size of a registry, of a set of queries or of a token's list. Sums run in a fixed order, so that scores are the same for
any partitioning.

Queries without tokens find nothing; ties go to the smaller document id; repeated query tokens count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.session import written

K1, B = 1.5, 0.75
# Documents of a block, so that an array of scores stays in the cache; queries of a block; queries up to which their blocks are broadcast.
DOCS, QUERIES, FEW = 1 << 15, 1 << 13, 1 << 20
# Marks of a posting: claim or title hold the token; those or the excerpt's first sentence do; the same of numbers.
CORE, WIDE, CORE_NUMBER, WIDE_NUMBER = 1, 2, 4, 8

_INDEX = "docs binary, len binary, vocabulary array<string>, df array<int>, ends binary, at binary, tf binary, marks binary, n long, total long"


def _narrow(values: np.ndarray) -> bytes:
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _block(rows: pa.Table, fields: list[tuple[int, int]]) -> pa.RecordBatch:
    """One row of the index: documents by id, postings by token and document."""
    docs = rows["doc"].to_numpy()
    order, n = np.argsort(docs), len(docs)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tokens, at, weight, marks = [], [], [], []
    for i, (w, m) in enumerate(fields):
        split = pc.split_pattern(rows[f"f{i}"].combine_chunks(), " ")
        flat, parent = split.flatten(), pc.list_parent_indices(split)
        held = pc.not_equal(flat, "")
        tokens.append(flat.filter(held))
        at.append(place[parent.filter(held).to_numpy()])
        weight.append(np.full(len(at[-1]), w))
        marks.append(np.full(len(at[-1]), m, np.uint8))
    coded = pa.chunked_array(tokens, pa.string()).combine_chunks().dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * n + np.concatenate(at)
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.empty(0, np.int64)
    tf = np.add.reduceat(np.concatenate(weight)[by], first) if len(key) else np.empty(0, np.int64)
    mark = np.bitwise_or.reduceat(np.concatenate(marks)[by], first) if len(key) else np.empty(0, np.uint8)
    token, at = np.divmod(key[first], n)
    size, words = np.bincount(at, tf, n).astype(np.int64), len(coded.dictionary)
    row = {
        "docs": docs[order].tobytes(), "len": _narrow(size), "vocabulary": coded.dictionary.to_pylist(), "df": np.bincount(token[tf > 0], minlength=words).tolist(), "ends": np.cumsum(np.bincount(token, minlength=words)).tobytes(),
        "at": _narrow(at), "tf": _narrow(tf), "marks": mark.tobytes(), "n": int((size > 0).sum()), "total": int(size.sum()),
    }
    return pa.RecordBatch.from_pylist([row], pa.schema([("docs", pa.binary()), ("len", pa.binary()), ("vocabulary", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("ends", pa.binary()), ("at", pa.binary()), ("tf", pa.binary()), ("marks", pa.binary()), ("n", pa.int64()), ("total", pa.int64())]))


def index(docs: DataFrame, id: str, fields: list[tuple[Column, int, int]], block: int = DOCS) -> DataFrame:
    """Blocks of documents with the counts of their tokens, each field's times its boost, and the marks of all fields that hold them.

    Fields are (array of tokens, boost, marks); tokens hold no space. Rows of one id are one document, rows without an id none.
    """
    rows = docs.where(F.col(id).isNotNull()).repartition(id).select(F.col(id).cast("long").alias("doc"), *[F.array_join(c, " ").alias(f"f{i}") for i, (c, _, _) in enumerate(fields)])
    rows = rows.groupBy("doc").agg(*[F.array_join(F.collect_list(f"f{i}"), " ").alias(f"f{i}") for i in range(len(fields))])
    kinds = [(w, m) for _, w, m in fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= block:
                t = pa.Table.from_batches(held)
                yield _block(t.slice(0, block), kinds)
                held, n = t.slice(block).to_batches(), n - block
        if n:
            yield _block(pa.Table.from_batches(held), kinds)

    return written(rows.mapInArrow(pack, _INDEX))


def _totals(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df), and one row (n, avg): documents with tokens, their mean length."""
    df = index.select(F.inline(F.arrays_zip(F.col("vocabulary").alias("token"), F.col("df").alias("c")))).groupBy("token").agg(F.sum("c").alias("df")).where("df > 0")
    return df, index.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg"))


def _okapi() -> Column:
    return F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _pairs(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Each block of the index beside each block of queries; asked is a written table with a row per query."""
    count = asked.count()
    blocks = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(max(1, -(-count // QUERIES)))).alias("_b")).agg(F.collect_list(F.struct(*asked.columns)).alias("asked")).drop("_b")
    return index.crossJoin(F.broadcast(blocks) if count <= FEW else written(blocks)).drop("df", "n", "total")


def number_tokens(numbers: Column) -> Column:
    """Numbers as tokens that no text has."""
    return F.transform(numbers, lambda x: F.concat(F.lit("#"), x))


class _Pair:
    """One block of documents and one of queries, opened: local tokens of each query and what each posting adds to a score."""

    def __init__(self, batch: pa.RecordBatch, i: int, plus: float):
        of = lambda c: batch.column(c)[i].as_py()
        self.docs = np.frombuffer(of("docs"), np.int64)
        self.size = len(self.docs)
        ends = np.frombuffer(of("ends"), np.int64)
        self.marks = np.frombuffer(of("marks"), np.uint8)
        at, tf = _wide(of("at"), len(self.marks)), _wide(of("tf"), len(self.marks))
        self.asked = batch.column("asked")[i].values
        terms = self.asked.field("terms")
        token, idf = terms.values.field("token"), terms.values.field("idf").to_numpy()
        local = pc.fill_null(pc.index_in(token, value_set=batch.column("vocabulary")[i].values), -1).to_numpy()
        self.idf = np.zeros(len(ends))
        self.idf[local[local >= 0]] = idf[local >= 0]
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        part = np.zeros(0)
        if len(at):
            avg = self.asked.field("avg")[0].as_py()
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * _wide(of("len"), self.size)[at] / avg)) + plus
            part *= np.repeat(self.idf, ends - starts)
        self.at, self.part, self.starts, self.ends = at, part, starts.tolist(), ends.tolist()
        self.query = self.asked.field("query").to_numpy()
        offsets, local = terms.offsets.to_numpy().tolist(), local.tolist()
        self.terms = [[t for t in local[a:b] if t >= 0] for a, b in zip(offsets, offsets[1:])]
        self.lists: dict[int, tuple] = {}
        self.acc = np.zeros(self.size)

    def cover(self, batch: pa.RecordBatch, i: int) -> None:
        """Opens what ``registry_search`` asks for besides scores."""
        self.n_q, self.every = self.asked.field("n_q").to_pylist(), self.asked.field("every").to_pylist()
        numbers = self.asked.field("numbers")
        local = pc.fill_null(pc.index_in(numbers.values, value_set=batch.column("vocabulary")[i].values), -1).to_pylist()
        offsets = numbers.offsets.to_pylist()
        self.n_numbers = [b - a for a, b in zip(offsets, offsets[1:])]
        self.numbers = [[t for t in local[a:b] if t >= 0] for a, b in zip(offsets, offsets[1:])]

    def add_weight(self, acc: np.ndarray, t: int) -> None:
        """A token's weight in all documents where a posting is marked as wide."""
        held = self.lists.get(t)
        if held is None:
            a, b = self.starts[t], self.ends[t]
            at = self.at[a:b][self.marks[a:b] & WIDE > 0]
            held = at, max(self.idf[t], 0.0)
            if len(at) * 14 > self.size:
                whole = np.zeros(self.size)
                whole[at] = held[1]
                held = None, whole
            self.lists[t] = held
        at, weight = held
        if at is None:
            acc += weight
        else:
            acc[at] += weight

    def add(self, acc: np.ndarray, t: int) -> None:
        """A token's share of all scores; the token of many documents as one array over all of them."""
        held = self.lists.get(t)
        if held is None:
            a, b = self.starts[t], self.ends[t]
            held = self.at[a:b], self.part[a:b]
            if (b - a) * 14 > self.size:
                whole = np.zeros(self.size)
                whole[held[0]] = held[1]
                held = None, whole
            self.lists[t] = held
        at, part = held
        if at is None:
            acc += part
        else:
            acc[at] += part

    def scores(self, j: int) -> np.ndarray:
        """The j-th query's scores of all documents of the block; the array is used again."""
        self.acc.fill(0.0)
        for t in self.terms[j]:
            self.add(self.acc, t)
        return self.acc

    def unseen(self, j: int) -> np.ndarray:
        """Documents that hold no token of the j-th query."""
        none = np.ones(self.size, bool)
        for t in self.terms[j]:
            none[self.at[self.starts[t] : self.ends[t]]] = False
        return none


def _rounded(x: np.ndarray, places: int = 4) -> np.ndarray:
    """Half away from zero, as in SQL."""
    return np.copysign(np.floor(np.abs(x) * 10**places + 0.5), x) / 10**places + 0.0


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rounded scores, ties to the earlier, and of all that may round to the last of them."""
    if len(score) <= k:
        return np.arange(len(score))
    high = score.max()
    least = 0.7 * high
    if high <= 0 or np.count_nonzero(score >= least) < k:
        least = np.partition(score, len(score) - k)[len(score) - k]
    return np.flatnonzero(score >= least - 1e-4)


def best(index: DataFrame, queries: DataFrame, k: int, plus: float | None = None) -> DataFrame:
    """(query, doc, score, rank) of queries (query, token): the best k documents that hold a token, by BM25 Okapi, or BM25+ with the given delta; scores count to four places, so that the order of a sum decides nothing."""
    df, total = _totals(index)
    idf = _okapi() if plus is None else F.log((F.col("n") + 1) / F.col("df"))
    asked = queries.select(F.col("query").cast("long").alias("query"), "token").distinct().join(df, "token").join(F.broadcast(total), F.lit(True))
    asked = written(asked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(idf.alias("idf"), "token")), asc=False).alias("terms"), F.first("avg").alias("avg")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per query its best of the task's blocks so far
        for batch in batches:
            for i in range(batch.num_rows):
                pair = _Pair(batch, i, plus or 0.0)
                for j, q in enumerate(pair.query.tolist()):
                    if not pair.terms[j]:
                        continue
                    score = pair.scores(j)
                    low = min(pair.idf[t] for t in pair.terms[j]) <= 0 and plus is None
                    if low:
                        score[pair.unseen(j)] = -np.inf
                    old = kept.get(q)
                    if old is not None and len(old[0]) == k:
                        least = old[0][-1]
                        if score.max() < least - 1e-4:
                            continue
                        at = np.flatnonzero(score >= least - 1e-4)
                    else:
                        at = _top(score, k)
                    at = at[score[at] > (-np.inf if low else 0.0)]
                    s, d = _rounded(score[at]), pair.docs[at]
                    if old is not None:
                        s, d = np.concatenate((old[0], s)), np.concatenate((old[1], d))
                    by = np.lexsort((d, -s))[:k]
                    kept[q] = s[by], d[by]
        if kept:
            size = [len(s) for s, _ in kept.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.fromiter(kept, np.int64), size)), pa.array(np.concatenate([d for _, d in kept.values()])), pa.array(np.concatenate([s for s, _ in kept.values()]))], ["query", "doc", "score"])

    out = _pairs(index, asked).mapInArrow(found, "query long, doc long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _passing(pair: _Pair, j: int, terms: int, core: float, wide: float, k: int) -> tuple[np.ndarray, ...] | None:
    """The j-th query's k best documents that pass a path: (doc, score, share, terms)."""
    local, every, n_q = pair.terms[j], pair.every[j], pair.n_q[j]
    if every <= 0:
        return None
    pair.acc.fill(0.0)
    for t in local:  # weight that claim, title and first sentence hold; the rest can't pass
        pair.add_weight(pair.acc, t)
    at = np.flatnonzero(pair.acc >= min(core, wide) * every * (1 - 1e-6) - 1e-6)
    if not len(at):
        return None
    score, has, weight, number = np.zeros(len(at)), {CORE: np.zeros(len(at), np.int64), WIDE: np.zeros(len(at), np.int64)}, {CORE: np.zeros(len(at)), WIDE: np.zeros(len(at))}, np.zeros(len(at), np.uint8)

    def held(t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = pair.starts[t], pair.ends[t]
        p = np.searchsorted(pair.at[a:b], at)
        i = np.flatnonzero((p < b - a) & (pair.at[a:b].take(p, mode="clip") == at)) if b > a else np.empty(0, np.int64)
        return i, a + p[i]

    for t in local:  # in the order of scores()
        i, p = held(t)
        score[i] += pair.part[p]
        for m in (CORE, WIDE):
            on = i[pair.marks[p] & m > 0]
            has[m][on] += 1
            weight[m][on] += max(pair.idf[t], 0.0)
    for t in pair.numbers[j]:
        i, p = held(t)
        number[i] |= pair.marks[p]
    share = {m: _rounded(weight[m] / every, 6) for m in (CORE, WIDE)}
    free = pair.n_numbers[j] == 0
    path = lambda m, least, n: (has[m] >= min(terms, n_q)) & (share[m] >= least) & (free | (number & n > 0))
    by_wide = path(WIDE, wide, WIDE_NUMBER)
    score = _rounded(score)
    ok = np.flatnonzero((by_wide | path(CORE, core, CORE_NUMBER)) & (score > 0))
    ok = ok[np.lexsort((at[ok], -score[ok]))[:k]]
    pick = lambda x: np.where(by_wide[ok], x[WIDE][ok], x[CORE][ok])
    return pair.docs[at[ok]], score[ok], pick(share), pick(has)


def _counted(index: DataFrame, asked: DataFrame, edges: bool) -> DataFrame:
    """(query, half, below, found, best) of asked queries with halves: how many documents have a score, up to a half, and the best of all; with edges also (low, high), the scores next to each half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair, rows = _Pair(batch, i, 0.0), []
                for j, (q, halves) in enumerate(zip(pair.query.tolist(), pair.asked.field("halves").to_pylist())):
                    score = pair.scores(j)
                    found, most = int(np.count_nonzero(score >= 0.5e-4)), float(_rounded(score.max(keepdims=True))[0])
                    if not found:
                        continue
                    for h in halves:
                        limit = (h + 0.5) / 1e4  # what rounds to more than the half
                        below = int(np.count_nonzero(score < limit)) - (pair.size - found)
                        low = high = None
                        if edges:
                            low = float(_rounded(np.max(score, where=score < limit, initial=0.0, keepdims=True))[0])
                            high = float(_rounded(np.min(score, where=score >= limit, initial=1e9, keepdims=True))[0])
                        rows.append((q, h, below, found, most, low, high))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["query", "half", "below", "found", "best", "low", "high"])

    out = _pairs(index, asked).mapInArrow(count, "query long, half long, below long, found long, best double, low double, high double")
    out = out.groupBy("query", "half").agg(F.sum("below").alias("below"), F.sum("found").alias("found"), F.max("best").alias("best"), F.max("low").alias("low"), F.min("high").alias("high"))
    return out if edges else out.drop("low", "high")


def registry_search(index: DataFrame, queries: DataFrame, query_numbers: DataFrame, k: int = 5, least_terms: int = 3, core: float = 0.6, wide: float = 0.8, least: float = 4.0, epsilon: float = 0.25) -> DataFrame:
    """(query, doc, score, score_rel, n_terms): the best k per query that pass the relative cut and one of two paths.

    The cut wants a score of at least ``least``, twice the median of all scores but the best, and half the best; scores count to
    four places. A path wants ``least_terms`` distinct terms (all, if the query has fewer), its share of the query's weight, and
    one number of the query, if it has any that is no year. The first path looks at claim and title, the second at the excerpt's
    first sentence as well. A token in more than half of all documents weighs ``epsilon`` of the mean; weights below nothing
    cover nothing. The index marks postings as CORE and WIDE, and holds numbers as ``number_tokens`` without a boost.

    As the cut only falls with the score, the k best that pass a path are found first; then all scores of the queries that have
    any are counted up to half of theirs, which tells on which side of it the median lies. The median itself is looked up only
    where it lies between two scores on either side of that half.
    """
    df, total = _totals(index)
    df = written(df.join(F.broadcast(total), F.lit(True)).withColumn("idf", _okapi()))
    mean = df.agg((epsilon * F.avg("idf")).alias("mean"))  # one row
    distinct = queries.select(F.col("query").cast("long").alias("query"), "token").distinct()
    known = distinct.join(df.join(F.broadcast(mean), F.lit(True)).select("token", "avg", F.when(F.col("idf") < 0, F.col("mean")).otherwise(F.col("idf")).alias("idf")), "token", "left")
    terms = known.groupBy("query").agg(F.count("*").alias("n_q"), F.sum(F.greatest("idf", F.lit(0.0))).alias("every"), F.sort_array(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("idf", "token"))), asc=False).alias("terms"), F.max("avg").alias("avg")).where("size(terms) > 0")
    asked_numbers = F.filter(F.coalesce("numbers", F.array().cast("array<string>")), lambda x: ~((F.length(x) <= 9) & x.cast("int").between(1900, 2100)))
    numbers = query_numbers.select(F.col("query").cast("long").alias("query"), number_tokens(asked_numbers).alias("numbers"))
    asked = written(terms.join(numbers, "query", "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<string>"))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair, rows = _Pair(batch, i, 0.0), []
                pair.cover(batch, i)
                for j, q in enumerate(pair.query):
                    if pair.terms[j] and (got := _passing(pair, j, least_terms, core, wide, k)) is not None:
                        rows.append((np.full(len(got[0]), q), *got))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["query", "doc", "score", "score_rel", "n_terms"])

    near = _pairs(index, asked).mapInArrow(found, "query long, doc long, score double, score_rel double, n_terms long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    near = near.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= k) & (F.col("score") >= least)).drop("_r").withColumn("units", F.round(F.col("score") * 10000).cast("long"))
    near = written(near.withColumn("half", F.expr("units div 2")))
    scored = asked.select("query", "terms", "avg").join(near.groupBy("query").agg(F.collect_set("half").alias("halves")), "query")
    sides = written(_counted(index, written(scored), False).withColumn("others", F.col("found") - 1))
    between = sides.where("others > 0 AND others = 2 * below")
    edges = _counted(index, written(scored.drop("halves").join(between.groupBy("query").agg(F.collect_set("half").alias("halves")), "query")), True)
    edges = edges.select("query", "half", F.round((F.col("low") + F.col("high")) * 10000).cast("long").alias("middle"))
    near = near.join(sides, ["query", "half"]).join(edges, ["query", "half"], "left")
    below = F.when(F.col("others") == 0, True).when(F.col("others") == 2 * F.col("below"), F.col("middle") <= F.col("units")).otherwise(2 * F.col("below") > F.col("others"))
    return near.where(below & (F.col("score") >= F.round(0.5 * F.col("best"), 4))).select("query", "doc", "score", "score_rel", "n_terms")
