"""Texts within a bounded number of word edits of each other, by an index of word segments.

Two texts are near where they differ by at most one word in ten (inserted, dropped or replaced; of the longer text). A text
of n words stores a fixed number of disjoint five-word segments, one more than the edits that any partner may need, so at
least one of them stands unharmed in every near text, at a position shifted by no more edits than allowed. Of all segments
on a text's grid the rarest are stored, which keeps phrases that many texts share out of the index. The key of a segment is
a hash of its words, of the band of lengths (powers of two) that its text lies in, and of the slot of positions that it
stands in; a text looks up its own runs of words under the bands and slots that its partners may have, no others.

What shares a key is a candidate if lengths, positions and signatures agree: a signature is the parity of the words on 128
bits, and an edit turns two of them at most. Only hashes and numbers have moved up to here. Of the candidates that are left
the containment must be what the allowed edits leave at least, and then the exact distance decides.

Texts below nine words have near texts only among their equals. Nulls and texts without words are near to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.text import coded, fold, words
from lastro.session import written

#: One word in so many may differ.
SHARE = 10
SEGMENT = 5
#: A segment found in more texts than this counts as frequent when the rarest are chosen.
FREQUENT = 4
#: Rows of stored segments, or of runs looked up, up to which they are broadcast (about 60 bytes each).
BROADCAST_ROWS = 1_000_000


def allowed(n: Column) -> Column:
    """Edits that a text of n words, the longer of two, may be away."""
    return F.floor(n / SHARE).cast("int")


def most_allowed(n: Column) -> Column:
    """Edits that any near text of a text of n words may need: the longest one has n / 0.9 words."""
    return F.floor(n / (SHARE - 1)).cast("int")


def contents(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the folded text (f), its hash (content) and number of words (n); rows without words are left out."""
    folded = df.withColumn("f", fold(text)).where(F.length("f") > 0)
    return folded.withColumn("n", n_words(F.col("f"))).withColumn("content", F.xxhash64("f"))


def n_words(folded: Column) -> Column:
    return F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit(""))) + 1


def _hashed(texts: DataFrame, runs: Callable[[Column], Column]) -> DataFrame:
    """content, n, the signature (s1, s2) and ``runs`` (g) of the hashed words of texts of nine words and more.

    The hashes are bound in a lambda, once per text: as a column they would be made anew at every use.
    """
    parity = lambda hs, bit: F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.when(h.bitwiseAND(F.lit(64)) == bit, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))))
    all_ = lambda hs: F.struct(parity(hs, 0).alias("s1"), parity(hs, 64).alias("s2"), runs(hs).alias("g"))
    bound = F.transform(F.array(F.transform(F.split("f", " "), lambda w: F.xxhash64(w))), all_)
    return texts.where("n >= 9").select("content", "n", F.inline(bound))


def _runs(hs: Column, size: int, step: int) -> Column:
    """Structs (h, p) of each run of ``size`` words, at every ``step``-th position."""
    at = F.when(F.size(hs) >= size, F.sequence(F.lit(0), F.greatest(F.size(hs) - size, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.struct(F.xxhash64(*[hs[p + i] for i in range(size)]).alias("h"), p.alias("p")))


def _band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _width(band: Column) -> Column:
    """Positions of one slot: four times the edits that the longest text of the band may need."""
    return 4 * most_allowed(F.pow(F.lit(2), band + 1) - 1) + 1


def _key(h: Column, band: Column, slot: Column) -> Column:
    return F.xxhash64(h, band, slot)


def index(texts: DataFrame) -> DataFrame:
    """Stored segments (band, key, p, n, content, s1, s2) of distinct texts (content, f, n): the rarest of each text's grid, one more than its edits.

    Frequencies are summed over all given texts before any choice; ties go to the earlier position.
    """
    grid = written(_hashed(texts, lambda hs: F.when(F.col("n") == 9, _runs(hs, 4, 4)).otherwise(_runs(hs, SEGMENT, SEGMENT))))
    frequent = grid.select(F.explode("g.h").alias("h")).groupBy("h").agg(F.count("*").alias("f")).where(F.col("f") > FREQUENT)
    weighed = grid.select("content", "n", "s1", "s2", F.inline("g")).join(frequent, "h", "left")
    ranked = weighed.groupBy("content").agg(F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "p", "h"))).alias("s"))
    kept = ranked.select("content", "n", "s1", "s2", F.inline(F.slice("s", F.lit(1), most_allowed(F.col("n")) + 1)))
    band = _band(F.col("n"))
    return kept.select(band.alias("band"), _key(F.col("h"), band, F.floor(F.col("p") / _width(band))).alias("key"), "p", "n", "content", "s1", "s2")


def probes(texts: DataFrame) -> DataFrame:
    """(key, p, n, content, s1, s2) of every five-word run (four-word for texts that may have a near text of nine words), under each band and slot where a partner may have stored it."""
    base = _hashed(texts, lambda hs: F.when(F.col("n") <= 10, F.concat(_runs(hs, SEGMENT, 1), _runs(hs, 4, 1))).otherwise(_runs(hs, SEGMENT, 1)))
    lowest, highest = _band(F.ceil(F.col("n") * (SHARE - 1) / SHARE)), _band(F.floor(F.col("n") * SHARE / (SHARE - 1)))
    each = base.select("content", "n", "s1", "s2", "g", F.explode(F.sequence(lowest, highest)).alias("band")).select("content", "n", "s1", "s2", "band", F.inline("g"))
    e, width = most_allowed(F.col("n")), _width(F.col("band"))
    first, last = F.floor(F.greatest(F.col("p") - e, F.lit(0)) / width), F.floor((F.col("p") + e) / width)
    slotted = each.withColumn("slot", F.explode(F.sequence(first, last)))
    return slotted.select(_key(F.col("h"), F.col("band"), F.col("slot")).alias("key"), "p", "n", "content", "s1", "s2")


def candidates(stored: DataFrame, asked: DataFrame, n_stored: int, n_asked: int) -> DataFrame:
    """Distinct pairs (a stored, b asked) that share a key and agree in length, position and signature; the smaller side is broadcast if its counted rows allow it, else both are shuffled."""
    s = stored.select("key", *[F.col(c).alias(f"a_{c}") for c in ("p", "n", "content", "s1", "s2")])
    q = asked.select("key", *[F.col(c).alias(f"b_{c}") for c in ("p", "n", "content", "s1", "s2")])
    if min(n_stored, n_asked) <= BROADCAST_ROWS:
        s, q = (F.broadcast(s), q) if n_stored <= n_asked else (s, F.broadcast(q))
    edits = allowed(F.greatest("a_n", "b_n"))
    turned = F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1"))) + F.bit_count(F.col("a_s2").bitwiseXOR(F.col("b_s2")))
    hit = s.join(q, "key").where((F.col("a_content") != F.col("b_content")) & (F.abs(F.col("a_n") - F.col("b_n")) <= edits) & (F.abs(F.col("a_p") - F.col("b_p")) <= edits) & (turned <= 2 * edits))
    return hit.select(F.col("a_content").alias("a"), F.col("b_content").alias("b")).distinct()


def _few(texts: DataFrame, contents_: DataFrame, n: int) -> DataFrame:
    """The texts of some contents: these are broadcast where they were counted and found few, so the texts are only scanned."""
    return texts.join(F.broadcast(contents_) if n <= BROADCAST_ROWS else contents_, "content", "left_semi")


def verified(pairs: DataFrame, stored_texts: DataFrame, asked_texts: DataFrame) -> DataFrame:
    """Of candidate pairs (a written table) those within the allowed edits, with the distance and the share of a's five-word runs that b holds.

    Each edit takes five distinct runs at most, so a containment below what the edits leave rules a pair out. Then the
    distance on hashed words decides; a second hash must agree, which leaves no practical chance of an accidental match.
    """
    n = pairs.count()
    a = _few(stored_texts.select("content", "f", "n"), pairs.select(F.col("a").alias("content")).distinct(), n).select(F.col("content").alias("a"), F.col("f").alias("fa"), F.col("n").alias("na"))
    b = _few(asked_texts.select("content", "f", "n"), pairs.select(F.col("b").alias("content")).distinct(), n).select(F.col("content").alias("b"), F.col("f").alias("fb"), F.col("n").alias("nb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("edits", allowed(F.greatest("na", "nb")))
    both = both.withColumn("wa", words(F.col("fa"))).withColumn("wb", words(F.col("fb"))).drop("fa", "fb")
    runs = "array_distinct(transform(sequence(0, greatest(size({0}) - 5, 0)), p -> xxhash64(slice({0}, p + 1, 5))))"
    shared = both.withColumn("ra", F.expr(runs.format("wa"))).withColumn("rb", F.expr(runs.format("wb"))).withColumn("held", F.size(F.array_intersect("ra", "rb")))
    contained = shared.where(F.col("held") >= F.size("ra") - SEGMENT * F.col("edits")).withColumn("containment", F.col("held") / F.size("ra")).drop("ra", "rb", "held")
    near = contained.withColumns({"ca": coded(F.col("wa")), "cb": coded(F.col("wb"))}).withColumn("distance", F.expr("levenshtein(ca, cb, edits)")).where("distance >= 0")
    again = near.withColumns({"ca": coded(F.col("wa"), 1), "cb": coded(F.col("wb"), 1)}).where(F.expr("levenshtein(ca, cb, edits)") >= 0)
    return again.select("a", "b", "distance", "containment")


def near_pairs(stored_texts: DataFrame, asked_texts: DataFrame) -> DataFrame:
    """Pairs (a, b, distance, containment) of different near texts, a of the stored and b of the asked ones (content, f, n; one row per content)."""
    stored = written(index(stored_texts))
    found = written(candidates(stored, probes(asked_texts), stored.count(), n_probes(asked_texts)))
    return verified(found, stored_texts, asked_texts)


def n_probes(texts: DataFrame) -> int:
    """About how many runs the texts look up."""
    return 2 * (texts.agg(F.sum("n")).first()[0] or 0)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row (content, f, n) per content; copies collapse before anything is compared."""
    return rows.groupBy("content").agg(F.min("f").alias("f"), F.min("n").alias("n"))
