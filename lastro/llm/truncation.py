"""Texts cut off by field limits.

Each text's length is recomputed under several encodings and escapings, with and without a mark left by the cut; lengths
are grouped per source, and a length that far more texts share than its neighbours is a hidden limit. Texts at a limit, and
texts that carry a mark or debris, then have their endings inspected; so have the others, against what the corpus shows
about the words that sentences end with.

Defined results: null and blank texts are not cut; a text that ends its sentence is whole, at a limit or not; copies of a
text are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.session import written

#: What storage or transfer leaves after a cut. The first pattern is certain, the second also a writer's habit.
MARK = r"\s*(?:\[(?:\.\.\.|…|\+)\]|\(continua[^)]{0,12}\)?|(?:\.\.\.|…)?\s*(?:Ler|Leia|Ver|Saiba|Continue)\s+(?:mais|lendo|a seguir)\.?|\[?(?:truncado|cortado|truncated)\]?)\s*$"
DOTS = r"(?:\.{2,}|…)\s*$"
#: Broken markup, entity or escape at the very end, or the replacement character of a split letter.
DEBRIS = r"(?:&#?\w{0,8}|<[/!]?[A-Za-z]{0,10}(?:\s[^>]{0,60})?|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|\x{FFFD}+|[\x{00C2}-\x{00C5}\x{00E2}\x{0000}]+)$"
STOP = r"[.!?;:][\"”’'»)\]*_]*\s*$|[.!?][\"”’'»)\]*_]+\s*$"
#: Endings of whole texts that have no full stop: tags, links, emoji, laughter, credits and signatures on a line of their own, list items.
OPEN_END = r"(?:#[\p{L}\p{N}_]+|@[\p{L}\p{N}_]+|https?://\S+|\b(?:kk+|rs(?:rs)+|haha\w*)|[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}]+)\s*$"
_NAME = r"\p{Lu}[\p{L}'-]+(?:\s+(?:d[aeo]s?\s+)?\p{Lu}[\p{L}'-]+){0,4}"
CREDIT = r"\n\s*(?:[—–-]\s*(?:Redação|" + _NAME + r")|(?:Texto de|Texto:|Com informa(?:ções|ção) de|Foto:|Edição:|Por|Reportagem de)\s+" + _NAME + r"|Equipe de \p{L}+|Da redação|Fonte:\s*\S+)\s*$"
#: Share of all texts (3 at least) that must close on a phrase before it is a habit; a cut in one place is far rarer, however large the corpus.
HABIT = 0.002
#: Share of those that may lie at a hidden limit; a phrase that closes texts mostly there is where the limit cuts.
HABIT_AT_LIMIT = 0.1


def counters(c: Column) -> Column:
    """Struct of what the measures need of a text: characters, bytes and the characters that some escaping widens."""
    n = F.length(c)
    less = lambda *signs: sum((n - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in signs), F.lit(0))
    astral = F.octet_length(F.encode(c, "UTF-16BE")) / 2 - n
    above = F.when(F.octet_length(c) == n, 0).otherwise(n - F.length(F.regexp_replace(c, r"[^\x00-\x7F]+", "")))
    each = {"n": n, "b": F.octet_length(c), "nl": less("\n"), "quotes": less('"'), "amp": less("&"), "angles": less("<", ">"), "slashes": less("\\"), "astral": astral, "above": above}
    return F.struct(*[v.cast("int").alias(k) for k, v in each.items()])


def lengths(k: Column) -> Column:
    """Map of measure -> length from ``counters``: characters, bytes, UTF-16 units, after entity and JSON escaping, after newline conversion."""
    n, b, nl, quotes, slashes, astral, above = (k[x] for x in ("n", "b", "nl", "quotes", "slashes", "astral", "above"))
    markup = 4 * k["amp"] + 3 * k["angles"] + 5 * quotes
    each = {
        "caracteres": n, "utf8": b, "utf16": n + astral, "entidades": n + markup, "entidades_utf8": b + markup,
        "json": n + quotes + slashes + nl + 5 * above + 6 * astral, "json_utf8": b + quotes + slashes + nl,
        "crlf": n + nl, "crlf_utf8": b + nl,
    }
    return F.create_map(*[x for key, v in each.items() for x in (F.lit(key), v)])


def measured(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Per text its endings and lengths; the text itself is no longer carried, but for its last 200 characters.

    Each text is counted once; the lengths before a mark are those of the whole less those of what follows.
    """
    c = F.col(text)
    base = docs.where(F.length(F.trim(c)) > 0).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), counters(c).alias("_k"), F.substring(F.rtrim(c), -400, 400).alias("_last"))
    r = F.regexp_replace("_last", r"\s+$", "")
    cut = base.withColumn("_r", r).withColumn("tail", F.substring("_r", -200, 200)).withColumn("mark", F.regexp_extract("tail", "(" + MARK + ")", 1))
    cut = cut.withColumn("dots", F.when(F.col("mark") == "", F.regexp_extract("tail", "(" + DOTS + ")", 1)).otherwise(""))
    body = F.regexp_replace(F.expr("substring(_r, 1, length(_r) - length(mark) - length(dots))"), r"\s+$", "")
    cut = cut.withColumn("_body", body).withColumn("_rest", counters(F.expr("substring(_last, length(_body) + 1)")))
    part = F.struct(*[(F.col(f"_k.{x}") - F.col(f"_rest.{x}")).alias(x) for x in ("n", "b", "nl", "quotes", "amp", "angles", "slashes", "astral", "above")])
    return cut.select("doc_id", "source", "mark", "dots", F.substring("_body", -200, 200).alias("end"), F.col("_k.n").alias("n"), lengths(F.col("_k")).alias("whole"), lengths(part).alias("part"))


def with_endings(texts: DataFrame) -> DataFrame:
    """``measured`` texts with what their endings are: a full stop, an open ending, debris, the last word and the last three."""
    end = F.col("end")
    plain = F.trim(F.regexp_replace(F.lower(end), r"[^\p{L}\p{N}-]+", " "))
    stop = (F.col("dots") == "") & end.rlike(STOP)
    open_end = (F.col("dots") == "") & (end.rlike(OPEN_END) | end.rlike(CREDIT))
    out = texts.withColumns({"stop": stop, "open": open_end, "debris": end.rlike(DEBRIS), "w": F.substring_index(plain, " ", -1), "last3": F.substring_index(plain, " ", -3)})
    return out.withColumn("n_words", F.size(F.split(plain, " ")))


def hidden_limits(texts: DataFrame, least: int = 5, ratio: float = 6.0, window: int = 20) -> DataFrame:
    """Rows (source, form, measure, size, n, unstopped): lengths that at least ``least`` texts share and ``ratio`` times what their neighbours within ``window`` have on average, and of which at least three in ten do not end a sentence.

    ``form`` is 'whole' or, for texts with a mark or dots, 'part' (the length before them). Lengths are counted on the map
    side first; what is joined after that is one row per source, measure and length.
    """
    whole = texts.select("source", F.lit("whole").alias("form"), "stop", "open", F.explode("whole").alias("measure", "size"))
    part = texts.where((F.col("mark") != "") | (F.col("dots") != "")).select("source", F.lit("part").alias("form"), "stop", "open", F.explode("part").alias("measure", "size"))
    counted = whole.unionByName(part).groupBy("source", "form", "measure", "size").agg(F.count("*").alias("n"), F.sum((~F.col("stop") & ~F.col("open")).cast("int")).alias("unstopped"))
    w = "PARTITION BY source, form, measure ORDER BY size RANGE BETWEEN {0} PRECEDING AND {0} FOLLOWING".format(window)
    near = counted.withColumn("near", (F.expr(f"sum(n) OVER ({w})") - F.col("n")) / (2.0 * window))
    return near.where((F.col("n") >= least) & (F.col("unstopped") >= 0.3 * F.col("n")) & (F.col("n") >= ratio * F.greatest(F.col("near"), F.lit(0.3)))).select("source", "form", "measure", "size", "n", "unstopped")


def at_limit(texts: DataFrame, limits: DataFrame, slack: int = 3) -> DataFrame:
    """The ids of texts that lie at a limit of their source.

    Byte limits that may not split a letter leave texts up to ``slack`` bytes short; those of characters fit exactly. The
    limits of one source are few (each takes ``least`` texts), so they are gathered into one array per source.
    """
    per_source = limits.groupBy("source").agg(F.collect_set(F.concat_ws(":", "form", "measure", "size")).alias("limits"))
    joined = texts.join(F.broadcast(per_source) if per_source.count() <= 100_000 else per_source, "source")

    def hits(form: str, lengths_: str) -> Column:
        def one(k: Column, v: Column) -> Column:
            back = F.when(k.contains("utf8"), slack).otherwise(0)
            return F.exists(F.sequence(F.lit(0), back), lambda i: F.array_contains(F.col("limits"), F.concat_ws(":", F.lit(form), k, v + i)))

        return F.exists(F.map_entries(F.col(lengths_)), lambda e: one(e["key"], e["value"]))

    hit = hits("whole", "whole") | (((F.col("mark") != "") | (F.col("dots") != "")) & hits("part", "part"))
    return joined.where(hit).select("doc_id")


def ending_words(docs: DataFrame, text: str) -> DataFrame:
    """Per word (w) of the corpus how often it stands (n) and how often a sentence ends on it (ends).

    Counted over all documents; partial sums come before the shuffle.
    """
    stop = "\u0001"  # put behind the last word of each sentence
    ended = F.regexp_replace(F.lower(F.col(text)), r"[\"”’'»)\]]*(?:(?<!\.)\.(?!\.)|[!?]+)[\"”’'»)\]]*(?=\s|$)", stop + " ")
    words = F.split(F.regexp_replace(ended, r"[^\p{L}\p{N}\x01-]+", " "), " ")
    counted = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.explode(words).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    w = F.replace(F.col("t"), F.lit(stop), F.lit(""))
    return counted.select(w.alias("w"), "n", F.when(F.col("t").endswith(stop), F.col("n")).otherwise(0).alias("e")).where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"), F.sum("e").alias("ends"))


def judged(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """One row per text: doc_id, source, cut, and what it was judged by.

    A text is cut where a certain mark or debris ends it; where it lies at a hidden limit and ends neither a sentence nor in
    one of the open endings; and anywhere else where it ends neither so nor on a word that the corpus shows at the end of
    sentences (a fragment of a word is shown nowhere). Whole phrases that writers close texts with clear a text of either
    kind: such a phrase closes far more of all distinct texts than cuts at one place could, and lies at limits by chance only.
    """
    texts = written(with_endings(measured(docs, doc_id, source, text)))
    hit = at_limit(texts, written(hidden_limits(texts))).withColumn("limit", F.lit(True))
    flags = texts.select("doc_id", "source", "mark", "dots", "end", "n", "stop", "open", "debris", "w", "last3", "n_words")
    asked = flags.where(~F.col("stop") & ~F.col("open")).select("w").distinct()
    shown = ending_words(docs, text).join(asked, "w", "left_semi").select("w", F.col("n").alias("w_n"), "ends")
    open_ended = flags.where(~F.col("stop") & ~F.col("open") & (F.col("mark") == "")).join(hit, "doc_id", "left")
    # Copies, or texts with the same last 200 characters, tell of a phrase once.
    tails = open_ended.groupBy("w", "last3", F.xxhash64("end").alias("tail")).agg(F.max(F.coalesce("limit", F.lit(False)).cast("int")).alias("limited"))
    habits = tails.groupBy("w", "last3").agg(F.count("*").alias("habit"), F.sum("limited").alias("limited"))
    words = habits.join(shown, "w", "left").withColumn("w_n", F.coalesce("w_n", F.lit(0))).withColumn("ends", F.coalesce("ends", F.lit(0)))
    usual = (F.col("habit") >= F.greatest(F.lit(3), F.lit(HABIT * texts.count()))) & (F.col("limited") <= HABIT_AT_LIMIT * F.col("habit"))
    words = words.select("w", "last3", "w_n", "ends", (F.col("ends") < 0.02 * F.col("w_n") + 0.5).alias("unshown"), usual.alias("usual"))
    out = flags.join(hit, "doc_id", "left").join(words, ["w", "last3"], "left").withColumn("limit", F.coalesce("limit", F.lit(False)))
    usual = F.coalesce("usual", F.lit(False)) & (F.col("n_words") >= 3)
    tiny = (F.col("n_words") <= 2) & (F.coalesce("w_n", F.lit(0)) > 2)
    unfinished = ~usual & ~tiny & F.when(F.col("limit"), True).otherwise(F.coalesce("unshown", F.lit(True)))
    return out.withColumn("cut", (F.col("mark") != "") | F.col("debris") | (~F.col("stop") & ~F.col("open") & unfinished))


def cut_shares(judged_: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, those of them at a hidden limit, and the share of cut texts."""
    return judged_.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("int")).alias("n_cut"), F.sum((F.col("cut") & F.col("limit")).cast("int")).alias("n_limite")).withColumn("share", F.col("n_cut") / F.col("n"))
