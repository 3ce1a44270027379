"""Main text of pages, by differencing each page with those nearest to it by address.

Addresses of a host are ordered by path. Each text is aligned by longest common subsequence of lines with one text of each of
the nearest addresses before and after it, and lines that two different stories of one host share are the host's own and go.
Two lines are the same where their letters are, or where they carry the same label: the words before a colon at the head of
a line ("see also: ..."), a plus sign there, or the shape of a headline that is not the page's own, which is told by the
opening words that the corpus's own titles have. So a pointer to another story aligns with the neighbour's pointer although
each names a story of its own.

What alignment finds shared then speaks for lines it could not reach (bylines of authors whom no neighbour shares, pages at
the end of a host): the same letters or label in the same host, the same label anywhere, or the same frame (names and numbers
masked) anywhere, where alignment found at least two lines and one in five of all that carry it shared (for letters in one
host: two lines). No word, phrase or pattern of any site is given; all of it is learned from the rows at hand.

Comparison is on the ASCII letters of lines, so pages with garbled letters align like others. Texts of one address are not
aligned with each other, and pages that share half of each other's story are copies of one story and say nothing.

Defined results: null and empty texts have no lines and blank lines are never results; texts without an address are one host
of one address; repeated rows get the same lines; very long pages are aligned whole; extra columns are ignored; the result
does not depend on the number of partitions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastro.llm.history import page_key
from lastro.llm.lines import sized
from lastro.session import written

#: Addresses before and after each that its texts are aligned with.
NEIGHBOURS = 3
#: Share of the lines of a label or frame that alignment must find shared before it counts where alignment does not reach.
CONFIRMED = 0.2
#: Unlabelled lines of so many letters are taken for a story's own when two pages are judged to be copies.
STORY_LETTERS = 60
#: Words that a frame, and a label before its colon, may have by definition.
FRAME_WORDS, LABEL_WORDS = 14, 5
#: A title's opening (three words) counts where one title in so many begins with it, so openings are at most as many.
OPENING = 2000
#: Addresses that one task aligns at a time, and texts beyond which a block of addresses is split.
BLOCK, BLOCK_TEXTS = 256, 4096

_PLUS, _HEADLINE = 1, 2  # symbols of labels that are no words

_ENTITY = re.compile(r"&#?\w{2,8};")
_NOT_LETTERS = bytes(i for i in range(256) if not (97 <= i <= 122))
_NAME = re.compile(r"\b[A-Z][a-z']+(?: (?:d[aeo]s? )?[A-Z][a-z']+)*")
_NUMBER = re.compile(r"\d[\d.,]*")
_SIGNS = re.compile(r"[^A-Za-z0:?/|]+")
_IS_PLUS = re.compile(r"[^A-Za-z0-9]*\+ ")
_LABEL = re.compile(r"[^A-Za-z0-9]*((?:[^\s:]+ ){0,%d}[^\s:]+?) ?: " % (LABEL_WORDS - 1))
_LABEL_NAME = re.compile(r"(?:[A-Z][a-z']+ )+(?:d[aeo]s? (?:[A-Z][a-z']+ )+)?(?=[a-z])")
_HEAD = re.compile(r"[\W\d_]*?[A-ZÀ-ÖØ-ÞЀ-Я0-9]")
_SENTENCE = re.compile(r"[^ .]\.$|\. [A-Z]")
_QUOTED = re.compile(r"\s*(?:[“\"‘'«]|[-–•*] *[^\W_A-Z])|\d+\) ")


def _hash(text: str | bytes) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def ascii_line(line: str) -> str:
    """The ASCII of a line, entities dropped, white space collapsed."""
    plain = _ENTITY.sub("", line) if "&" in line else line
    return " ".join(plain.replace("\xa0", " ").encode("ascii", "ignore").decode().split())


def line_key(line: str) -> bytes:
    """Only the ASCII letters of a line, in lower case."""
    plain = _ENTITY.sub("", line) if "&" in line else line
    return plain.lower().encode("ascii", "ignore").translate(None, _NOT_LETTERS)


def masked(bare: str) -> str:
    """A bare line with each name as N and each number as 0, other signs as spaces."""
    return _SIGNS.sub(" ", _NAME.sub("N", _NUMBER.sub("0", bare))).strip()


def opening(bare: str) -> int:
    """Hash of the first three words of a masked line."""
    return _hash(" ".join(masked(bare).split(" ")[:3]))


def read_line(line: str) -> tuple[bytes, int, int, int, int, bool]:
    """(key, hash of it, label, opening, frame, story) of a line, whose own headline it may be left aside."""
    bare, key = ascii_line(line), line_key(line)
    n_words = bare.count(" ") + 1
    label = opens = 0
    if _IS_PLUS.match(bare):
        label = _PLUS
    elif m := _LABEL.match(bare):
        # A label that begins with a name ("Somebody wrote:") is that of any name.
        label = _hash(_SIGNS.sub("", _LABEL_NAME.sub("0", m[1]).lower()))
    elif n_words >= 4 and _HEAD.match(line) and not _SENTENCE.search(bare) and not _QUOTED.match(line):
        # A headline's shape: four words or more from a capital or number on, no sentence end, no quotation, no list item.
        opens = opening(bare)
    frame = _hash(masked(bare)) if n_words <= FRAME_WORDS else 0
    return key, _hash(key or bare), label, opens, frame, not label and len(key) >= STORY_LETTERS


def _trigrams(key: bytes) -> set[bytes]:
    return {key[i : i + 3] for i in range(len(key) - 2)}


def title_openings(rows: DataFrame) -> set[int]:
    """Openings that at least one in ``OPENING`` of all titles has; at most that many come to the driver."""

    @F.pandas_udf("long")
    def opened(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: opening(ascii_line(t)))

    counted = rows.where(F.length("titulo") > 0).groupBy(F.col("titulo")).agg(F.count("*").alias("n")).groupBy(opened("titulo").alias("o")).agg(F.sum("n").alias("n"))
    counted = written(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {r["o"] for r in counted.where(F.col("n") * OPENING >= total).select("o").collect()}


def pages(rows: DataFrame) -> DataFrame:
    """(campo, id, host, path, h, at, key, label, opening, frame, story) of rows (campo, id, url, titulo, texto).

    Per line that isn't blank: its number, hash of its letters, label (0 for none), opening where it has a headline's shape
    (else 0), frame (0 for none), and whether it is a story's own; the page's own headline, told by its title or by what its
    address spells, has neither label, opening nor frame. h tells texts of one address apart.
    """
    address = page_key(F.col("url"))
    slug = F.regexp_replace(F.regexp_extract(F.col("url"), r"/([A-Za-z0-9-]{15,})[^/]*$", 1), r"[^a-z]+", "")
    base = rows.where(F.length("texto") > 0).select("campo", "id", "texto", F.coalesce(F.substring_index(address, "/", 1), F.lit("")).alias("host"), F.coalesce(address, F.lit("")).alias("path"), F.coalesce("titulo", F.lit("")).alias("titulo"), F.coalesce(slug, F.lit("")).alias("slug"))
    schema = f"campo string, id {base.schema['id'].dataType.simpleString()}, host string, path string, h long, at array<int>, key array<long>, label array<long>, opening array<long>, frame array<long>, story array<boolean>"
    names = ["campo", "id", "host", "path", "h", "at", "key", "label", "opening", "frame", "story"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for pdf in batches:
            out = []
            for campo, rid, text, host, path, title, slug_ in zip(*[pdf[c] for c in ("campo", "id", "texto", "host", "path", "titulo", "slug")], strict=True):
                t, s = line_key(title), slug_.encode()
                spelt = _trigrams(s) if len(s) >= 20 else set()
                at, rows_ = [], []
                for i, line in enumerate(text.split("\n")):
                    if not line or line.isspace():
                        continue
                    got = known.get(line)
                    if got is None:
                        if len(known) > 100_000:
                            known.clear()
                        got = known[line] = read_line(line)
                    key, h, label, opens, frame, story = got
                    own = len(t) >= 8 and key == t
                    if not own and spelt and (label or opens):
                        own = len(spelt & _trigrams(key[: len(s) + 3])) >= 0.7 * len(spelt)
                    at.append(i)
                    rows_.append((h, 0, 0, 0, False) if own else (h, label, opens, frame, story))
                columns = [list(c) for c in zip(*rows_, strict=True)] if rows_ else [[], [], [], [], []]
                out.append((campo, rid, host, path, _hash(text.encode("utf8", "surrogatepass") + b"\0" + t), at, *columns))
            yield pd.DataFrame(out, columns=names)

    return base.mapInPandas(run, schema)


def common_lines(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of lines (key, label); lines are equal in their key or in a label that isn't 0.

    Bit-parallel over the lines that have any equal on the other side. Of the rows of bits only every so manieth is kept and
    those between are computed anew on the way back, so two pages of n lines need room for n * sqrt(n) bits.
    """
    keys_b, labels_b = {k for k, _ in b}, {x for _, x in b if x}
    ia = [i for i, (k, x) in enumerate(a) if k in keys_b or x in labels_b]
    if not ia:
        return []
    keys_a, labels_a = {a[i][0] for i in ia}, {a[i][1] for i in ia if a[i][1]}
    ib = [j for j, (k, x) in enumerate(b) if k in keys_a or x in labels_a]
    by_key: dict[int, int] = defaultdict(int)
    by_label: dict[int, int] = defaultdict(int)
    for n, i in enumerate(ia):
        by_key[a[i][0]] |= 1 << n
        if a[i][1]:
            by_label[a[i][1]] |= 1 << n
    full = (1 << len(ia)) - 1
    equal = [by_key.get(b[j][0], 0) | (by_label.get(b[j][1], 0) if b[j][1] else 0) for j in ib]

    def step(v: int, m: int) -> int:
        u = v & m
        return ((v + u) | (v - u)) & full

    every = max(1, int(len(ib) ** 0.5))
    kept, v = [full], full
    for n, m in enumerate(equal, 1):
        v = step(v, m)
        if n % every == 0:
            kept.append(v)
    out, i, j = [], len(ia) - 1, len(ib) - 1
    block, rows = -1, []
    while i >= 0 and j >= 0:
        if j // every != block:
            block = j // every
            rows = [kept[block]]  # rows[x] is the row before line block * every + x
            for m in equal[block * every : (block + 1) * every]:
                rows.append(step(rows[-1], m))
        x = j - block * every
        if rows[x + 1] >> i & 1:
            i -= 1
        elif not rows[x] >> i & 1:
            j -= 1
        else:
            out.append((ia[i], ib[j]))
            i, j = i - 1, j - 1
    return out


def placed(seen: DataFrame) -> DataFrame:
    """(host, path, pos, n, key, label, opening, story): one text per address, the longest, and its number among its host's addresses in order of path; n texts in all.

    The order is that of one range sort; numbers are its row numbers less those of the host's first row, summed over
    partitions, so no host is gathered in one task.
    """
    longest = F.max(F.struct(F.size("key").alias("s"), "h", "key", "label", "opening", "story")).alias("m")
    addresses = seen.groupBy("host", "path").agg(longest, F.count("*").alias("n"))
    order = ["host", "path"]
    ordered = addresses.select("host", "path", "n", *[F.col(f"m.{c}").alias(c) for c in ("key", "label", "opening", "story")]).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("row", 33))
    parts = ordered.groupBy("host", "part").agg(F.min("row").alias("first"), F.count("*").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("host", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return written(ordered.join(parts, ["host", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift"))


def differenced(seen: DataFrame, openings: set[int], neighbours: int = NEIGHBOURS) -> DataFrame:
    """(campo, id, host, at, key, label, frame, shared) of ``pages``; shared is 1 where a neighbour has the line's letters, 2 where only its label, else 0.

    Blocks of neighbouring addresses are aligned together, with the neighbours beyond their ends; a block with very many
    texts (of one address, say) is split, and its neighbours go along with each piece.
    """
    places = placed(seen)
    block = F.floor(F.col("pos") / BLOCK)
    pieces = places.groupBy("host", block.alias("block")).agg(F.ceil(F.sum("n") / BLOCK_TEXTS).cast("int").alias("pieces"))
    places = written(places.withColumn("block", block).join(pieces, ["host", "block"]))
    empty = {"campo": "string", "id": seen.schema["id"].dataType.simpleString(), "h": "long", "at": "array<int>", "frame": "array<long>"}
    texts = seen.join(places.select("host", "path", "block", "pos", "pieces"), ["host", "path"])
    texts = texts.withColumn("piece", F.pmod("h", "pieces").cast("int")).withColumn("role", F.lit(1)).drop("pieces", "path")
    reach = F.array(*[F.floor((F.col("pos") + o) / BLOCK) for o in (-neighbours, 0, neighbours)])
    asked = places.withColumn("to", F.explode(F.array_distinct(reach))).where("to >= 0").drop("block", "pieces", "path", "n")
    # A neighbour beyond the host's last block asks for nothing there: the join drops it.
    asked = asked.join(pieces.withColumnRenamed("block", "to"), ["host", "to"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asked = asked.withColumn("block", F.col("to")).withColumn("role", F.lit(0)).drop("to", "pieces")
    for name, kind in empty.items():
        asked = asked.withColumn(name, F.lit(None).cast(kind))
    schema = f"campo string, id {empty['id']}, host string, at array<int>, key array<long>, label array<long>, frame array<long>, shared array<int>"
    names = ["campo", "id", "host", "at", "key", "label", "frame", "shared"]

    def symbols(label: list[int], opens: list[int]) -> list[int]:
        return [_HEADLINE if o in openings else x for x, o in zip(label, opens, strict=True)] if any(opens) else label

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        where, last, flags = None, None, []
        out: list[tuple] = []
        for pdf in batches:
            for host, at_block, piece, role, pos, h, campo, rid, at, key, label, opens, frame, story in zip(*[pdf[c] for c in ("host", "block", "piece", "role", "pos", "h", "campo", "id", "at", "key", "label", "opening", "frame", "story")], strict=True):
                if (host, at_block, piece) != where:
                    where, held, last = (host, at_block, piece), {}, None
                label = symbols(label.tolist(), opens.tolist())
                if role == 0:
                    held[pos] = (list(zip(key.tolist(), label, strict=True)), story.tolist())
                    continue
                if (pos, h) != last:
                    last, mine, own = (pos, h), list(zip(key.tolist(), label, strict=True)), story.tolist()
                    flags = [0] * len(mine)
                    for o in range(-neighbours, neighbours + 1):
                        other = held.get(pos + o) if o else None
                        if other is None:
                            continue
                        both = common_lines(mine, other[0])
                        stories = sum(own[i] for i, _ in both)
                        if stories and stories * 2 >= min(sum(own), sum(other[1])):
                            continue  # two copies of one story say nothing about its lines
                        for i, j in both:
                            flags[i] = 1 if mine[i][0] == other[0][j][0] else flags[i] or 2
                out.append((campo, rid, host, at, key, label, frame, flags))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    both = asked.unionByName(texts)
    key = ["host", "block", "piece"]
    return both.repartition(*key).sortWithinPartitions(*key, "role", "pos", "h").mapInPandas(run, schema)


def furniture(rows: DataFrame) -> DataFrame:
    """(campo, id, linha_no): lines that are not main text of rows (campo, id, url, titulo, texto)."""
    marked = written(differenced(written(pages(rows)), title_openings(rows)))
    each = marked.select("campo", "id", "host", F.inline(F.arrays_zip("at", "key", "label", "frame", "shared")))
    # What a line carries besides its place: its letters and label in its host, its label and frame anywhere.
    tokens = F.array_compact(F.array(
        F.xxhash64(F.lit("letters"), "host", "key"),
        F.when(F.col("label") != 0, F.xxhash64(F.lit("label"), "host", "label")),
        F.when(F.col("label") != 0, F.xxhash64(F.lit("label"), "label")),
        F.when(F.col("frame") != 0, F.xxhash64(F.lit("frame"), "frame")),
    ))
    # A shared label proves labels, shared letters prove letters and frames.
    proven = F.array_compact(F.array(
        (F.col("shared") == 1).cast("int"), F.when(F.col("label") != 0, (F.col("shared") > 0).cast("int")),
        F.when(F.col("label") != 0, (F.col("shared") > 0).cast("int")), F.when(F.col("frame") != 0, (F.col("shared") == 1).cast("int")),
    ))
    kinds = F.array_compact(F.array(F.lit(0), F.when(F.col("label") != 0, 1), F.when(F.col("label") != 0, 2), F.when(F.col("frame") != 0, 3)))
    counted = each.select(F.inline(F.arrays_zip(tokens.alias("token"), proven.alias("shared"), kinds.alias("kind")))).groupBy("token").agg(F.count("*").alias("n"), F.sum("shared").alias("s"), F.first("kind").alias("kind"))
    confirmed = written(counted.where((F.col("s") >= 2) & ((F.col("kind") == 0) | (F.col("s") >= CONFIRMED * F.col("n")))).select("token"))
    reached = each.where("shared = 0").select("campo", "id", "at", F.explode(tokens).alias("token")).join(sized(confirmed), "token", "left_semi").select("campo", "id", "at").distinct()
    return each.where("shared > 0").select("campo", "id", "at").unionByName(reached).withColumnRenamed("at", "linha_no")


def main_text(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """(campo, id, texto_principal, linhas_removidas) of all rows with text."""
    drop = removed.groupBy("campo", "id").agg(F.collect_set("linha_no").alias("drop"))
    out = rows.where(F.length("texto") > 0).join(drop, ["campo", "id"], "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    kept = F.filter(F.split("texto", "\n"), lambda x, i: ~F.array_contains(F.col("drop"), i))
    return out.select("campo", "id", F.array_join(kept, "\n").alias("texto_principal"), F.size("drop").alias("linhas_removidas"))

