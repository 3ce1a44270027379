"""Column functions on text that stay within generated code: folding, words, shingles, coded word strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by canonical decomposition."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base != chr(i) and base.isascii():
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _folds()


def unaccent(c: Column) -> Column:
    """Latin letters without their marks, composed or decomposed; everything else stays."""
    return F.regexp_replace(F.translate(c, ACCENTED, BARE), r"\p{M}+", "")


def fold(c: Column) -> Column:
    """Lower case, no marks, no invisible characters, separators inside numbers dropped, all else but letters and digits one space."""
    bare = F.regexp_replace(F.translate(F.lower(c), ACCENTED, BARE), r"[\p{M}\p{Cf}]+|(?<=\d)[.,](?=\d)", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def words(folded: Column) -> Column:
    """The words of a folded text; none for an empty or null one."""
    return F.when(F.length(folded) > 0, F.split(folded, " ")).otherwise(F.array().cast("array<string>"))


def letters_key(c: Column) -> Column:
    """Only the letters of any script, lower-cased."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def shingle_hashes(w: Column, n: int, step: int = 1) -> Column:
    """Structs (h, p): 64-bit hashes of each run of n words and its first position, at every ``step``-th position."""
    last = F.size(w) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.struct(F.xxhash64(F.array_join(F.slice(w, p + 1, n), " ")).alias("h"), p.alias("p")))


def coded(w: Column, seed: int = 0) -> Column:
    """The words as one character each, by hash into 55,040 code points: Levenshtein distance on it is that on words.

    Two words may share a character (one pair in 55,040), which can only make a distance smaller; callers that need
    certainty compare a second string of another seed.
    """
    return F.decode(F.unhex(F.array_join(F.transform(w, lambda x: F.lpad(F.hex(F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(55040)) + 256), 4, "0")), "")), "UTF-16BE")
