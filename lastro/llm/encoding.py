"""Text decoded with a wrong encoding: found by a multinomial classifier, restored by inverting the predicted chain.

A chain is what happened to a text: the encoding it was written in and the one it was read as, once or twice, or the loss of
its letters. Sound words of the corpus are garbled by every chain, and a multinomial model on hashed byte bigrams learns
sound text and each chain. A word is garbled where a chain beats sound text and its inverse decodes strictly, to letters and
signs that the corpus's languages write; lost letters need no inverse. Only words with a character outside ASCII or an
entity are looked at, since no chain leaves plain ASCII changed.

Defined results: null and empty texts hold nothing; foreign letters, upper case and entities of the right letters are sound;
a text counts once however many words are garbled; very long texts are read whole; repeated ids are judged row by row.
"""

from __future__ import annotations

import html
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the corpus, the most frequent first, that the model is fitted on.
SAMPLE_WORDS = 4000
BUCKETS = 1 << 13
SEED = 7

#: Letters and signs that sound Portuguese and Spanish text writes outside ASCII.
LETTERS = "áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇñÑ"
SIGNS = "“”‘’–—…ºª½¼¾•·°©®™€£§«»¡¿‹›▶►→✓✔★●■\xa0"
LOST = "�"


def _sloppy(codec: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte -> character and back; bytes the code page leaves open are read as the control character of the same number."""
    read = {}
    for b in range(256):
        try:
            read[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            read[b] = chr(b)
    return read, {c: b for b, c in reversed(read.items())}


_PAGES = {c: _sloppy(c) for c in ("cp1252", "latin1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_15")}
#: Chain -> steps (written in, read as).
CHAINS: dict[str, list[tuple[str, str]]] = {f"utf8>{p}": [("utf8", p)] for p in ("cp1252", "latin1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_15")}
CHAINS |= {f"cp1252>{p}": [("cp1252", p)] for p in ("mac_roman", "cp850", "cp437", "cp1251", "cp1250")} | {"mac_roman>cp1252": [("mac_roman", "cp1252")], "cp850>cp1252": [("cp850", "cp1252")]}
CHAINS |= {"utf8>cp1252 x2": [("utf8", "cp1252")] * 2, "utf8>latin1 x2": [("utf8", "latin1")] * 2, "utf8>cp1252 x3": [("utf8", "cp1252")] * 3}
CLASSES = ["sound", "lost", "lost>cp1252", *CHAINS]


def _encode(text: str, codec: str) -> bytes | None:
    if codec == "utf8":
        return text.encode("utf8", "surrogatepass")
    back = _PAGES[codec][1]
    out = [back.get(c) for c in text]
    return None if None in out else bytes(out)


def _decode(raw: bytes, codec: str) -> str | None:
    if codec == "utf8":
        try:
            return raw.decode("utf8")
        except UnicodeDecodeError:
            return None
    return "".join(map(_PAGES[codec][0].__getitem__, raw))


def garble(text: str, chain: str) -> str | None:
    """What a chain makes of a sound text; None where its encoding can't write it."""
    if chain.startswith("lost"):
        lost = re.sub(r"[^\x00-\x7f]", LOST, text)
        return lost if chain == "lost" else _decode(lost.encode("utf8"), "cp1252")
    for written_in, read_as in CHAINS[chain]:
        raw = _encode(text, written_in)
        if raw is None:
            return None
        text = _decode(raw, read_as)
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before a chain, where every step back encodes and decodes strictly."""
    for written_in, read_as in reversed(CHAINS.get(chain, [("", "")])):
        raw = _encode(text, read_as) if read_as else None
        text = _decode(raw, written_in) if raw is not None else None
        if text is None:
            return None
    return text


_UPPER, _LOWER = "A-Z" + LETTERS.upper().replace("Ü", ""), "a-z" + LETTERS.lower()
_ODD = re.compile(rf"[^\x00-\x7f{re.escape(LETTERS + SIGNS)}\u2600-\u27bf\ufe0f\u200d\U0001f000-\U0001faff]|[\x00-\x08\x0b-\x1f\x7f]")
_INSIDE = re.compile(rf"[a-zA-Z{LETTERS}][^\x00-\x7f{LETTERS}’‘–—\xa0][a-zA-Z{LETTERS}]|[a-z{LETTERS}][½¼¾§£€©®™¡¿][.,;:!?]?$")
_CASE = re.compile(rf"[{_LOWER}][{_UPPER}]|[{_UPPER}][ÁÀÂÃÉÊÍÓÔÕÚÇ][a-z]{{2}}|[{_UPPER}]{{2}}[áàâãéêíóôõúüç]|^[{_LOWER}]?[áâãêíôõúçü]$|^… [a-z]|[A-Z][ÃÕ](?![OEA])|[Çç](?:[^aeiouáàâãéêíóôõúAEIOUÁÂÃÉÊÍÓÔÕÚ]|$)")

#: What the chains from UTF-8 make of one letter or sign; the parts may all be sound letters and signs, their sequence isn't.
_MADE = sorted({g for c in LETTERS + SIGNS for chain in CHAINS if chain.startswith("utf8>") and len(g := garble(c, chain) or "") > 1}, key=lambda g: (-len(g), g))
# A closing sign behind a capital that ends a word in capitals ("AMANHÃ”") is sound.
_CLOSED = re.compile(rf"(?<=[{_UPPER}])[ÃÂ][”’»›…–—](?![^\W\d_])")
_SEQUENCE = re.compile("|".join(map(re.escape, _MADE)))
#: A mark that Mac letters turn into within a word: an apostrophe that neither elides a vowel nor is English, a dash behind a letter that ends no Portuguese word.
_MAC = re.compile(rf"[{_LOWER}{_UPPER}]’(?=[a-z])(?<!\b[dlmnstDLMNST]’)(?<!\b[Qq]u’)(?<!’n’)(?!(?:s|t|m|d|n|re|ll|ve)\b)|(?<!’)\b[dlmnstDLMNST]’(?=[b-df-gj-np-tv-z])|[bcdfghjkpqtvx][—–](?=[a-z])")
#: Such marks anywhere within a word; only a word of the corpus is restored from them.
_MAYBE = re.compile(r"[^\W\d_][’—–][a-z]")
_END = re.compile(rf"[{_LOWER}]·(?=[.,;:!?]?(?:\s|$))|^[ÍÚÃÕÊÔÇ] [a-z]")


def odd(word: str) -> bool:
    """Whether a word as it stands holds what sound text does not: a foreign sign or letter, a sign within a word, broken case, or what a chain makes of one letter or sign."""
    return bool(_ODD.search(word) or _INSIDE.search(word) or _CASE.search(word) or _MAC.search(word) or _END.search(word) or _SEQUENCE.search(_CLOSED.sub("", word)))


def bare(word: str) -> str:
    """A word in lower case without what surrounds it."""
    return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", word.lower())


def plausible(text: str) -> bool:
    """Whether a restored word is one that sound text could hold."""
    return not text.isascii() and not odd(text)


def _features(word: str) -> np.ndarray:
    raw = b"\x02" + word.encode("utf8", "surrogatepass") + b"\x03"
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    return ((b[:-1] * 256 + b[1:]) * 2654435761 >> 7) % BUCKETS


def _foreign(rng: random.Random, n: int) -> list[str]:
    """Sound words with letters of other languages, in the shapes names and quotations have."""
    rare = [chr(i) for i in [*range(0xC0, 0x180), *range(0x391, 0x3CA), *range(0x410, 0x450)] if chr(i).isalpha()]
    latin = [c for c in rare if ord(c) < 0x180]
    out = []
    for _ in range(n):
        size = rng.randint(3, 9)
        if rng.random() < 0.15:
            script = [c for c in rare if ord(c) >= 0x391 and (ord(c) < 0x400) == (rng.random() < 0.5)] or rare
            word = "".join(rng.choice(script).lower() for _ in range(size))
        else:
            word = "".join(rng.choice("abdeilmnorstuv") for _ in range(size))
            at = rng.randrange(size)
            word = word[:at] + rng.choice(latin).lower() + word[at + 1 :]
        word = word.capitalize() if rng.random() < 0.5 else word
        out.append(rng.choice(["{}", "{}", "({})", "“{}”", "{},", "{}."]).format(word))
    return out


def _signed(rng: random.Random, n: int) -> list[str]:
    """Plain words with the quotation marks, dashes and bullets of sound text, which titles alone seldom show."""
    shapes = ["“{}", "{}”", "{}”,", "{}”.", "“{}”", "– {}", "— {}", "• {}", "· {}", "› {}", "» {}", "▶ {}", "{}…", "© {}", "{}º"]
    return [rng.choice(shapes).format("".join(rng.choice("aaaeeeoooirsstmdncl") for _ in range(rng.randint(1, 8)))) for _ in range(n)]


class Model:
    """Multinomial log-likelihoods of hashed byte bigrams per class."""

    def __init__(self, table: np.ndarray, known: frozenset[str] = frozenset()) -> None:
        self.table, self.known = table, known

    @classmethod
    def fit(cls, words: list[tuple[str, float]]) -> Model:
        """From sound words (mostly so: garbled ones among them are few) with weights."""
        rng = random.Random(SEED)
        known = frozenset(b for w, _ in words if plausible(w) and (b := bare(w)))
        counts = np.full((BUCKETS, len(CLASSES)), 0.05)
        words = [*words, *((w, 1.0) for w in _signed(rng, max(300, len(words) // 4)))]
        for w, weight in [*words, *((f, 1.0) for f in _foreign(rng, max(200, len(words) // 4)))]:
            np.add.at(counts[:, 0], _features(w), weight)
        for w, weight in words:
            if not plausible(w):
                continue
            for i, chain in enumerate(CLASSES[1:], 1):
                g = garble(w, chain)
                if g is not None and g != w:
                    np.add.at(counts[:, i], _features(g), weight)
        return cls(np.log(counts / counts.sum(0)).astype(np.float32), known)

    #: How much likelier a chain must be than sound text (natural logarithm): garbled words are few.
    MARGIN = 2.0

    def judge(self, word: str) -> tuple[str, str | None]:
        """(class, restored): 'sound' with the word itself, a chain with the restored word, or a loss with None."""
        plain = html.unescape(word) if "&" in word else word
        if plain.isascii():
            return "sound", word
        if LOST in plain:
            return "lost", None
        back = invert(plain, "mac_roman>cp1252") if _MAYBE.search(plain) else None
        if back is not None and bare(back) in self.known:
            return "mac_roman>cp1252", back
        if not odd(plain):
            return "sound", word
        scores = self.table[_features(plain)].sum(0)
        scores[0] += self.MARGIN
        for i in np.argsort(-scores):
            if i == 0:
                return "sound", word
            chain = CLASSES[i]
            if chain == "lost>cp1252":
                if "ï¿½" in plain:
                    return chain, None
                continue
            if chain == "lost":
                continue
            back = invert(plain, chain)
            if back is not None and back != plain and plausible(back):
                return chain, back
        return "sound", word


    def of_record(self, words: list[str]) -> str:
        """The chain of a whole record from its garbled words: of the chains that restore most of them, the likeliest for all together; '' where none restores any."""
        total, restored = np.zeros(len(CLASSES), np.float64), np.zeros(len(CLASSES), np.int64)
        for w in words:
            plain = html.unescape(w) if "&" in w else w
            total += self.table[_features(plain)].sum(0)
            for i, chain in enumerate(CLASSES):
                back = invert(plain, chain) if chain in CHAINS else None
                restored[i] += back is not None and back != plain and plausible(back)
        if not restored.any():
            return ""
        return CLASSES[max(range(len(CLASSES)), key=lambda i: (restored[i], total[i]))]


#: A word with anything outside ASCII or an entity; very short ones take the next word along.
_WORD = r"(?<!\S)\S?[^\x00-\x7F\s]\S{0,1}[ \t]+\S+|\S*(?:[^\x00-\x7F\s]|&#?\w{2,8};)\S*"
_WORD_PY = re.compile(_WORD.replace(r"\S", "[^ \t\n\r]").replace(r"\s", " \t\n\r").replace(r"\w", "[0-9A-Za-z]"))


def suspects(text: Column) -> Column:
    """Distinct words of a text that could be garbled."""
    spaced = F.regexp_replace(text, r"(?<![\x{00C3}\x{00C2}\x{251C}\x{252C}\x{221A}\x{0192}])\x{00A0}", " ")
    return F.array_distinct(F.regexp_extract_all(spaced, F.lit("(" + _WORD + ")"), 1))


def fit(texts: DataFrame, column: str, sample: int = SAMPLE_WORDS) -> Model:
    """A model of the corpus's own words: its ``sample`` most frequent suspects, weighted by the root of their counts."""
    words = texts.select(F.explode(suspects(F.col(column))).alias("w")).where(F.length("w") <= 60).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(sample).collect()
    return Model.fit([(r["w"], float(r["n"]) ** 0.5) for r in words])


def judged(texts: DataFrame, keys: list[str], column: str, model: Model) -> DataFrame:
    """The garbled texts: keys, the chain of the record (cadeia), the chains of its words with counts of distinct words, and the number of words lost for good."""
    schema = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys) + ", cadeia string, cadeias string, palavras int, perdidas int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(model)
        for pdf in batches:
            rows = []
            for i, ws in enumerate(pdf["_w"]):
                found: dict[str, int] = {}
                lost, garbled = 0, []
                for w in ws:
                    chain, back = known(w)
                    if chain != "sound":
                        found[chain] = found.get(chain, 0) + 1
                        lost += back is None
                        garbled.append(w)
                if found:
                    record = next(iter(found)) if len(found) == 1 and not lost else model.of_record(garbled)
                    rows.append((i, record, "; ".join(f"{c} {n}" for c, n in sorted(found.items())), sum(found.values()), lost))
            if not rows:
                continue
            out = pdf.iloc[[r[0] for r in rows]][keys].reset_index(drop=True)
            out["cadeia"], out["cadeias"], out["palavras"], out["perdidas"] = [r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows], "int32"), np.array([r[4] for r in rows], "int32")
            yield out

    asked = texts.select(*keys, suspects(F.col(column)).alias("_w")).where(F.size("_w") > 0)
    return asked.mapInPandas(run, schema)


class _Known:
    """Judgements of words, kept within a task; words that recur are judged once."""

    def __init__(self, model: Model, room: int = 500_000) -> None:
        self.model, self.room, self.seen = model, room, {}

    def __call__(self, word: str) -> tuple[str, str | None]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= self.room:
                self.seen.clear()
            got = self.seen[word] = self.model.judge(word)
        return got


def restored(texts: DataFrame, keys: list[str], column: str, model: Model) -> DataFrame:
    """keys, the text with every restorable word restored, whether it changed, and whether something in it is lost.

    The chain of the whole record is tried first on each of its garbled words, then the word's own.
    """
    schema = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys) + ", texto string, mudou boolean, perda boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(model)
        for pdf in batches:
            out = pdf[keys].copy()
            texts_, changed, losses = [], [], []
            for text in pdf["_t"]:
                judged_ = {w: known(w) for w in {m[0] for m in _WORD_PY.finditer(text)}}
                garbled = {w: v for w, v in judged_.items() if v[0] != "sound"}
                chains = {c for c, back in garbled.values() if back is not None}
                record = model.of_record(sorted(garbled)) if len(chains) > 1 else ""

                def one(m: re.Match) -> str:
                    chain, back = judged_[m[0]]
                    if chain == "sound" or back is None:
                        return m[0]
                    plain = html.unescape(m[0]) if "&" in m[0] else m[0]
                    whole = invert(plain, record) if record and record != chain else None
                    return whole if whole is not None and whole != plain and plausible(whole) else back

                new = _WORD_PY.sub(one, text) if garbled else text
                texts_.append(unicodedata.normalize("NFC", new) if new != text else text)
                changed.append(new != text)
                losses.append(any(back is None for _, back in garbled.values()))
            out["texto"], out["mudou"], out["perda"] = texts_, changed, losses
            yield out

    return texts.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_t")).mapInPandas(run, schema)
