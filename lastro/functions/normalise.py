"""Text normalisers, token sets and style measures as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lastro.functions.text import unaccent

# Stop words of the token lists, and the word lists of the style measures.
STOP = ["que", "com", "para", "por", "uma", "dos", "das", "nao", "mais", "como", "mas", "foi", "ele", "ela", "seu", "sua", "sao", "ser", "tem", "nos"]
# Stop words of the registry search, and the words that frame how something is told rather than what.
STOP_SEARCH = """a ao aos aquela aquelas aquele aqueles aquilo as ate com como da das de dela delas dele deles depois do dos
e ela elas ele eles em entre era eram essa essas esse esses esta estas este estes eu foi fomos for foram
fosse fossem fui ha isso isto ja la lhe lhes mais mas me mesmo meu meus minha minhas muito na nas nem
no nos nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual quando que quem
se sem ser seu seus so sua suas tambem te tem tinha tu tua tuas um uma voce voces vos sao estao
seria teria sera serao vai vao ter ainda pode podem deve devem apos sobre cada outro outra
outros outras todo toda todos todas nao sim quais onde porque pois entao assim aqui ali tudo nada""".split()
FRAMING = """falso falsa falsos falsas fake fakes fato fatos verdade verdadeiro verdadeira boato boatos enganoso enganosa
checagem checagens checado circula circulam circulando vi viu zap zapzap whatsapp grupo grupos mensagem
mensagens post posts postagem postagens publicacao publicacoes rede redes sociais alega alegam alegacao diz
dizem dizendo disseram afirma afirmam afirmando sabia gente pessoal compartilhe compartilhar urgente ta to
pra pro ne eh recebi mandaram mandou manda falaram falando noticia noticias veja confira real mesmo ai""".split()
URGENT = ["urgente", "atencao", "compartilhe", "repassem", "alerta", "cuidado", "bomba"]
POSITIVE = ["beneficiou", "ampliou", "liberou", "apoio", "verdade", "correta", "confirmou"]
NEGATIVE = ["falso", "enganoso", "prejudicou", "perderam", "contaminou", "escondeu", "desmentem"]


def plain(c: Column) -> Column:
    """Marks dropped, lower case, all but a-z, 0-9 and space as a space, collapsed; null gives ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccent(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]", " "), " +", " "))


def ascii_deleted(c: Column) -> Column:
    """Marks dropped, whatever is not ASCII then deleted."""
    return F.regexp_replace(unaccent(c), r"[^\x00-\x7F]", "")


def ascii_spaced(c: Column) -> Column:
    """Marks dropped, whatever is not ASCII as a space, lower case, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unaccent(c)), r"[^\x00-\x7F]", " "), r"\s+", " "))


def tokens(c: Column, least: int = 3, stop: list[str] = STOP) -> Column:
    """Runs of at least ``least`` letters and digits of the plain text, stop words left out, order and repeats kept."""
    found = F.regexp_extract_all(plain(c), F.lit(f"([a-z0-9]{{{least},}})"), 1)
    return F.filter(found, lambda x: ~x.isin(stop))


def content_tokens(c: Column) -> Column:
    """Words of a text for the registry search: no marks, neither stop words nor framing; three letters at least, two characters where there is a digit."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1), ascii_deleted)
    return F.filter(found, lambda x: (F.length(x) >= F.when(x.rlike("[0-9]"), 2).otherwise(3)) & ~x.isin(STOP_SEARCH + FRAMING))


def numbers(c: Column) -> Column:
    """Distinct runs of digits that stand for themselves, glued to no letter, underscore or hyphen before them and to no letter behind."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_-])([0-9]++)(?!\p{L})"), 1))


def word_shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n words of the plain text; none where it has fewer."""
    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(F.split(plain(c), " ")), runs), 1)


def first_tokens(c: Column, n: int) -> Column:
    """The first n distinct content tokens, in order."""
    return F.slice(F.array_distinct(tokens(c)), 1, n)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's token set that b holds; 0 where a has none."""
    s = F.array_distinct(tokens(a, 4))
    return F.when(F.size(s) > 0, F.size(F.array_intersect(s, tokens(b, 4))) / F.size(s)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """Dice of two arrays as sets; 0 where both are empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def era(day: Column) -> Column:
    """Period of a date text by its year."""
    year = F.when(day.rlike(r"^\d{4}"), F.substring(day, 1, 4)).cast("int")
    return F.when(year.isNull(), "sem_data").when(year <= 2017, "<=2017").when(year <= 2022, "2018-2022").otherwise(">=2023")


def hits(c: Column, listed: list[str]) -> Column:
    return F.regexp_count(plain(c), F.lit(r"\b(?:" + "|".join(listed) + r")\b"))


def style(text: Column) -> Column:
    """Struct of rates: exclamations, questions, ellipses per word, share of capital words, log length, urgency per 100 words, polarity."""
    n = F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"))
    words = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, n).otherwise(0)
    count = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    pos, neg = hits(text, POSITIVE), hits(text, NEGATIVE)
    return F.struct(
        (count("!") / (words + 1)).alias("excl"), (count(r"\?") / (words + 1)).alias("quest"), (count(r"\.\.\.|…") / (words + 1)).alias("ellip"),
        F.log1p(words.cast("double")).alias("log_len"), (100 * hits(text, URGENT) / F.greatest(words, F.lit(1))).alias("urgency"), ((pos - neg) / (pos + neg + 1e-5)).alias("polarity"),
    )


def redacted(c: Column) -> Column:
    """E-mail addresses, phone numbers and bearer tokens replaced by their kind."""
    out = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]")
    out = F.regexp_replace(out, r"\(\d{2}\) ?\d{4,5}-\d{4}", "[telefone]")
    return F.regexp_replace(out, r"(?i)bearer [A-Za-z0-9._-]+", "[token]")


def digest(c: Column) -> Column:
    """First twelve hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)


def chunks(c: Column, size: int = 192, most: int = 4) -> Column:
    """Blocks of ``size`` words, at most ``most``."""
    def blocks(w: Column) -> Column:
        return F.slice(F.transform(F.sequence(F.lit(1), F.size(w), F.lit(size)), lambda i: F.array_join(F.slice(w, i, size), " ")), 1, most)

    return F.element_at(F.transform(F.array(F.split(F.trim(c), r"\s+")), blocks), 1)
