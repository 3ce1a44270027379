"""Raw date texts to UTC instants, without Python workers.

``parse_raw`` reads one text column into a struct of calendar fields and zone marks; ``to_instant`` turns the struct into
whole seconds since 1970-01-01 UTC; ``estimate_zones`` finds the zone of sites that name none, by aligning their local
times with the moments at which the rows were ingested.

Defined results for odd input: null, blank, relative phrases, bare years, impossible calendar dates (31 February), and the
years 0, 1 and 1970 give null. A site without a known or estimable zone gives null for values that carry no zone of their
own. Repeated local hours mean the earlier instant; skipped local times move forward by the gap. Repeated rows are parsed
alike; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month names of Portuguese, Spanish and English by their first three letters.
MONTHS = {
    "jan": 1, "ene": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12, "dic": 12,
}
# Zone abbreviations as fixed offsets in seconds.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "brt": -10800, "brst": -7200, "est": -18000, "edt": -14400,
    "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200, "cet": 3600, "cest": 7200,
    "amt": -14400, "art": -10800, "clt": -14400,
}
BRASILIA = "America/Sao_Paulo"
PLACEHOLDER_YEARS = (0, 1, 1970)

_DOW = r"(?:(?:seg|ter|qua|qui|sex|s[aá]b|dom|mon|tue|wed|thu|fri|sat|sun|lun|mi[eé]|jue|vie)[a-zçáéó]*\.?(?:-feira)?,?\s+)?"
_MONTH = r"(jan|fev|feb|mar|abr|apr|mai|may|jun|jul|ago|aug|set|sep|out|oct|nov|dez|dec|ene|dic)[a-zç]*\.?"
_TIME = r"(?:\s*(?:,|-|–|—|\bàs\b|\bas\b|\bat\b|t|\|)?\s*(\d{1,2})\s*(?::|h)\s*(\d{2})?(?:\s*(?::|m|min)\s*(\d{2})\s*s?)?(?:min|m)?(?:[.,]\d+)?\s*(a\.?m\.?|p\.?m\.?)?)?"
_ZONE = r"\s*(?:\(?\s*((?:hor[aá]rio de |hora de )?bras[ií]lia|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|z|utc|gmt|west|wet|brst|brt|edt|est|cst|cdt|mst|mdt|pst|pdt|cest|cet|amt|art|clt)\s*\)?)?$"
#: form -> pattern and the numbers of its groups in the order: three of the date, hour, minute, second, half of day, zone.
_IN_ORDER = (1, 2, 3, 4, 5, 6, 7, 8)
_REWRITES = {
    "epoch": (r"^(\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.\d+)?$", (1,)),
    "ymd": (r"^" + _DOW + r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + _ZONE, _IN_ORDER),
    "num": (r"^" + _DOW + r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TIME + _ZONE, _IN_ORDER),
    "dmy": (r"^" + _DOW + r"(\d{1,2})[ºo°]?\s*(?:de\s+|[-/ ])?\s*" + _MONTH + r"\s*(?:de\s+|del\s+|[-/ ,])?\s*(\d{4})" + _TIME + _ZONE, _IN_ORDER),
    "mdy": (r"^" + _DOW + _MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TIME + _ZONE, _IN_ORDER),
    "ymd ": (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?(z|[+-]\d{2}:?\d{2})?)?$", (1, 2, 3, 4, 5, 6, 0, 7)),
}


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic alone (no exception on odd input)."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(shifted / 400)
    of_era = shifted - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def _valid(y: Column, m: Column, d: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= last) & ~y.isin(*PLACEHOLDER_YEARS)


def _captured(text: Column) -> Column:
    """The text's kind and its groups as an array of strings; a text of no known form gives an array of another length.

    Each form rewrites a text that it matches whole into its name and groups; a rewritten text matches no other form, so the
    chain costs one pass of each regular expression and stays within generated code.
    """
    mark = "\u0001"
    out = F.regexp_replace(text, mark, " ")
    for name, (pattern, order) in _REWRITES.items():
        out = F.regexp_replace(out, pattern, mark.join([name, *(f"${i}" if i else "" for i in order)]))
    return F.split(out, mark)


def parse_raw(raw: Column, order: Column | None = None) -> Column:
    """Struct of what a raw date text says.

    epoch: seconds where the text is a number of seconds, milli-, micro- or nanoseconds; local: wall-clock seconds (as if
    UTC); offset: seconds east of UTC where the text gives one; zone: a named zone where the text gives one. ``order`` is
    'dma' (day first, the default) or 'mda'. Everything is null where the text denotes no instant and no day.
    """
    text = F.trim(F.regexp_replace(F.lower(raw), r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{FEFF}]+", " "))
    day_first = F.lit(True) if order is None else F.coalesce(order, F.lit("dma")) != "mda"
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    offset_of = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])

    def number(c: Column) -> Column:
        return F.when(c.rlike(r"^\d+$"), c).cast("int")

    # Each step binds its results once (in a one-element array), so that no regular expression is repeated where they are used.
    def groups(g: Column) -> Column:
        k = F.trim(F.coalesce(F.get(g, 0), F.lit("")))
        texts = [F.coalesce(F.get(g, i), F.lit("")) for i in range(1, 9)]
        numbers = [F.when(k != "epoch", number(c)).alias(f"n{i}") for i, c in enumerate(texts[:6], 1)]
        return F.struct(k.alias("k"), *numbers, *(c.alias(f"t{i}") for i, c in enumerate(texts, 1)))

    def calendar(g: Column) -> Column:
        k, one, two, three = g["k"], g["n1"], g["n2"], g["n3"]
        year = F.when(k == "ymd", one).when(F.length(g["t3"]) == 2, three + 2000).otherwise(three)
        # The site's order rules; only where it makes no date at all is the other order taken.
        first_is_day = F.when(day_first, two <= 12).otherwise(one > 12)
        month = F.when(k == "ymd", two).when(k == "num", F.when(first_is_day, two).otherwise(one)).when(k == "dmy", F.try_element_at(month_of, F.substring(g["t2"], 1, 3))).when(k == "mdy", F.try_element_at(month_of, F.substring(g["t1"], 1, 3)))
        day = F.when(k == "ymd", three).when(k == "num", F.when(first_is_day, one).otherwise(two)).when(k == "dmy", one).when(k == "mdy", two)
        half, hour, zone = F.substring(g["t7"], 1, 1), F.coalesce(g["n4"], F.lit(0)), F.trim(g["t8"])
        hour = F.when(half == "a", hour % 12).when(half == "p", hour % 12 + 12).otherwise(hour)
        hours = F.regexp_extract(zone, r"([+-]\d{1,2}):?(\d{2})?$", 1)
        minutes = F.coalesce(number(F.regexp_extract(zone, r"[+-]\d{1,2}:?(\d{2})$", 1)), F.lit(0))
        by_digits = F.when(hours.startswith("-"), -1).otherwise(1) * (number(F.substring(hours, 2, 2)) * 3600 + minutes * 60)
        offset = F.when(hours != "", by_digits).when(zone != "", F.try_element_at(offset_of, zone))
        named = F.when(zone.rlike(r"bras[ií]lia$"), F.lit(BRASILIA))
        digits = F.when(k == "epoch", F.when(F.length(g["t1"]) <= 10, g["t1"]).otherwise(F.substring(g["t1"], 1, 10))).cast("long")
        time = [c.alias(n) for c, n in ((hour, "h"), (F.coalesce(g["n5"], F.lit(0)), "mi"), (F.coalesce(g["n6"], F.lit(0)), "s"))]
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), *time, offset.cast("int").alias("offset"), named.alias("zone"), digits.alias("epoch"))

    def result(c: Column) -> Column:
        good = _valid(c["y"], c["m"], c["d"]) & (c["h"] < 24) & (c["mi"] < 60) & (c["s"] <= 60)
        local = F.when(good, _days(c["y"], c["m"], c["d"]) * 86400 + c["h"] * 3600 + c["mi"] * 60 + c["s"])
        # 1970 is a placeholder year, so the first 365 days of the count are no instants.
        epoch = F.when(c["epoch"] >= 365 * 86400, c["epoch"])
        return F.struct(epoch.alias("epoch"), local.alias("local"), c["offset"].alias("offset"), c["zone"].alias("zone"))

    steps = F.array(_captured(text))
    for step in (groups, calendar, result):
        steps = F.transform(steps, step)
    return F.element_at(steps, 1)


def to_instant(parsed: Column, site_zone: Column) -> Column:
    """Whole seconds since 1970-01-01 UTC of a parsed value; ``site_zone`` (IANA) serves values that carry no zone."""
    zone = F.coalesce(parsed["zone"], site_zone)
    by_zone = F.when(zone.isNotNull(), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(parsed["local"]), zone)))
    return F.coalesce(parsed["epoch"], F.when(parsed["offset"].isNotNull(), parsed["local"] - parsed["offset"]).otherwise(by_zone))


def estimate_zones(df: DataFrame, site: str, local: str, ingested: str, zones: list[str], slack: float = 0.01) -> DataFrame:
    """One row per site with the zone whose offset history breaks least: (site, zone, violations, n).

    A row breaks a zone where its local time, read in that zone, lies after the moment of its ingestion. Zones further east
    break ever less, so of all zones within ``slack`` (a share of the rows) of the fewest violations the one that leaves the
    smallest mean delay before ingestion is taken, then the first by name. Rows with a null site, local time or
    ingestion time say nothing. ``local`` holds wall-clock seconds, ``ingested`` seconds UTC. The candidate list is exploded
    but summed before the shuffle, so what moves is one row per site and zone and task.
    """
    known = df.where(F.col(site).isNotNull() & F.col(local).isNotNull() & F.col(ingested).isNotNull())
    tried = known.select(F.col(site).alias("site"), F.col(local).alias("l"), F.col(ingested).alias("i"), F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    delay = F.col("i") - F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("l"), F.col("zone")))
    scored = tried.select("site", "zone", delay.alias("delay")).groupBy("site", "zone").agg(F.sum(F.when(F.col("delay") < 0, 1).otherwise(0)).alias("violations"), F.avg(F.when(F.col("delay") >= 0, F.col("delay"))).alias("lag"), F.count("*").alias("n"))
    least = scored.withColumn("_least", F.min("violations").over(Window.partitionBy("site"))).where(F.col("violations") <= F.col("_least") + F.col("n") * slack)
    best = F.min(F.struct(F.coalesce("lag", F.lit(1e18)).alias("lag"), "zone", "violations", "n")).alias("b")
    return least.groupBy("site").agg(best).select("site", "b.zone", "b.violations", "b.n")


def sequence_violations(df: DataFrame, site: str, instant: str, order: str) -> DataFrame:
    """Rows per site whose instant lies before that of the row delivered before them: how far a site's zone is from its order."""
    w = Window.partitionBy(site).orderBy(order)
    steps = df.where(F.col(site).isNotNull() & F.col(instant).isNotNull()).withColumn("_before", F.lag(instant).over(w))
    return steps.groupBy(site).agg(F.sum(F.when(F.col(instant) < F.col("_before"), 1).otherwise(0)).alias("violations"), F.count("*").alias("n"))


def normalise(df: DataFrame, raw: str, zone: str | None = None, order: str | None = None, into: str = "instante_utc_s") -> DataFrame:
    """``df`` with one more column, the instant of ``raw`` in seconds UTC; a column of that name is replaced."""
    parsed = parse_raw(F.col(raw), F.col(order) if order else None)
    site = F.col(zone) if zone else F.lit(None).cast("string")
    return df.withColumn(into, F.element_at(F.transform(F.array(parsed), lambda p: to_instant(p, site)), 1))
