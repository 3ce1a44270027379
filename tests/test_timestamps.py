from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lastro.operators import timestamps as ts

SP = "America/Sao_Paulo"


def utc(*a) -> int:
    return int(datetime(*a, tzinfo=UTC).timestamp())


CASES = [
    ("2018/09/28 19:24:06.567", SP, "dma", utc(2018, 9, 28, 22, 24, 6)),
    ("Sat, 06 Dec 2014 04:56:41 -0200", SP, "dma", utc(2014, 12, 6, 6, 56, 41)),
    ("24 Jun 2019 15:50:01 EST", SP, "dma", utc(2019, 6, 24, 20, 50, 1)),
    ("1442395582", SP, "dma", 1442395582), ("1742789977408", SP, "dma", 1742789977), ("1340093499149718", SP, "dma", 1340093499), ("1340093499149718123", SP, "dma", 1340093499),
    ("20220826T192601Z", SP, "dma", utc(2022, 8, 26, 19, 26, 1)), ("20150327", "Europe/Lisbon", "dma", utc(2015, 3, 27)),
    ("03/04/2020 10:00", SP, "dma", utc(2020, 4, 3, 13)), ("03/04/2020 10:00", "America/New_York", "mda", utc(2020, 3, 4, 15)),
    ("16/01/2017 0h29", "America/New_York", "mda", utc(2017, 1, 16, 5, 29)), ("04/05/22 01:38", SP, "dma", utc(2022, 5, 4, 4, 38)),
    ("10/16/2023 12:17 AM", "America/New_York", "mda", utc(2023, 10, 16, 4, 17)), ("November 13, 2020 12:09 PM", "America/New_York", "mda", utc(2020, 11, 13, 17, 9)),
    ("domingo, 22 de janeiro de 2023 às 09h31 (horário de Brasília)", "Europe/Lisbon", "dma", utc(2023, 1, 22, 12, 31)),
    ("1º de ago. de 2025 - 02h23 (BRT)", "Europe/Lisbon", "dma", utc(2025, 8, 1, 5, 23)), ("30 out 2016 - 04h12 WEST", SP, "dma", utc(2016, 10, 30, 3, 12)),
    ("2014-08-15T15:14+05:30", SP, "dma", utc(2014, 8, 15, 9, 44)), ("2024-04-23 09:57:39-03", SP, "dma", utc(2024, 4, 23, 12, 57, 39)),
    ("2018-02-17T23:30:00", SP, "dma", utc(2018, 2, 18, 1, 30)),  # a repeated hour: the earlier instant
    ("2018-11-04", SP, "dma", utc(2018, 11, 4, 3)),  # a skipped midnight: moved forward by the gap
    ("2021-03-28 01:30", "Europe/Lisbon", "dma", utc(2021, 3, 28, 1, 30)),
    *[(x, SP, "dma", None) for x in (None, "", "  ", "2024", "1", "ontem", "há 3 dias", "11 days ago", "sem data", "null", "0001-01-01T00:00:00", "0000-00-00 00:00:00", "1970-01-01", "0", "31/02/2020", "2020-13-40")],
]


def test_forms(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, raw string, fuso string, ordem string, want long")
    got = {r["i"]: (r["instante_utc_s"], r["want"], r["raw"]) for r in ts.normalise(df, "raw", "fuso", "ordem").collect()}
    assert [x for x in got.values() if x[0] != x[1]] == []


def test_no_zone_no_instant_and_clashing_names(spark):
    df = spark.createDataFrame([("2020-01-01", 5), ("2020-01-01T00:00:00Z", 6)], "raw string, instante_utc_s int")
    assert [r["instante_utc_s"] for r in ts.normalise(df, "raw").collect()] == [None, utc(2020, 1, 1)]
    assert ts.normalise(df.limit(0), "raw").count() == 0


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "Europe/Lisbon", "America/New_York"])
def test_zone_is_found_from_ingestion(spark, zone):
    rows = []
    for i in range(400):
        at = datetime(2018, 1, 5, tzinfo=UTC) + timedelta(hours=37 * i, minutes=7 * i)
        local = at.astimezone(ZoneInfo(zone)).replace(tzinfo=UTC)
        rows.append(("s", int(local.timestamp()), int(at.timestamp()) + 60 + (i * 613) % 1500))
    df = spark.createDataFrame([*rows, (None, 1, 1), ("s", None, 1)], "site string, local long, em long")
    got = ts.estimate_zones(df, "site", "local", "em", ["America/Sao_Paulo", "Europe/Lisbon", "America/New_York", "Africa/Luanda"]).collect()
    assert [(r["site"], r["zone"], r["violations"]) for r in got] == [("s", zone, 0)]
    assert ts.sequence_violations(df.where("site = 's'").withColumn("x", F.col("em")), "site", "x", "local").count() == 1
