from __future__ import annotations

import json
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lastro.functions import claims as c
from lastro.functions import normalise as n
from lastro.functions import urls as u
from lastro.operators import evidence as ev
from lastro.operators import graph
from lastro.operators import metrics as m
from lastro.operators import near_duplicates as nd
from lastro.operators import registry as rg
from lastro.sources import feeds, files
from lastro.streaming import events as st


def test_components_against_union_find(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200)] + [(300, 300 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and got[102] == 100 and {got[300 + i] for i in range(1, 60)} == {300} and 200 not in got
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    base = [f"w{i} x{i} y{i} z{i} the report of day {i} says that item {i * 7} grew by {i} points in town number {i} last year alone" for i in range(25)]
    near = [b + " indeed" for b in base[:10]]
    texts = [*base, *near, *base[:5], "", None, "a b", "a b"]
    got = {r["id"]: r["cluster"] for r in nd.clusters(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()}
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts) if t}
    for i, j in combinations([i for i in grams if grams[i]], 2):
        same = len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8
        assert (got[i] == got[j]) == same
    assert got[42] == got[43] and 40 not in got and 41 not in got


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.9, 1, "a"), (0.9, 0, "a"), (0.1, 0, "a"), (None, 1, "a"), (0.7, 1, "b")], "p double, y int, g string")
    got = {r["g"]: r["auc"] for r in m.auc(df, "p", "y", ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}
    assert m.classification(df.limit(0), "p", "y").count() == 0
    row = spark.range(1).select(m.wilson(F.lit(0), F.lit(0)).alias("w"), m.mcnemar(F.lit(0), F.lit(0)).alias("p0"), m.mcnemar(F.lit(1), F.lit(9)).alias("p1")).first()
    assert row["w"] is None and row["p0"] == 1.0 and abs(row["p1"] - 22 / 1024) < 1e-9


def test_decision_rules(spark):
    schema = "consulta_id int, afirmacao int, cluster_ind string, classe string, motor string, curada boolean, corpo_lido boolean, veredito string, origem_veredito string, confiabilidade string, prob_fake_pagina double, agencia boolean, excess int"
    rows = [
        (1, 0, "a", "REFUTA", "x", True, True, None, None, "curada", None, True, None),
        (1, 0, "b", "SUSTENTA", "x", False, True, None, None, "alto_trafego", None, False, None),  # muted by the agency
        (2, 0, "a", "REFUTA", "fallback-r", True, True, None, None, "curada", None, True, None),
        (3, 0, "a", "SUSTENTA", "x", False, True, None, None, "curada", 1.0, False, None),  # nothing left of it
        (4, 0, "a", "REFUTA", "x", False, False, None, None, "curada", None, True, None),
        (5, 0, "a", "REFUTA", "x", True, True, None, None, "curada", None, True, None),
        (5, 0, "b", "SUSTENTA", "x", False, True, None, None, "alto_trafego", None, True, None),  # an agency that is not curated is muted as well
        (6, 0, "a", "REFUTA", "x", False, True, "falso", None, "plataforma", None, False, None),
        (6, 0, "b", "REFUTA", "x", False, True, "falso", None, "plataforma", None, False, None),  # strong, but no reliable source
    ]
    got = {r["consulta_id"]: (r["log_odds"], r["nivel"]) for r in ev.decide(spark.createDataFrame(rows, schema).withColumn("url", F.lit("u")).withColumn("window", F.lit(15))).collect()}
    assert got == {1: (1.5, "alta"), 2: (None, "indeterminada"), 3: (None, "indeterminada"), 4: (None, "indeterminada"), 5: (1.5, "alta"), 6: (0.99 * ev.TAU, "media")}
    low = spark.createDataFrame([("alta", "media"), ("alta", "baixa"), ("media", "alta"), ("media", "indeterminada")], "a string, b string")
    assert [r[0] for r in low.select(ev.lowered(F.col("a"), F.col("b"))).collect()] == ["media", "alta", "media", "indeterminada"]
    late = spark.range(1).select(ev.discounted(F.lit(1.5), F.lit(15), F.lit(15)).alias("a"), ev.discounted(F.lit(1.5), F.lit(15), F.lit(None).cast("int")).alias("b"), ev.discounted(F.lit(-1.5), F.lit(2), F.lit(4000)).alias("c")).first()
    assert 0 < late["a"] < 1.5 and late["b"] == 1.5 and late["c"] is None


def test_upsert_precedence(spark):
    old = spark.createDataFrame([("a", "manual", 1), ("b", "x", 2), ("c", "x", 3)], "k string, o string, v int")
    new = spark.createDataFrame([("a", "y", 9), ("b", "y", 9), ("d", "y", 4)], "k string, o string, v int")
    got = {r["k"]: r["v"] for r in rg.upsert(old, new, ["k"], F.col("o_o") != "manual", spark.createDataFrame([("c",)], "k string")).collect()}
    assert got == {"a": 1, "b": 9, "d": 4}
    assert rg.upsert(old.limit(0), new, ["k"], F.lit(True)).count() == 3


def test_text_and_urls(spark):
    row = spark.range(1).select(
        n.plain(F.lit("Ação—É  “ok”!")).alias("a"), n.plain(F.lit(None).cast("string")).alias("b"), F.size(n.word_shingles(F.lit("a b c d"))).alias("c"),
        u.canonical(F.lit("HTTP://www.Site.example/a/b/?utm_source=x&b=2&a=1#t")).alias("d"), u.registrable(F.lit("https://x.y.com.br/z")).alias("e"), u.canonical(F.lit("nada")).alias("f"), n.redacted(F.lit("a@b.example (11) 90000-1234")).alias("g"),
    ).first()
    assert tuple(row) == ("acao e ok", "", 0, "https://site.example/a/b?a=1&b=2", "y.com.br", None, "[email] [telefone]")


def test_json_titles_numbers(spark):
    html = '<head><meta property="og:title" content="Do &amp; grafo"><title>T</title></head><h1>H</h1>'
    row = spark.range(1).select(
        c.first_json(F.lit('x {y} z {"a":3} {b}'), "a int")["a"].alias("a"), c.first_json(F.lit("nada"), "a int").alias("b"), c.page_title(F.lit(html)).alias("c"), c.page_title(F.lit("<h1>So <b>h</b></h1>")).alias("d"),
        n.numbers(F.lit("CR7 gastou 7 ou 62, em 2020-11 5G")).alias("e"), n.content_tokens(F.lit("É falso que o 5G dá câncer em 3 dias")).alias("f"), u.canonical(F.lit("https://m.com/x")).alias("g"), u.canonical(F.lit("https://m.site.example/x")).alias("h"),
    ).first()
    assert tuple(row) == (3, None, "Do & grafo", "So h", ["7", "62", "2020"], ["5g", "cancer", "dias"], "https://m.com/x", "https://site.example/x")


def test_platt_and_running_sums(spark):
    import math

    rows = [(z / 10, int((z * 7919) % 10 < 3 + z / 4)) for z in range(-30, 31)]
    df = spark.createDataFrame([(z, y, "a") for z, y in rows] + [(0.0, None, "a"), (1.0, 1, None)], "z double, y int, g string")
    a, b = m.platt(df.where("g = 'a'"), "z", "y")
    p = [1 / (1 + math.exp(-(a * z + b))) for z, _ in rows]
    assert abs(sum(y - q for (_, y), q in zip(rows, p, strict=True))) < 1e-4 and abs(sum((y - q) * z for (z, y), q in zip(rows, p, strict=True))) < 1e-4
    assert m.platt(df.limit(0), "z", "y") == (0.0, 0.0)
    pairs = [(s, t) for s, y in rows if y for t, x in rows if not x]
    want = sum((s > t) + 0.5 * (s == t) for s, t in pairs) / len(pairs)
    got = {r["g"]: r["auc"] for r in m.auc(df, "z", "y", ["g"]).collect()}
    assert abs(got["a"] - want) < 1e-9 and None in got


def test_feeds_posts_sitemaps(spark):
    rss = '<rss xmlns:c="u"><channel><item><title>A &amp; B</title><link>https://x.example/1</link><category>c1</category><c:encoded>t</c:encoded></item><item><title>quebrado & solto</title><guid>g2</guid></item>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="s"/><link rel="alternate" href="https://x.example/2"/><updated>2020-01-01</updated></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, "lixo")], "id int, raw string")
    got = [(r["id"], r["titulo"], r["link"]) for r in feeds.parse_feeds(df, "raw", ["id"]).orderBy("id", "link").collect()]
    assert sorted(got) == [(1, "A & B", "https://x.example/1"), (1, "quebrado & solto", "g2"), (2, "T", "https://x.example/2")]
    assert feeds.feed_items('<!DOCTYPE x [<!ENTITY e "v">]><rss><channel><item><title>&e;</title></item></channel></rss>') == []
    posts = spark.createDataFrame([(1, json.dumps([{"title": {"rendered": "x"}, "link": "l", "date": "d"}])), (2, '{"code": 1}'), (3, None)], "id int, raw string")
    assert [tuple(r)[:4] for r in feeds.parse_posts(posts, "raw", ["id"]).collect()] == [(1, "x", "l", "d")]
    maps = spark.createDataFrame([("<urlset><url><loc> https://x.example/a </loc><lastmod>2020-02-03T00:00</lastmod></url><url><loc></loc></url></urlset>",), ("<sitemapindex><sitemap><loc>b</loc></sitemap></sitemapindex>",), (None,)], "raw string")
    assert sorted(tuple(r) for r in feeds.parse_sitemaps(maps, "raw", []).collect()) == [("indice", "b", None), ("urlset", "https://x.example/a", "2020-02-03")]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "é"), (3, None)], "id int, t string")
    files.write_jsonl(df, str(tmp_path / "x"), ["id"])
    back = files.read_jsonl(spark, str(tmp_path / "x"), "id int, t string")
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, "é"), (2, "b"), (3, None)]
    assert files.read_jsonl(spark, str(tmp_path / "nada"), "id int").count() == 0


def test_sources_of_ranks_pools_requests(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,A.example\n2, b.example\n9,c.example\n")
    assert [tuple(r) for r in files.read_ranks(spark, str(tmp_path / "r.csv"), 2).orderBy("posicao").collect()] == [("a.example", 1), ("b.example", 2)]
    spark.createDataFrame([(1, "x"), (2, "y")], "rid int, t string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, "train"), (1, "train")], "rid int, lado string").write.parquet(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in files.read_pool(spark, str(tmp_path / "p"), str(tmp_path / "s")).collect()) == [(1, "x", "train"), (2, "y", None)]
    asked = spark.createDataFrame([("get", "https://a.example/x?b=2&a=1&token=s#f", None), ("GET", "https://a.example/x?a=1&b=2&token=t", None), ("GET", "https://a.example/x?a=1", "c")], "m string, u string, b string")
    keys = [r[0] for r in asked.select(files.cassette_key("m", "u", "b")).collect()]
    assert keys[0] == keys[1] != keys[2]
    html = spark.createDataFrame([('<link rel="alternate" type="application/rss+xml" href="/f"><link type="application/atom+xml" href="/g"><link href="/f" type="application/rss+xml">',), (None,)], "h string")
    assert [r[0] for r in html.select(feeds.feed_links("h")).collect()] == [["/f", "/g"], None]


def test_stream_merge_is_idempotent(spark, tmp_path):
    run = st.merging(str(tmp_path / "t"), ["k"], lambda old, new: rg.upsert(old, new, ["k"], F.lit(True)))
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    run(one, 0)
    run(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), 1)
    run(one, 1)  # the batch comes again under a number already done
    assert st.versions(spark, str(tmp_path / "t")) == [0, 1]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_stream_windows(spark, sf, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    q = st.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()
    finally:
        q.stop()


def test_stream_limiter(spark, tmp_path):
    base = [(i, "ab"[i % 2], 1_700_000_000 + 10 * i) for i in range(12)]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(base, "id int, k string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(source)
    q = st.limited(spark.readStream.schema(df.schema).parquet(source), "k", "id", "ts", 2, 50).writeStream.format("memory").queryName("lim").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {r["id"]: r["passa"] for r in spark.sql("SELECT * FROM lim").collect()}
    finally:
        q.stop()
    want = {}
    for k in "ab":
        passed = []
        for i, key, t in base:
            if key == k:
                passed = [p for p in passed if p > t - 50]
                want[i] = len(passed) < 2
                passed += [t] if want[i] else []
    assert got == want


def _shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize(("plan", "name"), [("records", "i24_recall"), ("evidence", "j02_bm25_plus"), ("evidence", "j01_bm25")])
def test_search_moves_no_pairs(spark, tmp_path, plan, name):
    """As SQL, on records that share words with all others, in several blocks, with ties, empty fields and words of most records."""
    import importlib
    import random

    import duckdb
    import pandas as pd
    from conftest import rows_of

    rnd = random.Random(7)
    vocabulary = [f"palavra{i}" for i in range(40)]
    text = lambda n: " ".join(["comum", *rnd.choices(vocabulary, k=n)])
    rows = []
    for i in range(1, 2001):
        title, claim, excerpt = f"{text(6)} {rnd.choice(['', '12', '2019', '350'])}", rnd.choice([None, text(5)]), rnd.choice([None, "", f"{text(8)}. {text(9).capitalize()} 12."])
        rows.append((i, *rows[-1][1:]) if i % 9 == 0 else (i, title, claim, excerpt))
    rows[19] = (20, None, None, None)
    rows[39] = (40, "", "", "")
    t = pd.DataFrame(rows, columns=["checagem_id", "titulo", "afirmacao_checada", "trecho"])
    t.to_parquet(tmp_path / "checagens.parquet", index=False)
    module = importlib.import_module(f"lastro.plans.{plan}")
    con = duckdb.connect()
    con.register("checagens", t)
    before = _shuffled(spark)
    got = module.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert _shuffled(spark) - before < 100 * 2000 / 2  # half a row per pair of query and record
    want = con.execute(module.SQL[name]).df()
    assert len(want) and rows_of(got) == rows_of(want)


def test_bm25_plus_reads_whole_excerpts(spark, tmp_path):
    """A word behind any number of others in an excerpt finds its record and counts; as SQL without a cut of excerpts."""
    import duckdb
    import pandas as pd
    from conftest import rows_of
    from lastro.plans import evidence

    filler = " ".join(f"palavra{i}" for i in range(300))
    rows = [(20, "tesouro enterrado", None, None), (40, "palavra7 cofre", "", ""), (41, "outro assunto", "assunto", f"{filler} tesouro"), (42, "mais outro", None, f"{filler} palavra7 {filler}"), (43, "enterrado", None, "palavra7")]
    t = pd.DataFrame(rows, columns=["checagem_id", "titulo", "afirmacao_checada", "trecho"])
    t.to_parquet(tmp_path / "checagens.parquet", index=False)
    con = duckdb.connect()
    con.register("checagens", t)
    got = evidence.QUERIES["j02_bm25_plus"](spark, str(tmp_path)).toPandas()
    assert 41 in set(got[got["query"] == 20]["doc"])
    assert rows_of(got) == rows_of(con.execute(evidence.SQL["j02_bm25_plus"].replace("[1:80]", "")).df())
