"""Corpus operators: brute force, round trips and held-out accuracy on small fixtures; nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lastro.llm import boilerplate, encoding, history, lines, mixing, overlap, packing, queries, segments, splits, truncation


def rnd(seed: int) -> random.Random:
    return random.Random(seed)


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "se", "ta", "vo", "ze") for b in ("na", "pe", "ri", "so", "tu", "xa", "bel", "dor")]


def edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a: list, b: list) -> bool:
    return edits(a, b) <= max(len(a), len(b)) // 10


def varied(seed: int, n: int = 60) -> list[str]:
    """Texts of many lengths with variants that differ by insertions, drops and replacements, some just beyond the bound."""
    r, out = rnd(seed), []
    for _ in range(n):
        w = [r.choice(WORDS) for _ in range(r.choice([3, 8, 9, 10, 11, 19, 20, 21, 35, 60, 101]))]
        out.append(w)
        v = list(w)
        for _ in range(r.randint(0, len(w) // 10 + 1)):
            k = r.randrange(max(1, len(v)))
            kind = r.random()
            if kind < 0.33 and len(v) > 1:
                del v[k]
            elif kind < 0.66:
                v.insert(k, r.choice(WORDS))
            else:
                v[k] = r.choice(WORDS)
        out.append(v)
    return [" ".join(x) for x in out]


# 1 ----------------------------------------------------------------------------------------------------------------------


def test_components_and_sides(spark):
    rows = [(i, f"a{i % 40}" if i % 3 else None, -1 if i % 2 else i // 7, "x") for i in range(600)] + [(5, "a5", -1, "x"), (None, "a1", 1, "x")]
    df = spark.createDataFrame(rows, "id int, autor string, grupo int, component string")
    members = splits.components(df, "id", ["autor", "grupo"])
    got = {r["id"]: r["component"] for r in members.collect()}
    assert set(got) == set(range(600))
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for col in (1, 2):
        first: dict = {}
        for row in rows:
            if row[0] is not None and row[col] not in (None, -1):
                parent[root(row[0])] = root(first.setdefault(row[col], row[0]))
    for i, j in combinations(range(0, 600, 7), 2):
        assert (got[i] == got[j]) == (root(i) == root(j))
    sides = {r["id"]: r["side"] for r in splits.assign(members, {"train": 0.8, "test": 0.2}, bins=10).collect()}
    assert all(sides[i] == sides[j] for i, j in combinations(range(0, 600, 7), 2) if got[i] == got[j])


def test_a_rid_of_two_clusters_lends_each_its_own_sides(spark, tmp_path):
    rows = [(1, "train", "train", 7), (1, "test", "test", 8), (2, "train", "train", 7), (3, "test", "train", 8), (4, "train", "train", -1), (4, "test", "test", None)]
    spark.createDataFrame(rows, "rid long, split_bal_iid string, split_ood_wa string, near_dup_cluster int").write.parquet(f"{tmp_path}/v6_splits.parquet")
    assert [tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()] == [(8, "split_ood_wa")]


def test_sides_are_near_their_shares(spark):
    df = spark.createDataFrame([(i, min(i % 300, i // 5)) for i in range(4000)], "id int, g int")
    out = splits.assign(splits.components(df, "id", ["g"]), {"train": 0.7, "val": 0.1, "test": 0.2}, shard_rows=200)
    share = {r["side"]: r["n"] / 4000 for r in out.groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["val"] - 0.1) < 0.02 and abs(share["test"] - 0.2) < 0.02
    assert splits.assign(splits.components(df.limit(0), "id", ["g"]), {"a": 1.0}).count() == 0


def test_largest_differencing_levels_bins():
    r = rnd(3)
    weights = [(r.randint(1, 50), i) for i in range(300)]
    keys, sums = splits.largest_differencing(weights, 8)
    assert sorted(k for b in keys for k in b) == list(range(300)) and max(sums) - min(sums) <= 2 and sum(sums) == sum(w for w, _ in weights)


# 2 ----------------------------------------------------------------------------------------------------------------------

SOUND = ["não", "educação", "água", "famílias", "É verdade", "pressão", "fração", "memória", "conteúdo", "período", "às vésperas", "“sim”", "pública", "três", "saúde", "pré-escola", "ônibus", "único", "Último", "atenção"]


def test_chains_round_trip():
    for chain in encoding.CHAINS:
        for w in SOUND:
            g = encoding.garble(w, chain)
            if g is not None and g != w:
                back = encoding.invert(g, chain)
                assert back == w, (chain, w, g, back)


def test_encoding_held_out(spark):
    train = spark.createDataFrame([(i, " ".join(SOUND)) for i in range(50)], "id int, t string")
    model = encoding.fit(train, "t")
    held = ["situação", "português", "crônica", "médico", "alguém", "também", "código", "avós", "céu azul", "raízes"]
    wrong = [(w, c) for w in held for c in ("utf8>cp1252", "utf8>latin1", "utf8>cp850", "utf8>mac_roman", "cp1252>cp850", "utf8>cp1252 x2") if (g := encoding.garble(w, c)) not in (None, w) and model.judge(g)[1] != w]
    assert len(wrong) <= 6, wrong
    sound = [*held, "Ångria", "naïve", "Ørland", "SÃO", "AÇÃO", "Þórvald", "½", "£ 5", "plain", "caf&eacute;", "🙏", "Дробнюк"]
    assert [w for w in sound if model.judge(w)[0] != "sound"] == []
    assert model.judge("In" + chr(0xFFFD) + "cio")[0] == "lost"
    df = spark.createDataFrame([(1, "a", "texto " * 20000 + encoding.garble("situação", "utf8>cp1252")), (2, "b", None), (3, "c", ""), (4, "d", "situação sã")], "id int, texto string, t string")
    assert [r["id"] for r in encoding.judged(df, ["id"], "t", model).collect()] == [1]
    assert model.of_record([encoding.garble(w, "utf8>cp850") for w in ("situação", "também", "código")]) == "utf8>cp850" and model.of_record(["plain"]) == ""
    done = {r["id"]: r for r in encoding.restored(df, ["id"], "t", model).collect()}
    assert done[1]["texto"].endswith("situação") and not done[4]["mudou"] and set(done) == {1, 3, 4}


def test_garbled_words_of_sound_signs_are_restored(spark):
    words = [*SOUND, "história", "política", "vitória", "dívida", "está", "– Este", "· Mapa"]
    model = encoding.fit(spark.createDataFrame([(i, " ".join(words)) for i in range(50)], "id int, t string"), "t")
    cases = [("– Casa", "utf8>cp1252"), ("— Casa", "utf8>cp1252"), ("’", "utf8>cp1252"), ("é jornalista", "utf8>latin1"), ("política", "mac_roman>cp1252"), ("história", "mac_roman>cp1252"), ("dívida", "mac_roman>cp1252"), ("está", "cp1252>mac_roman")]
    assert [(w, c) for w, c in cases if model.judge(encoding.garble(w, c))[1] != w] == []
    sound = ["d’água", "copo d’agua", "d’Arc", "it’s", "disse—ele", "“AMANHÃ”", "AMANHÃ…", "à reportagem", "às creches", "POÇOS", "1ª–2ª", "rock’n’roll"]
    assert [w for w in sound if model.judge(w)[0] != "sound"] == []


# 3 ----------------------------------------------------------------------------------------------------------------------


def test_common_lines_is_longest():
    r = rnd(5)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(row[j - 1] + same(x, y), row[j], new[-1]))
            row = new
        return row[-1]

    def same(x, y):
        return x[0] == y[0] or (x[1] != 0 and x[1] == y[1])

    for _ in range(300):
        a, b = ([(r.randint(0, 6), r.choice([0, 0, 1, 2])) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = boilerplate.common_lines(a, b)
        assert len(got) == longest(a, b) and all(same(a[i], b[j]) for i, j in got)
        assert got == sorted(got, reverse=True) and len({i for i, _ in got}) == len(got)


def test_furniture_goes_and_story_stays(spark):
    r = rnd(8)
    say = lambda: " ".join(r.choice(WORDS) for _ in range(30)).capitalize() + "."
    rows, want = [], set()
    for i in range(30):
        text = ["Home ~ Mapa ~ Ajuda geral", f"Historia unica numero {WORDS[i]} de hoje.", "", say(), "Assine nosso jornal local agora", say(), "Rodape do site local"]
        rows.append(("c", i, f"https://site.example/a/b{i:02d}-{WORDS[i]}-materia-muito-longa-{i}", f"Historia unica numero {WORDS[i]} de hoje.", "\n".join(text), "extra"))
        want |= {("c", i, k) for k in (0, 4, 6)}
    rows += [("c", 100, rows[0][2], None, rows[0][4], "x"), ("c", 101, "https://so.example/x", None, "Uma linha so.", "x"), ("c", 102, None, None, None, "x"), ("c", 103, "nada", None, "", "x")]
    df = spark.createDataFrame(rows, "campo string, id int, url string, titulo string, texto string, host string")
    got = {tuple(x) for x in boilerplate.furniture(df).collect()}
    assert got == want | {("c", 100, k) for k in (0, 4, 6)}
    clean = {x["id"]: x for x in boilerplate.main_text(df, boilerplate.furniture(df)).collect()}
    assert "Assine" not in clean[3]["texto_principal"] and clean[101]["texto_principal"] == "Uma linha so." and 102 not in clean
    assert boilerplate.furniture(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", ["a00", "m00"])  # first of its host, and amid others
def test_an_address_of_many_texts_keeps_its_neighbours(spark, hot):
    r = rnd(10)
    say = lambda: " ".join(r.choice(WORDS) for _ in range(30)).capitalize() + "."
    rows = []
    for i, path in enumerate([hot] * 60 + [f"{c}{k}" for c in "bcdpqr" for k in range(3)]):
        text = [say(), "uma linha da casa em toda pagina", say(), "e mais uma ao pé dela"]
        rows.append(("c", i, f"https://site.example/{path}", None, "\n".join(text)))
    df = spark.createDataFrame(rows, "campo string, id int, url string, titulo string, texto string")
    got = {(x["id"], x["linha_no"]) for x in boilerplate.furniture(df.coalesce(1)).collect()}
    assert got == {(i, k) for i in range(len(rows)) for k in (1, 3)}


def test_pointers_and_authors_are_learned(spark):
    """Labels and frames no pattern names: pointers by their label, authors whom few neighbours share by the frame; the same rows however they are partitioned."""
    r = rnd(12)
    say = lambda n=30: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."
    people = [f"{a.capitalize()} {b.capitalize()}" for a in WORDS[:6] for b in WORDS[9:12]]
    rows, want = [], set()
    for i in range(120):
        title = f"Verdadeira historia do {WORDS[i % 64]} {WORDS[(i * 7) % 64]}"
        text = [title, f"Texto de {r.choice(people)}", say(), f"Olhe isto: {say(6)}", say(), f"Quem era {say(3)[:-1].title()}", say(), "Casa Editora de todos, telefone geral"]
        rows.append(("c", i, f"https://site{i % 2}.example/a/{i:03d}-{title.lower().replace(' ', '-')}", title, "\n".join(text)))
        want |= {(i, k) for k in (1, 3, 7)}
    rows.append(("c", 900, "https://site0.example/a/000-longo", None, "\n".join([*(f"linha {j} " + "x " * 40 for j in range(20_000)), "Casa Editora de todos, telefone geral"])))
    df = spark.createDataFrame(rows, "campo string, id int, url string, titulo string, texto string")
    got = [{(x["id"], x["linha_no"]) for x in boilerplate.furniture(df.repartition(n)).collect()} for n in (2, 16)]
    assert got[0] == got[1] == want | {(900, 20_000)}


# 4 and 6 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_lose_no_link(spark, seed):
    texts = sorted(set(varied(seed)))
    df = segments.contents(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), F.col("t"))
    once = segments.distinct_texts(df)
    of = {r["content"]: r["id"] for r in df.select("content", "id").collect()}
    got = {frozenset((of[r["a"]], of[r["b"]])) for r in segments.near_pairs(once, once).collect()}
    want = {frozenset((i, j)) for i, j in combinations(range(len(texts)), 2) if near(texts[i].split(), texts[j].split())}
    assert got == want


def test_a_phrase_in_every_text_loses_no_link(spark):
    phrase = " ".join(WORDS[:20])
    texts = sorted({f"{phrase} {t}" for t in varied(9, 40)})
    df = segments.contents(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), F.col("t"))
    once = segments.distinct_texts(df)
    want = sum(near(a.split(), b.split()) for a, b in combinations(texts, 2))
    assert segments.near_pairs(once, once).select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() == want


def _registry(seed: int) -> list[tuple]:
    r, rows = rnd(seed), []
    base = varied(seed, 25)
    for i, t in enumerate(base * 2):
        url = r.choice([f"https://s.example/p/{i % 40}", f"http://www.s.example/p/{i % 40}/?utm_source=x#a", f"https://s.example/q?id={i % 30}", None])
        rows.append((i + 1, i // 20, url, t if r.random() < 0.9 else None, t[::-1] if r.random() < 0.5 else r.choice([None, ""]), "x"))
    return rows


def _greedy(rows: list[tuple]) -> dict:
    def key(u):
        return None if u is None else u.split("#")[0].replace("http://www.", "https://").replace("/?utm_source=x", "")

    kept, out = [], {}
    for i, _, url, title, excerpt, _ in rows:
        w, lone = ((title or "") + " " + (excerpt or "")).lower().split(), not excerpt
        hits = [j for j, u2, w2, l2 in kept if (url and key(url) == u2) or (w and w2 and (w == w2 and lone == l2 if lone and l2 else near(w, w2) and not (w == w2 and lone != l2) or w == w2))]
        if hits:
            out[i] = min(hits)
        else:
            kept.append((i, key(url), w, lone))
    return out


SCHEMA = "id int, lote int, url string, titulo string, trecho string, content string"


@pytest.mark.parametrize("seed", [3])
def test_batches_against_greedy(spark, seed):
    rows = _registry(seed)
    keyed = history.keyed(spark.createDataFrame(rows, SCHEMA), "id", ["lote", "id"], "url", "titulo", "trecho")
    got = {r["id"]: r["duplicate_of"] for r in history.resolve(keyed, history.content_links(keyed)).where("duplicate_of IS NOT NULL").collect()}
    assert got == _greedy(rows)


def test_registry_in_steps_agrees(spark, tmp_path):
    rows = _registry(6)
    keyed = history.keyed(spark.createDataFrame(rows, SCHEMA), "id", ["lote", "id"], "url", "titulo", "trecho").cache()
    got = {}
    for lote in range(rows[-1][1] + 1):
        batch = keyed.where(F.col("pos.lote") == lote)
        reg = history.Registry(spark, f"{tmp_path}/r")  # opened anew for every batch
        res = reg.check(batch).cache()
        got |= {r["id"]: r["duplicate_of"] for r in res.where("duplicate_of IS NOT NULL").collect()}
        accepted = batch.join(res.where("duplicate_of IS NULL").select("id"), "id", "left_semi")
        reg.append(accepted, f"b{lote}")
        if lote == 1:
            reg.append(accepted, f"b{lote}")  # tried again: replaced, not doubled
    assert got == _greedy(rows)
    assert reg.check(keyed.limit(0)).count() == 0
    folded = history.fold_batches(history.Registry(spark, f"{tmp_path}/f"), keyed, "lote").where("duplicate_of IS NOT NULL")
    assert {r["id"]: r["duplicate_of"] for r in folded.collect()} == got
    assert history.fold_batches(history.Registry(spark, f"{tmp_path}/e"), keyed.limit(0), "lote").count() == 0


def test_overlap_against_brute_force(spark):
    texts = varied(11, 30) + ["", None, "igual aqui", "Igual, AQUI!"]
    r = rnd(1)
    side = [r.choice(["train", " Train", "val-sel", "TEST", "unused", None]) for _ in texts]
    side[-2:] = ["train", "test"]
    pool = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "rid int, t string, content int")
    sp = spark.createDataFrame([(i, s) for i, s in enumerate(side)] * 2, "rid int, s string")
    got = {(x["train_id"], x["eval_id"]) for x in overlap.expanded(*overlap.overlaps(overlap.sided(pool, sp, "rid", "t", "s"))).collect()}
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    name = lambda s: (s or "").strip().lower().replace("-", "_")
    want = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if texts[i] and texts[j] and name(side[i]) == "train" and name(side[j]) in ("val_sel", "val_calib", "test") and near(plain(texts[i]), plain(texts[j]))}
    assert got == want and (len(texts) - 2, len(texts) - 1) in got


# 7 ----------------------------------------------------------------------------------------------------------------------


def test_repeated_lines_and_deltas(spark):
    rows = [(i, f"u{i // 2}", "p", f"Linha fixa!\ncorpo {WORDS[i]}\n123\nLINHA  FIXA", i >= 20, "x") for i in range(40)] + [(90, "u", None, "Linha fixa", False, "x"), (91, None, "p", "Linha fixa", False, "x"), (92, "v", "p", None, False, "x"), (93, "w", "q", "so uma", False, "x")]
    df = spark.createDataFrame(rows, "id int, url string, portal string, texto string, novo boolean, k string")
    args = (df, "id", "portal", "url", "texto")
    both = lines.merge(lines.merge(None, lines.pairs(df.where("NOT novo"), *args[1:], F.lit(0))), lines.pairs(df.where("novo"), *args[1:], F.lit(1)))
    hit = lines.crossed(lines.counts(both, 1))
    assert [(r["source"], r["n_urls"], r["urls"], r["newly"]) for r in hit.collect()] == [("p", 20, 20, False)]
    places = lines.found(lines.exploded(*args), hit)
    assert {(r["doc_id"], r["linha_no"]) for r in places.collect()} == {(i, k) for i in range(40) for k in (0, 3)}
    clean = {r["doc_id"]: r["texto_limpo"] for r in lines.rebuilt(df, "id", "texto", places).collect()}
    assert clean[5] == f"corpo {WORDS[5]}\n123" and 93 not in clean
    fresh = lines.crossed(lines.counts(lines.merge(None, lines.pairs(*args, F.lit(1))), 1))
    assert fresh.first()["newly"]


def test_line_counts_are_kept_between_deltas(spark, tmp_path):
    rows = [(i, f"u{i % 5}", "p", "Fixa\n" + ("Nova" if i >= 3 else f"corpo {WORDS[i]}"), i >= 4, "x") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, url string, portal string, texto string, novo boolean, k string")
    part = lambda new: lines.pairs(df.where(F.col("novo") == new), "id", "portal", "url", "texto", F.lit(0))
    once = lines.State(spark, str(tmp_path)).append(part(False), "0")
    assert [(r["n_urls"], r["urls"]) for r in once.collect()] == [(4, 4)]
    for _ in range(2):  # opened anew, and tried again
        hit = lines.State(spark, str(tmp_path)).append(part(True), "1")
        want = {r["k"]: (r["n_urls"], r["urls"]) for r in lines.crossed(lines.counts(lines.merge(None, part(False).unionByName(part(True))), 1)).collect()}
        assert {r["k"]: (r["n_urls"], r["urls"]) for r in hit.collect()} == want
        assert sorted(r["newly"] for r in hit.collect()) == [False, True]


def test_every_body_is_cleaned(spark, sf):
    text = {r["corpo_id"]: r["texto_completo"] for r in spark.read.parquet(f"{sf}/corpo_lido.parquet").where("length(texto_completo) > 0").collect()}
    places: dict[int, set] = {}
    for r in queries.p7_found(spark, sf).collect():
        places.setdefault(r["corpo_id"], set()).add(r["linha_no"])
    want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in places.get(i, ())), len(places.get(i, ()))) for i, t in text.items()}
    assert {r["corpo_id"]: (r["texto_limpo"], r["linhas_removidas"]) for r in queries.p7_clean(spark, sf).collect()} == want
    assert len(places) < len(want)


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    r = rnd(2)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 20, 60, 900]))) for _ in range(400)] + ["", None, "igual", "igual"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("tokens", F.lit("clash"))
    out = packing.pack(df, "id", "t", 200).cache()
    sizes = {x["id"]: x["n"] for x in df.select("id", packing.n_tokens(F.col("t")).alias("n")).collect()}
    got: dict = {}
    for x in out.collect():
        got.setdefault(x["id"], []).append(x["tokens"])
    assert {k: sum(v) for k, v in got.items()} == {k: v for k, v in sizes.items() if v}
    assert all(len(v) == -(-sizes[k] // 200) for k, v in got.items())
    use = packing.usage(out, 200).first()
    assert use["maior"] <= 200 and use["uso"] > 0.93
    assert packing.pack(df.limit(0), "id", "t", 200).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "t", 0)


def test_hilbert_visits_every_cell_by_steps():
    import numpy as np

    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    at = packing.hilbert(grid, 4)
    assert sorted(at.tolist()) == list(range(256))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# 9 ----------------------------------------------------------------------------------------------------------------------


def test_flight_keeps_totals():
    for seed in range(20):
        r = rnd(seed)
        size = sorted((r.randint(1, 400) for _ in range(200)), reverse=True)
        pi = [0.3] * 200
        out = mixing.flight(pi, size, r)
        left = [p for p in out if 0 < p < 1]
        assert len(left) <= 2 and abs(sum(p * s for p, s in zip(out, size, strict=True)) - 0.3 * sum(size)) < 1e-4


def test_mix_reaches_its_shares(spark):
    r = rnd(4)
    rows = [(i, s, " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60)))) for i, s in enumerate(["a"] * 500 + ["b"] * 300 + ["c"] * 20 + ["fora"] * 50)] + [(9000, "a", None), (9001, "b", "")]
    docs = spark.createDataFrame(rows, "id int, source string, t string").withColumn("tokens", F.lit("clash"))
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("vazia", 0.1, 4)], "source string, peso_alvo double, max_repeticoes int")
    out, report = mixing.mix(docs, "id", "source", "t", goal)
    got = {x["source"]: x for x in report.collect()}
    assert abs(got["a"]["peso_obtido"] - 5 / 9) < 0.01 and abs(got["b"]["peso_obtido"] - 3 / 9) < 0.01 and abs(got["c"]["peso_obtido"] - 1 / 9) < 0.01 and got["vazia"]["tokens_obtidos"] == 0
    most = {x["source"]: x["m"] for x in out.groupBy("source").agg(F.max("copias").alias("m")).collect()}
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 3 and "fora" not in most
    assert mixing.mix(docs.limit(0), "id", "source", "t", goal)[0].count() == 0


# 10 ---------------------------------------------------------------------------------------------------------------------


def test_cut_texts(spark):
    r = rnd(6)

    def story(n: int) -> str:
        return " ".join(" ".join(r.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(n))

    whole = [story(r.randint(3, 9)) for _ in range(300)]
    capped = [(story(40) + "ã")[:700] for _ in range(40)]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(1000 + i, "t", t) for i, t in enumerate(capped)] + [(1500 + i, "t", t) for i, t in enumerate(whole[:80])]
    rows += [(2000, "s", whole[0] + " Kanape lo [...]"), (2001, "s", whole[0] + " Kanape &am"), (2002, "s", whole[0] + " Kanape lonape zzq"), (2003, "s", whole[1] + " #tag"), (2004, "s", whole[1] + " https://x.example/a"), (2005, "s", None), (2006, "s", "  "), (2007, None, whole[2])]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("n", F.lit(1))
    got = {x["doc_id"] for x in truncation.judged(df, "doc_id", "source", "text").where("cut").collect()}
    assert {2000, 2001, 2002} <= got and not got & ({2003, 2004, 2005, 2006, 2007} | set(range(300)) | set(range(1500, 1580)))
    assert {1000 + i for i, t in enumerate(capped) if not t.rstrip().endswith(".")} <= got
    assert truncation.judged(df.limit(0), "doc_id", "source", "text").count() == 0


def test_cuts_at_one_place_are_no_habit(spark):
    r = rnd(9)
    story = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(8, 30))).capitalize()
    rows = [(i, "s", story() + ".") for i in range(6000)]
    rows += [(10_000 + i, "s", f"{story()}. Lona antena de telefo") for i in range(5)]  # a fragment that is no share of 6,000
    rows += [(11_000 + i, "s", f"{story()}. Fica o alerta") for i in range(40)]  # a habit, its word nowhere else
    copy = story() + ". Kanape busca reve"
    rows += [(12_000 + i, "s", copy) for i in range(30)]
    fixed = [f"{story()}. Muito ovo de gali" for _ in range(20)]
    rows += [(13_000 + i, "t", (WORDS[i] + " ") * 60 + t.rjust(400, "x")) for i, t in enumerate(fixed)]
    rows = [(i, s, t[-380:] if s == "t" else t) for i, s, t in rows]
    got = {x["doc_id"] for x in truncation.judged(spark.createDataFrame(rows, "doc_id int, source string, text string"), "doc_id", "source", "text").where("cut").collect()}
    assert got == {i for i, _, _ in rows if 10_000 <= i < 11_000 or i >= 12_000}


# queries ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, sf, duck, name):
    from conftest import rows_of

    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in queries.SQL:
        assert rows_of(got) == rows_of(duck.execute(queries.SQL[name]).df())
    assert list(got.columns)
