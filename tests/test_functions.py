"""Column functions on literal cases."""

import re
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leadloom.functions import classify, contact, parse, text
from leadloom.operators import history, resolve
from leadloom.sources import html, ingest


def values(spark, rows, fn):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [r.x for r in df.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def test_listing_price(spark):
    assert values(spark, ["195.000 €", "280 000€", "195,000", "4.000", "abc", None, "1.250.000,50 €"], parse.listing_price) == [195000.0, 280000.0, None, None, None, None, 1250000.5]


def test_import_values(spark):
    assert values(spark, ["250.000 EUR", "250,50", "250.000,75", "1,234.5", "12.5", "", None], parse.import_price) == [250000.0, 250.5, 250000.75, 1234.5, 12.5, None, None]
    assert values(spark, ["85 m²"], parse.import_area) == [85.0]
    assert values(spark, ["Sim", "Não", "particular", "x", None], parse.import_bool) == [True, False, True, None, None]


def test_area(spark):
    assert values(spark, ["78 m²", "120m2", "85,5 m²", "3 m", None], parse.listing_area) == [78.0, 120.0, 85.5, None, None]


@pytest.mark.parametrize(
    ("raw", "valid", "kind", "confidence"),
    [("+351912345678", True, "mobile", 90), ("+351668711891", True, "relay", 50), ("+351999999999", False, "unknown", 0), ("+351211234567", True, "landline", 70), ("+351707123456", False, "premium", 0), ("912 345 678", True, "mobile", 90), ("", False, "unknown", 0), ("35121123456", False, "unknown", 0)],
)
def test_phone(spark, raw, valid, kind, confidence):
    r = values(spark, [raw], contact.phone)[0]
    assert (r.valid, r.kind, r.confidence) == (valid, kind, confidence)
    assert (r.canonical is not None) == valid


def test_contacts_in_text(spark):
    assert values(spark, ["Tlm: 917 654 321 ou (213)456-789", "nada"], contact.phones_in_text) == [["+351917654321", "+351213456789"], []]
    assert values(spark, ["https://wa.me/351912345678", "WhatsApp: 912 345 678", "x"], contact.whatsapp) == ["+351912345678", "+351912345678", None]
    assert values(spark, ["mailto:Ana@casa.pt, noreply@x.pt, rui arroba casa ponto pt"], contact.emails_in_text) == [["ana@casa.pt", "rui@casa.pt"]]
    assert values(spark, ["ver www.olx.facebook.com e https://web.pt/a"], contact.website_in_text) == ["web.pt"]


def test_classify(spark):
    assert values(spark, ["T2 Lisboa", "T 7", "Terreno T1", "loja", "estúdio", None], classify.typology) == ["T2", "T5+", "Terreno", "Comercial", "T0", "Desconhecido"]
    assert values(spark, ["Apartamento T2 com piscina, garagem e vista para o mar"], lambda c: classify.tags(c, classify.AMENITIES)) == [["garagem", "piscina", "vista_mar"]]
    assert values(spark, ["urgente, para renovar", "calmo"], lambda c: classify.urgency(c)[0]) == [25, 0]
    zones = (("lisboa", "Lisboa"), ("costa da caparica", "Almada"))
    assert values(spark, ["Rua X, Lisboa", "costa da caparica", "n/a", "vila nova"], lambda c: classify.zone(c, zones)) == ["Lisboa", "Almada", "Outra", "Vila Nova"]


def test_text(spark):
    assert values(spark, ["Água  Ção!", None], text.norm_text) == ["agua cao", ""]
    assert values(spark, ["Olá, Mundo!"], text.slug) == ["ola-mundo"]
    assert values(spark, ["Maria da Costa", "Pedro", ""], lambda c: F.concat_ws("|", *text.split_name(c))) == ["Maria|da Costa", "Pedro|", "|"]


def test_listing_key_absorbs_small_changes(spark):
    rows = [("T2", "Lisboa", 200_000.0, 80.0), ("T2", "Lisboa", 200_400.0, 81.0), ("T2", "Porto", 200_000.0, 80.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "typology string, zone string, price double, area double").select(resolve.listing_key(F.lit("Bom T2 no centro"), *map(F.col, ("typology", "zone", "price", "area"))).alias("k"))
    a, b, c, d = (r.k for r in df.collect())
    assert a == b != c and len({a, c, d}) == 3 and len(d) == 16


def test_changes_and_edits(spark):
    df = spark.createDataFrame([(200000.0, 190000.0), (200000.0, 200100.0), (None, 200000.0), (0.0, 5.0)], "a double, b double")
    assert [r.x for r in df.select(history.is_change(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, True]
    rows = [("old text here", "entirely different words now"), ("same words here", "same words here" + " and more of it" * 3), ("colour", "colours"), ("a", "a"), ("", "new"), (None, "new")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.x for r in df.select(history.classify_edit(F.col("a"), F.col("b"), rewrite=0.2).alias("x")).collect()] == ["rewrite" if SequenceMatcher(None, *rows[0]).ratio() < 0.2 else "edit", "appended", "edit", None, None, None]


def test_seq_ratio(spark):
    rows = [("apartamento lisboa", "apartamento lisbon"), ("", ""), ("a", "b"), ("x" * 250, "x" * 240 + "y")]
    found = [r.x for r in spark.createDataFrame(rows, "a string, b string").select(resolve.seq_ratio("a", "b").alias("x")).collect()]
    assert found == [SequenceMatcher(None, a, b).ratio() for a, b in rows]


def test_near_codes_are_brute_force(spark):
    import random

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(15)]
    rows = []
    for k in range(160):
        code = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            code ^= 1 << rng.randrange(64)
        rows.append((k, rng.choice("ab"), code - 2**63))
    table = spark.createDataFrame(rows, "id long, source string, code long")
    class_of = dict(map(tuple, resolve.code_classes(table).collect()))
    assert class_of == {i: min(j for j, _, y in rows if y == x) for i, _, x in rows}
    wanted = {}
    for i, s, x in rows:
        for j, t, y in rows:
            bits = ((x ^ y) & (2**64 - 1)).bit_count()
            if i < j and s != t and bits <= 5:
                key = (*sorted((class_of[i], class_of[j])), bits)
                wanted[key] = wanted.get(key, 0) + 1
    assert {(r.a, r.b, r.bits): r.links for r in resolve.near_codes(table).collect()} == wanted


def test_relaxed_match_is_brute_force(spark):
    import random

    from leadloom.operators import normalize

    rng = random.Random(3)

    def row(k, phone):
        return (k, rng.choice("zy"), rng.choice(["", "T1", "T2"]), rng.choice([None, 0.0, *(100.0 * 1.07**i for i in range(12))]), rng.choice(["loja nova", "loja novas", "andar bom", "casa", ""]), phone)

    targets, donors = [row(k, None) for k in range(60)], [row(k, f"p{k}") for k in range(100, 180)]

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    wanted = {}
    for t in targets:
        rated = []
        for d in donors:
            if t[1] == d[1] and d[2] in (t[2], ""):
                title = 1 - edits(t[4], d[4]) / max(len(t[4]), len(d[4])) if t[4] or d[4] else 1.0
                p, q = (t[3] or 0) > 0, (d[3] or 0) > 0
                gap = abs(t[3] - d[3]) / max(t[3], d[3]) if p and q else 0
                step = 1.0 if gap <= 0.02 else 0.6 if gap <= 0.1 else 0.25 if gap <= 0.2 else 0.0
                score = (title + step * 1.5) / 2.5 if p and q else (title + 0.1) / 1.5 if p != q else title
                if score >= (0.60 if p and q else 0.65):
                    rated.append((round(score, 6), -d[0]))
        if rated:
            wanted[t[0]] = (max(rated)[0], -max(rated)[1])
    schema = "id long, zone_n string, kind string, price double, title_n string, phone string"
    found = normalize.relaxed_match(spark.createDataFrame(targets, schema), spark.createDataFrame(donors, schema)).collect()
    assert {r.id: (r.score, r.donor_id) for r in found} == wanted
    assert all(r.phone == f"p{r.donor_id}" for r in found)


def test_classifier_uses_word_pairs(spark, tmp_path):
    from leadloom.operators import learn

    rows = [(k, "aa bb cc" if k % 2 else "bb aa cc", k % 2) for k in range(60)]
    df = learn.training_rows(spark.createDataFrame(rows, "id long, text string, label int"), least_chars=1)
    assert sorted(df.limit(1).select(learn.terms(df.text).alias("t")).first().t)[:2] in (["aa", "aa bb"], ["aa", "aa cc"])
    model = learn.train(df, "id", f"file://{tmp_path}/a", least=10, steps=4)
    assert {r.id: r.predicted for r in learn.scored(model, df, "id").collect()} == {k: y for k, _, y in rows}
    assert [r.accuracy for r in learn.cross_validated(df, "id", f"file://{tmp_path}/b", 2, least=5, steps=4).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        learn.train(df, "id", f"file://{tmp_path}/c", least=61)


def test_classifier_equals_plain_steps(spark, tmp_path):
    """The same steps over dense arrays."""
    import random

    import numpy as np

    from leadloom.operators import learn

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["casa", "loja", "dono", "agencia", "novo", "sol", "mar"]) for _ in range(rng.randint(2, 9))) for _ in range(40)]
    y = np.array([float("agencia" in t) for t in texts])
    df = learn.training_rows(spark.createDataFrame([(k, t, int(v)) for k, (t, v) in enumerate(zip(texts, y, strict=True))], "id long, text string, label int"), 1)
    model = learn.train(df, "id", f"file://{tmp_path}/m", least=10, min_df=2, steps=5)
    found = {r.id: r.z0 for r in model.margins(df, "id").collect()}
    listed = []
    for t in texts:
        w = [x for x in t.split() if len(x) >= 2]
        listed.append(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    names = sorted({x for d in listed for x in d})
    tf = np.array([[1 + np.log(d.count(x)) if x in d else 0.0 for x in names] for d in listed])
    df_ = (tf > 0).sum(axis=0)
    idf = np.where((df_ >= 2) & (df_ <= 0.9 * 40), np.log(41 / (df_ + 1)) + 1, 0)
    x = tf * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.hstack([np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), np.ones((40, 1))])
    share = np.where(y == 1, 40 / (2 * y.sum()), 40 / (2 * (40 - y.sum())))
    w, before = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(5):
        ahead = w + step / (step + 3.0) * (w - before)
        slope = x.T @ (share * (1 / (1 + np.exp(-x @ ahead)) - y) / 40)
        slope[:-1] += 0.01 * ahead[:-1]
        w, before = ahead - 2 * slope, w
    assert [found[k] for k in range(40)] == pytest.approx((x @ w).tolist(), rel=1e-9)


def test_a_step_of_the_fit_moves_no_texts(spark, tmp_path):
    """What is shuffled and written doesn't follow the texts times the steps; rows that repeat an id count each, with one text of all."""
    from leadloom.operators import learn

    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(200)) + (" aa" if k % 2 else " bb"), k % 2) for k in range(60)] + [(0, "more bb", 0), (61, "-", 1)]
    df = learn.training_rows(spark.createDataFrame(rows, "id long, text string, label int"), least_chars=1)
    model = learn.train(df, "id", f"file://{tmp_path}/m", least=10, steps=3)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["model", "vectors"]  # no table per step, none of values by feature
    vectors = spark.read.parquet(f"file://{tmp_path}/m/vectors").collect()
    assert len(vectors) == 60 and [(r.ones, r.zeros) for r in vectors if r.ones + r.zeros > 1] == [(0, 2)]
    found = {r.id: r.z0 for r in model.margins(df, "id").collect()}
    assert len(found) == 60 and 61 not in found and all((z > 0) == bool(k % 2) for k, z in found.items())


def test_headers_and_files(spark, tmp_path):
    assert ingest.column_map(["Nome", "Telefone", "Preço", "Zona", "Notas", "Tel"]) == {"Nome": "contact_name", "Telefone": "contact_phone", "Preço": "price", "Zona": "zone", "Notas": "description"}
    (tmp_path / "a.csv").write_text("Nome;Telefone;Preço\nAna;912345678;250.000 EUR\n", encoding="utf-8-sig")
    rows = ingest.canonical(ingest.read_csv(spark, f"file://{tmp_path}/a.csv").drop("file")).collect()
    assert [(r.contact_name, r.contact_phone, r.price) for r in rows] == [("Ana", "912345678", "250.000 EUR")]


def test_page_phones_without_relay_first(spark):
    page = '<a href="tel:+351661234567"></a><script>var s = {phone: "+351912345678"}</script>'
    assert values(spark, [page], html.page_phones) == [["+351912345678", "+351661234567"]]


def test_price_drop_first_peak(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [(1, 7, 100.0, day(2)), (2, 7, 100.0, day(5)), (3, 7, 90.0, day(20)), (4, 8, 50.0, day(3)), (5, 9, 10.0, day(3)), (6, 9, 11.0, day(20))]
    df = spark.createDataFrame(rows, "id long, lead_id long, price double, recorded_at timestamp_ntz")
    found = history.price_drops(df, "2024-01-25 00:00:00").collect()
    assert [(r.lead_id, r.observations, r.drop_pct, r.days_since_peak) for r in found] == [(7, 3, 0.1, 18)]


def test_rules_on_cases_of_their_own(spark):
    def owner(text):
        none = F.lit(None).cast("string")
        return classify.owner_type(F.col(text), none, F.lit("x"), none)

    rows = [("vendo directamente", "fsbo"), ("sem mediadora", "agency"), ("por conta própria", "fsbo"), ("direto do dono", "fsbo"), ("o imóvel na mão", "agency"), ("obra nova", "developer"), ("casa bonita", "unknown")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.x for r in df.select(owner("t").alias("x")).collect()] == [w for _, w in rows]
    rows = [("armazém em Lisboa", "Armazém"), ("armazem", "Armazém"), ("casa geminada", "Moradia"), ("loja de móveis", ""), ("loja", "Loja")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.x for r in df.select(classify.property_type(F.col("t"), F.lit(None).cast("string")).alias("x")).collect()] == [w for _, w in rows]
    rows = [("Apartamento T2 com piscina, garagem e vista para o mar", ["garagem", "piscina", "vista_mar"]), ("alarme e a/c", ["ar_condicionado"]), ("alojamento local, cozinha equipada, obra nova", ["aluguer_curta", "cozinha_equipada", "novo_construcao"]), ("", [])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert [r.x for r in df.select(classify.tags(F.col("t"), classify.AMENITIES).alias("x")).collect()] == [w for _, w in rows]
    df = spark.createDataFrame([("promotora",), ("remax",)], "t string")
    assert [r.x for r in df.select(classify.is_direct(F.col("t")).alias("x")).collect()] == [True, False]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_fold_their_text_once(spark):
    """However many phrases there are, the plan holds one normal form of the text."""
    df = spark.createDataFrame([("Com piscina e a/c, vista mar",), ("Novo, metro a 5 min; caldeira",), (None,)], "t string")
    found = df.select(classify.tags(F.col("t"), classify.AMENITIES).alias("tags"))
    assert [r.tags for r in found.collect()] == [["ar_condicionado", "piscina", "vista_mar"], ["metro_perto", "novo_construcao"], []]
    assert plan_of(found).count("translate(") == 1


def test_best_phone_parses_a_candidate_once(spark):
    df = spark.createDataFrame([(["661234568", "213456789", "912 345 678", "961234567"],), (["123"],), (None,)], "c array<string>")
    found = df.select(contact.best_phone(F.col("c")).alias("best"))
    assert [r.best for r in found.collect()] == ["+351912345678", None, None]
    assert plan_of(found).count("[\\s\\-()./+]") == 1


def test_rows_without_a_telephone_are_not_one_task(spark):
    from leadloom.operators import scoring

    leads = spark.createDataFrame([(k, None if k % 2 else f"+35191{k % 10:07}", "a", False) for k in range(2000)], "id long, contact_phone string, zone string, is_demo boolean")
    signals = spark.createDataFrame([("a", "permit")], "zone string, signal_type string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = scoring.with_context(leads, signals)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert re.search(r"hashpartitioning\(contact_phone#\d+, deal#", plan)
    counts = {r.id: r.phone_count for r in scoring.with_context(leads, signals).collect()}
    assert counts == {k: None if k % 2 else 200 for k in range(2000)}
