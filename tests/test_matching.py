"""Joins by similarity against all pairs."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadloom.operators import normalize, resolve
from leadloom.operators.blocks import Least
from leadloom.operators.simjoin import shortest_bound, similar_texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.65, 0.8, 0.875, 1.0])
def test_no_similar_pair_is_lost(spark, least):
    rng = random.Random(int(least * 1000))
    base = ["apartamento t2 lisboa centro", "moradia v3 cascais", "aaaaaaaaaaaa", "loja", "ab", "a", "", "abababababab", "terreno urbano de setubal com vista"]
    texts = set(base)
    while len(texts) < 220:
        t = list(rng.choice(base) or "x")
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x", " "])
        texts.add("".join(t))
    texts = sorted(texts)
    left, right = [(k % 2, t) for k, t in enumerate(texts)], [(k % 2, t) for k, t in enumerate(reversed(texts))]
    found = similar_texts(spark.createDataFrame(left, "zone int, a string"), spark.createDataFrame(right, "zone int, b string"), ["zone"], least).collect()
    wanted = {}
    for (z, a), (y, b) in itertools.product(left, right):
        ratio = 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))
        if z == y and ratio >= least - 1e-12:
            wanted[z, a, b] = ratio
    assert {(r.zone, r.a, r.b): pytest.approx(r.ratio) for r in found} == wanted and len(found) == len(wanted)


def test_bound_refuses_low_similarity():
    assert shortest_bound(1.0, 2) == 1
    with pytest.raises(ValueError):
        shortest_bound(0.5, 2)


def test_fuzzy_match_loses_no_pair(spark):
    """3,000 rows in two zones against all pairs; half of them in one price range."""
    rng = random.Random(11)
    kinds, words = ["T1", "T2", "", None], ["casa", "azul", "jardim", "centro", "mar", "sol"]
    rows = []
    for k in range(3000):
        price = rng.choice([None, 100_000.0 * 1.01 ** rng.randint(0, 12), 10 ** rng.uniform(4, 6)])
        area = rng.choice([None, 0.0, 50.0 * 1.02 ** rng.randint(0, 15), float(rng.randint(30, 200))])
        reach = rng.random() < 0.9
        rows.append((k, rng.choice(["Lisboa", "Porto"]), rng.choice(kinds), price, area, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice("xyz"), "+351912345678" if reach else None, None, None, False, False, None))
    schema = "id long, zone string, typology string, price double, area_m2 double, title string, discovery_source string, contact_phone string, contact_email string, contact_whatsapp string, archived boolean, is_demo boolean, contact_source string"
    found = {r.id: (r.donor_id, r.score, r.n_candidates) for r in resolve.fuzzy_match(spark.createDataFrame(rows, schema), exact_ratio=False).collect()}

    def step(gap, rungs):
        return next((v for m, v in rungs if gap <= m), 0.0)

    wanted, ratios = {}, {}
    for t in (r for r in rows if r[7] is None):
        best = []
        for d in rows:
            if d[7] is None or d[1] != t[1] or d[6] == t[6]:
                continue
            known = weight = signals = 0
            hp, ha = (t[3] or 0) > 0 and (d[3] or 0) > 0, (t[4] or 0) > 0 and (d[4] or 0) > 0
            kind, title = bool(t[2] and d[2]), bool(t[5] and d[5])
            if kind and t[2] != d[2]:
                continue
            if hp:
                known, weight, signals = known + 2 * step(abs(t[3] - d[3]) / max(t[3], d[3]), resolve.PRICE_RUNGS), weight + 2, signals + 1
            if kind:
                known, weight, signals = known + 1.5, weight + 1.5, signals + 1
            if ha:
                known, weight, signals = known + 1.5 * step(abs(t[4] - d[4]) / max(t[4], d[4]), resolve.AREA_RUNGS), weight + 1.5, signals + 1
            if title:
                key = (t[5], d[5])
                if key not in ratios:
                    ratios[key] = 1 - distance(*key) / max(map(len, key))
                known, weight, signals = known + ratios[key], weight + 1, signals + 1
            if signals >= 2 and (hp or signals >= 3) and known / weight >= 0.72:
                best.append((known / weight, -d[0]))
        if best:
            wanted[t[0]] = (-max(best)[1], round(max(best)[0], 6), len(best))
    assert {k: (d, pytest.approx(s, abs=2e-6), n) for k, (d, s, n) in found.items()} == wanted


def test_hot_zone_has_bounded_candidates(spark):
    """Rows of one zone whose prices spread over a thousandfold range: a target meets few of them."""
    rows = [(k, "Lisboa", "T2", 1000.0 * 1.002 ** (k % 3400), 50.0 + k % 100, "casa", "xy"[k % 2]) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, zone_n string, typology string, price double, area double, title_n string, source string")
    pairs = resolve.candidate_pairs(df.where("id % 10 = 0"), df.where("id % 10 != 0"))
    per_target = pairs.groupBy("t_id").count().agg(F.avg("count")).first()[0]
    assert per_target < 0.05 * 5400 and pairs.count() == pairs.select("t_id", "d_id").distinct().count()


def test_relaxed_match_compares_equal_rows_once(spark):
    columns = "id long, zone_n string, kind string, price double, title_n string, phone string"
    targets = spark.createDataFrame([(k, "z", "T2" if k % 2 else None, 100.0 if k % 2 else None, "small flat", None) for k in range(60)], columns)
    donors = spark.createDataFrame([(1000 + k, "z", "T2" if k % 3 else "", 101.0 if k % 3 else None, "small flat", f"p{k}") for k in range(60)], columns)
    seen, plain = [], normalize._best_donors
    normalize._best_donors = lambda t, d, *more: seen.append((t.count(), d.count())) or plain(t, d, *more)
    try:
        found = {r.id: (r.donor_id, r.score, r.phone) for r in normalize.relaxed_match(targets, donors).collect()}
    finally:
        normalize._best_donors = plain
    assert seen == [(2, 2)]
    every = {r.id: (r.donor_id, r.score, r.phone) for r in plain(targets, donors, 0.60, 0.65).collect()}
    assert found == every and len({v for v in found.values()}) >= 1 and found[1] == (1001, 1.0, "p1")


def test_edit_distances_of_many_pairs():
    rng = random.Random(3)
    texts = ["", "a", "é𝄞x", *("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(40))]
    pairs = [(a, b) for a in texts for b in texts]
    assert resolve.edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [distance(a, b) for a, b in pairs]


def test_fuzzy_match_rates_pairs_of_titles_and_equal_rows_once(spark, monkeypatch):
    """600 rows with four titles: a title pair is rated once a block, equal rows are one, and slices of blocks change nothing."""
    schema = "id long, zone string, typology string, price double, area_m2 double, title string, discovery_source string, contact_phone string, contact_email string, contact_whatsapp string, archived boolean, is_demo boolean, contact_source string"
    rows = [(k, "Lisboa", "T2", 100_000.0 + k % 40, 50.0, f"casa {k % 4}", "xy"[k % 2], None if k % 5 == 0 else "+351912345678", None, None, False, False, None) for k in range(600)]
    leads = spark.createDataFrame(rows, schema)
    whole = sorted(map(tuple, resolve.fuzzy_match(leads, exact_ratio=False).collect()))
    plan = resolve.fuzzy_match(leads, exact_ratio=False)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "levenshtein" not in plan
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, resolve.fuzzy_match(leads, exact_ratio=False).collect())) == whole and len(whole) == 120
    exact = {r.id: r.score for r in resolve.fuzzy_match(leads).collect()}
    assert exact == {i: s for i, _, s, _ in whole}


@pytest.mark.parametrize("texts", [["red house", "red horse", "blue house", ""], [f"{a} {b}" for a in ("red", "blue", "great", "small") for b in ("house", "horse", "barn", "flat", "garden plot", "x")]])
def test_best_priced_donor_of_a_block(texts, monkeypatch):
    """By runs of one title, or by pairs where titles hardly repeat: the best score, then the smallest id, as of all pairs, with prices on the bounds."""
    rng = random.Random(5)
    price = lambda: rng.choice([100.0, 98.0, 90.0, 102.0, 110.0, 111.11, 111.12, 80.0, round(rng.uniform(60, 150), 2)])
    side = lambda start, n: pd.DataFrame([(start + k, price(), rng.choice(texts), f"p{k}") for k in range(n)], columns=["id", "price", "title_n", "phone"]).sample(frac=1, random_state=1)
    t, d = side(0, 90), side(1000, 110)
    distance = lambda x, y: int(resolve.edit_distances([x], [y])[0])
    wanted = {}
    for x in t.itertuples():
        for y in d.itertuples():
            gap, longest = abs(x.price - y.price) / max(x.price, y.price), max(len(x.title_n), len(y.title_n))
            points = next((p for g, p in normalize.RELAXED_RUNGS if gap <= g), 0.0)
            score = ((1 - distance(x.title_n, y.title_n) / longest if longest else 1.0) + points * 1.5) / 2.5
            if score >= 0.6:
                wanted[x.id] = max(wanted.get(x.id, (-1.0, 0, "")), (score, -y.id, y.phone))
    runs = []
    monkeypatch.setattr(normalize, "Least", lambda numbers: runs.append(1) or Least(numbers))
    found = normalize._best_priced(t, d, 0.6)
    assert {r.id: (r.score, -r.donor_id, r.phone) for r in found.itertuples()} == wanted and len(found) == len(wanted) > 80
    assert len(runs) == (len(texts) if len(texts) == 4 else 0)


@pytest.mark.parametrize("kind", [True, False])
def test_best_of_a_block_by_titles_equals_all_pairs(kind):
    """Scores, smallest ids and counts by runs and tables are those of all pairs, with equal, empty and NULL texts, sources and areas."""
    rng = random.Random(8)
    titles = ["", *(f"{a} {b}" for a in ("casa", "loja", "andar grande") for b in ("nova", "velha", "de praia"))]
    price = lambda: rng.choice([100.0, 98.0, 95.0, 90.0, 80.0, 105.0, 125.0, round(rng.uniform(70, 140), 2)])
    area = lambda: rng.choice([None, 0.0, 50.0, 47.5, 45.0, 40.0, 52.6, float(rng.randint(30, 70))])
    side = lambda start, n: pd.DataFrame([(start + k, price(), area(), rng.choice(titles), rng.choice(["x", "y", "z", None]), rng.randint(1, 3)) for k in range(n)], columns=["id", "price", "area", "title_n", "source", "n"]).sample(frac=1, random_state=2)
    t, d = side(0, 250), side(1000, 300)
    for x in (t, d):
        x["sized"] = x["area"].fillna(0.0) > 0
    listed = lambda found: sorted(map(tuple, found[["class", "score", "donor_id", "n"]].itertuples(index=False)))
    wanted = listed(resolve._best_by_pairs(t, d, kind, True, 0.72, False))
    assert listed(resolve._best_by_title(t, d, kind, 0.72, False, True)) == wanted and len(wanted) > 100
    assert [x[:3] for x in listed(resolve._best_by_title(t, d, kind, 0.72, False, False))] == [x[:3] for x in wanted]
    if kind:
        plain = listed(resolve._best_by_pairs(t, d, kind, False, 0.72, False))
        assert listed(resolve._best_of_block(t, d, kind, False, 0.72, False)) == plain and len(plain) > 50


def test_a_large_block_with_few_titles_does_not_rate_its_pairs(monkeypatch):
    """Nor is anything counted that isn't asked for."""
    rng = random.Random(2)
    side = lambda start, n: pd.DataFrame([(start + k, round(rng.uniform(80, 100), 2), 50.0 + k % 20, True, f"casa {k % 3}", "xy"[k % 2], 1) for k in range(n)], columns=["id", "price", "area", "sized", "title_n", "source", "n"])
    t, d = side(0, 2500), side(10_000, 2500)
    monkeypatch.setattr(resolve, "_best_by_pairs", None)
    found = resolve._best_of_block(t, d, True, True, 0.72, False)
    assert len(found) == 2500 and (found["score"] > 0.99).all() and found["n"].min() > 0
    assert not resolve._best_of_block(t, d, True, True, 0.72, False, False)["n"].any()


def test_exact_ratios_by_titles_equal_all_pairs(monkeypatch):
    """The matching-blocks ratio, which isn't symmetric, is taken once for a target's and a donor's title."""
    rng = random.Random(6)
    titles = ["tide is", "diet is", "side it", "casa nova", "nova casa", ""]
    side = lambda start, n: pd.DataFrame([(start + k, round(rng.uniform(80, 120), 2), 50.0, True, rng.choice(titles), "xy"[k % 2], 1) for k in range(n)], columns=["id", "price", "area", "sized", "title_n", "source", "n"])
    t, d = side(0, 120), side(1000, 130)
    listed = lambda found: sorted(map(tuple, found[["class", "score", "donor_id", "n"]].itertuples(index=False)))
    wanted = listed(resolve._best_by_pairs(t, d, True, True, 0.72, True))
    rated, plain = [], resolve._title_ratios
    monkeypatch.setattr(resolve, "_title_ratios", lambda a, b, exact: rated.extend(zip(a, b, strict=True)) or plain(a, b, exact))
    assert listed(resolve._best_by_title(t, d, True, 0.72, True, True)) == wanted and len(wanted) == 120
    assert len(rated) == len(set(rated)) == 36


def test_filled_from_donors_counts_no_candidates(spark, monkeypatch):
    """d6_filled_from_donors asks for the best donor alone."""
    from leadloom.plans import data_queries

    asked, plain = [], resolve.fuzzy_match
    monkeypatch.setattr(resolve, "fuzzy_match", lambda leads, **options: asked.append(options.get("counted")) or plain(leads, **options))
    found = data_queries.d6_filled_from_donors(spark, "/root/testdata/sf0.001")
    assert asked == [False] and found.count() == data_queries.d4_fuzzy_match(spark, "/root/testdata/sf0.001").count()
    assert "n_candidates" not in plain(data_queries.leads(spark, "/root/testdata/sf0.001"), counted=False).columns
