"""The language model: exact base scores, proper probabilities, and gain over the base on text with order."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from leadloom.llm import language_model as lm


def rows_of(rng):
    rows = []
    for k in range(300):
        words, w = [], 0
        for _ in range(rng.randint(0, 60)):
            w = (w * 3 + rng.choice([0, 1])) % 23
            words.append(f"W{w}" if rng.random() < 0.97 else f"rare{rng.randint(0, 200)}")
        rows.append((k, " \n".join(words), "x"))
    return rows + [(1000, None, "x"), (1001, "", "x"), (None, "W1 W2", "x"), (5, rows[5][1], "x"), (1002, "w1 " * 30_000, "x")]


def test_scores(spark):
    rows = rows_of(random.Random(3))
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), dictionary=40, part_tokens=3000).collect()
    split = [(r, zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0, [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()), None]) for r in rows]
    c = Counter(t for _, out, words in split if not out for t in words)
    n, v = sum(c.values()), len(c)
    wanted = sorted((str(r[0]), out, len(words), sum(c[t] > 0 for t in words), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in words), 6)) for r, out, words in split)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == wanted
    assert all(-1e6 < r.score < 0 for r in found)
    held = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)  # the order of words is learnt
    again = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), dictionary=40, part_tokens=3000).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in found) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)


def test_no_rows(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_sum_to_one_and_seatings_keep_customers():
    rng = np.random.default_rng(4)
    n = 30
    u, w = np.divmod(rng.choice(n * (n - 1), 200, replace=False), n - 1)
    c = rng.choice([1, 2, 3, 10, 500], 200)
    one, many = c == 1, c > 1
    once = (np.bincount(u[one], minlength=n), np.bincount(w[one], minlength=n - 1))
    totals = lm.Totals(*once, 0.6).seat(rng, None)
    samples, added = [], np.zeros(many.sum())
    t, sizes = lm.seated(c[many], totals.mass(u[many], w[many]))
    for _ in range(6):
        t, sizes = lm.reseated(rng, c[many], t, sizes, totals.mass(u[many], w[many]), 0.6, 5)
        assert (np.add.reduceat(sizes, np.cumsum(t) - t) == c[many]).all() and (sizes > 0).all()
        totals = lm.Totals(once[0] + np.bincount(u[many], t, n), once[1] + np.bincount(w[many], t, n - 1), 0.6).seat(rng, totals)
        assert abs(totals.base.sum() - 1) < 1e-9
        samples.append(totals)
        added += t
    tables = np.ones(200)
    tables[many] = added / 6
    p = lm.Predictor(samples, np.bincount(u, c, n))
    grid = {(a, b): (x, y) for a, b, x, y in zip(u.tolist(), w.tolist(), c, tables, strict=True)}
    for a in range(n):
        x, y = zip(*(grid.get((a, b), (0, 0)) for b in range(n - 1)), strict=True)
        assert abs(p.probability(np.full(n - 1, a), np.arange(n - 1), np.array(x), np.array(y)).sum() - 1) < 1e-9


def test_gibbs_reaches_the_seating_distribution():
    """Tables of three customers of one dish: the exact chances of 1, 2 and 3 tables."""
    rng, d, mass = np.random.default_rng(5), 0.4, 0.7
    many = 20_000
    c = np.full(many, 3)
    t, sizes = np.ones(many, np.int64), np.full(many, 3)
    t, sizes = lm.reseated(rng, c, t, sizes, np.full(many, mass), d, 60)
    # Sequential seating with a fixed mass: the second joins with 1 - d, the third with its table's size less d.
    weights = np.array([(1 - d) * (2 - d), (1 - d) * mass + 2 * mass * (1 - d), mass * mass])
    assert np.abs(np.bincount(t, minlength=4)[1:] / many - weights / weights.sum()).max() < 0.015


def chances(c, mass, d):
    """The exact chances of 1 to c tables, by adding one customer after another."""
    w = np.array([1.0])
    for n in range(1, c):
        w = np.append(w * (n - d * np.arange(1, n + 1)), 0.0) + mass * np.append(0.0, w)
        w /= w.max()
    return w / w.sum()


def test_tables_of_frequent_pairs_have_the_exact_distribution():
    many = 8000
    for c, mass, d in ((2, 0.3, 0.4), (100, 5.0, 0.7), (128, 60.0, 0.6), (129, 40.0, 0.5), (500, 0.01, 0.8), (500, 150.0, 0.7), (2000, 30.0, 0.75), (4000, 300.0, 0.6), (4000, 3000.0, 0.7)):
        t = lm.drawn(np.random.default_rng(c), np.full(many, c), np.full(many, mass), d)
        wanted = chances(c, mass, d)
        place = np.arange(1, c + 1)
        mean = (wanted * place).sum()
        deviation = math.sqrt((wanted * (place - mean) ** 2).sum())
        found = np.cumsum(np.bincount(t, minlength=c + 1)[1:]) / many
        assert abs(t.mean() - mean) < 0.08 * deviation + 0.002 * mean and np.abs(found - np.cumsum(wanted)).max() < 0.05, (c, mass, d, t.mean(), mean)


def test_a_sweep_moves_a_dish_of_a_million():
    t = lm.drawn(np.random.default_rng(1), np.full(200, 1_000_000), np.full(200, 300.0), 0.6)
    assert 400 < t.mean() < 550 and len(set(t.tolist())) > 20


def test_probabilities_of_a_part_are_computed_some_at_a_time(monkeypatch):
    rng, n = np.random.default_rng(4), 50
    totals = lm.Totals(rng.integers(1, 9, n + 1), rng.integers(1, 9, n), 0.5).seat(rng, None)
    predictor = lm.Predictor([totals, totals], rng.integers(10, 99, n + 1))
    u, w = rng.integers(0, n + 1, 1000), rng.integers(0, n, 1000)
    c, t = rng.integers(1, 9, 1000), np.ones(1000)
    whole = np.log10(predictor.probability(u, w, c, t))
    sizes, plain = [], predictor.probability
    predictor.probability = lambda *x: sizes.append(len(x[0])) or plain(*x)
    monkeypatch.setattr(lm, "AT_ONCE", 64)
    assert predictor.logs((u << 20) + w, c, t).tolist() == whole.tolist() and max(sizes) == 64
    assert len(predictor.logs(u[:0], c[:0], t[:0])) == 0
