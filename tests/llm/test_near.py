"""Near-duplicate joins against brute force."""

import random
import re

import numpy as np

from leadloom.llm import jaccard_join
from leadloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, n=4, percent=85):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def texts(rng, families, size):
    rows, at = [], 0
    for _ in range(families):
        base = [rng.choice(["a", "b", "the"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(1, size))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 50))):
                words[rng.randrange(len(words))] = rng.choice(["X", "y", "é"])
            rows.append((at := at + rng.randint(1, 3), rng.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_keys_and_sketch_lose_no_linked_pair():
    rng, layout = random.Random(4), jaccard_join.Layout(85)
    met = 0
    for _ in range(400):
        size = rng.choice([6, 7, 9, 20, 50, 200, 700])
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        most = int(0.15 / 1.85 * 2 * len(a))
        b = a.copy()
        for _ in range(rng.randint(0, most)):
            if rng.random() < 0.5 and len(b) > 1:
                b = np.delete(b, rng.randrange(len(b)))
            else:
                b = np.unique(np.append(b, np.uint64(rng.getrandbits(64))))
        both = len(np.intersect1d(a, b))
        if not both == len(a) == len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            met += 1
            band = layout.band(max(len(a), len(b)))
            (da, ka), (db, kb) = (next((d, k) for at, d, k in layout.keys(x) if at == band) for x in (a, b))
            # Whatever the order of keys is, each may give up its first ones.
            order = {k: rng.random() for k in {*ka.tolist(), *kb.tolist()}}
            left = [set(sorted(k.tolist(), key=order.get)[d:]) for k, d in ((ka, da), (kb, db))]
            assert left[0] & left[1], (len(a), len(b), both)
            distance = sum(int(x).bit_count() for x in (layout.sketch(a, band) ^ layout.sketch(b, band)).view(np.uint64))
            assert distance <= len(a) + len(b) - 2 * both
    assert met > 50


def test_sets_with_empty_blocks_share_keys():
    layout = jaccard_join.Layout(85)
    blocks = layout.most_different(layout.band(8)) + 1 + layout.spare(layout.band(8))
    one_block = [blocks * k + 1 for k in range(1, 9)]
    a, b = np.array(one_block, np.uint64), np.array(one_block[:7], np.uint64)
    keys = [{k for _, _, ks in layout.keys(x) for k in ks.tolist()} for x in (a, b)]
    assert keys[0] & keys[1]


def test_join_is_brute_force(spark):
    for seed, families, size in ((1, 40, 12), (2, 30, 120), (3, 12, 600)):
        rows = texts(random.Random(seed), families, size)
        found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(tuple, found)) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(1200):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(80)] = rng.choice(["x", "y", f"z{k}"])
        rows.append((k, " ".join(words)))
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def near_threshold(rng, n):
    """Copies of 100 words with a word of their own each: most pairs are just below the threshold, those with neighbouring places above it."""
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(n):
        words = list(base)
        words[rng.randrange(100)] = f"z{k}"
        rows.append((k, " ".join(words)))
    return rows


def test_pairs_under_one_hub_grow_with_its_sets(spark, monkeypatch):
    counts, plain = {}, jaccard_join.written

    def written(df, name, *more):
        table, path = plain(df, name, *more)
        if {"a", "b"} <= set(table.columns):
            counts[path] = table.count()
        return table, path

    monkeypatch.setattr(jaccard_join, "written", written)
    rows = near_threshold(random.Random(12), 900)
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == brute(rows)
    # A hub gives out fewer links than its sets times their blocks; the pairs in play were 234,865.
    assert max(counts.values()) <= jaccard_join.DEALT_BLOCKS * len(rows), counts


def test_blocks_of_a_hub_lose_no_link(spark, monkeypatch):
    for name, value in (("LEAST_ROWS", 10), ("DEALT_BLOCKS", 4), ("BLOCK_ROWS", 30)):
        monkeypatch.setattr(jaccard_join, name, value)
    # Places of every other word only, and two words in some copies: more components that reach each other by few links.
    rng, base, rows = random.Random(13), [f"w{k}" for k in range(100)], []
    for k in range(250):
        words = list(base)
        for at in rng.sample(range(0, 100, 2), rng.choice([1, 1, 2])):
            words[at] = f"z{k}"
        rows.append((k, " ".join(words)))
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_join_with_five_words_and_other_thresholds(spark):
    rows = texts(random.Random(9), 25, 60)
    for n, percent in ((5, 80), (3, 60)):
        found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent).collect()
        assert sorted(map(tuple, found)) == brute(rows, n, percent)


def test_join_defined_cases(spark):
    rows = [(5, None, 0), (6, "", 0), (7, " \n", 0), (9, "A b", 0), (3, "a  B", 0), (3, "a  B", 0), (None, "a b", 0), (8, "w " * 50_000, 0), (4, "w w w w", 0)]
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string, component_id long")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (9, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, None), (8, 1, 4), (4, 1, 4)], key=str)
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(30)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


def test_embedding_join_is_brute_force(spark, monkeypatch):
    from leadloom.llm import embedding_join

    monkeypatch.setattr(embedding_join, "BLOCK", 40)
    monkeypatch.setattr(embedding_join, "LEAF", 7)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(25):
        base = rng.normal(size=12)
        rows += [(base + rng.normal(size=12) * rng.choice([0, 0.05, 0.15, 0.25])).tolist() for _ in range(rng.integers(1, 15))]
    rows += [[3.0 * x for x in rows[0]], rows[1], None, [], [0.0] * 12, [1.0, None], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0] * 5, [2.0] * 5, [1e-200] * 5, [1e200] * 5]
    table = [(7 * k % len(rows) if len(rows) % 7 else k, v, 0) for k, v in enumerate(rows)]
    n = len(table)
    ok = {i: np.array(v, float) for i, v, _ in table if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    near = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    wanted = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        wanted.append((i, len(near.get(i, ())), min(seen), i == min(seen)))
    found = embedding_join.join(spark.createDataFrame(table, "vec_id long, embedding array<double>, n_links int").repartition(3)).collect()
    assert sorted(map(tuple, found)) == wanted
    assert embedding_join.join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
