"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
import random
import re

import corpus_pipeline
from leadloom.llm import mixing, toxicity
from tests.conftest import SF
from tests.llm.test_near import brute

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
    inputs.append(docs)
    rows = [[r.asDict() for r in d.collect()] for d in inputs]

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.fit(toxicity.sample_of(inputs[0], labels)).scorer()
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if scorer.score(r["text"].encode()) < 0.7}

    first = {}
    for r in sorted(rows[1], key=lambda r: r["doc_id"]):
        first.setdefault(SPACES.sub(" ", r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(first.values())

    linked = brute([(r["doc_id"], r["text"]) for r in rows[2]], 5, 80)
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(i for i, _, c in linked if i == c)

    copies = {r.doc_id: r.copies for r in mixing.mix(inputs[3]).collect()}
    assert sorted(r["doc_id"] for r in rows[4]) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(hashlib.sha256(r["text"].encode()).digest() for r in rows[4])

    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    assert len(rows[5]) == len(rows[4]) and all(r["round_trip"] and bool(r["ids"]) == bool(texts[r["doc_id"]]) for r in rows[5])


def near_groups(rows, n, percent):
    """The smallest id of each group of texts linked by their sets of word n-grams."""
    sets = [(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) for i, t in rows for w in [t.split()]]
    group = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                x, y = sorted((group[i], group[j]))
                group = {g: x if c == y else c for g, c in group.items()}
    return sorted(set(group.values()))


def test_near_copies_are_five_words_and_four_fifths(spark):
    rng, rows = random.Random(8), []
    for family in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        scattered, added = list(base), list(base)
        for at in range(5, len(base) - 5, 48):
            scattered[at] = "edited"
        at = rng.randrange(len(base))
        added[at:at] = [f"x{family}_{k}" for k in range(rng.randint(len(base) // 8, len(base) // 3))]
        rows += [(3 * family + k, " ".join(words)) for k, words in enumerate((base, scattered, added))]
    wanted = near_groups(rows, 5, 80)
    assert wanted != near_groups(rows, 4, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == wanted


def test_defined_cases(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None, None), (2, "", None), (3, words, "a"), (3, words, "a"), (4, words + " ", "a"), (5, words + " more", "b"), (None, "alone in the world", "b"), (6, "long " * 60_000, "b")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, score int, copies int, kept_id int, copy__ int")
    kept = corpus_pipeline.drop_exact_copies(spark, corpus_pipeline.drop_toxic(spark, docs, SF), SF)
    assert kept.columns == docs.columns and {tuple(r)[3:] for r in kept.collect()} == {(1, 2, 3, 4)}
    near = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert near.columns == docs.columns and sorted(str(r.doc_id) for r in near.collect()) == sorted(map(str, [1, 3, 3, 6, None]))
    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    assert mixed.columns == docs.columns and 1 not in {r.doc_id for r in mixed.collect()}
    out = corpus_pipeline.encode(spark, mixed, SF)
    assert out.columns == ["doc_id", "source", "ids", "round_trip"] and all(r.round_trip for r in out.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
