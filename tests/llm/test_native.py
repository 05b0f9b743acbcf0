"""Exact dedup, mixing and toxicity: defined cases and plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from leadloom.llm import exact_dedup, mixing, toxicity
from leadloom.llm.common import new_path

SCHEMA = "doc_id long, text string, source string, keep_id long, size long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def test_exact_dedup_cases(spark):
    rows = [(5, "a  b", "x"), (3, "a\n\tb", "x"), (9, " a b", "x"), (4, None, "x"), (2, "", None), (7, "\n", "x"), (3, "a b", "x"), (None, "a b", "x")]
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs(spark, rows), exact_dedup.fresh_index(spark)).collect()}
    assert found == {(5, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False), (9, 9, 1, True), (4, 2, 2, False), (2, 2, 2, True), (7, 7, 1, True)}
    sha = exact_dedup.deduplicate(docs(spark, [(1, "a  b", "x")]), exact_dedup.fresh_index(spark)).first().text_sha256
    assert sha == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.deduplicate(docs(spark, []), exact_dedup.fresh_index(spark)).count() == 0


def test_index_outlives_batches(spark):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), buckets=4)
    first = docs(spark, [(10, "a", "x"), (11, "b", "x")])
    for _ in range(2):  # a batch that is sent again changes nothing
        assert {(r.doc_id, r.kept) for r in exact_dedup.deduplicate(first, index).collect()} == {(10, True), (11, True)}
    spark.sql(f"DROP TABLE {index.table}")  # a new session attaches to the location
    again = exact_dedup.DigestIndex(spark, index.location, buckets=9)
    assert again.buckets == 4  # the number is the index's own
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(docs(spark, [(1, "a", "x"), (2, "c", "x"), (3, "c", "x")]), again).collect()} == {(1, 10, False), (2, 2, True), (3, 2, False)}
    assert again.entries().count() == 3


def test_mixing_reaches_targets(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        source = rng.choice(["a"] * 12 + ["b", "c", "d", None])
        rows.append((k, " ".join("w" for _ in range(int(rng.paretovariate(1.2)) * 5)), source))
    rows += [(2000, None, "a"), (2001, "", "e"), (5, rows[5][1], rows[5][2])]
    found = mixing.mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:  # the excess shared again until none is above
        left = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * w / open_weight for s, w in weight.items()}
        over = {s for s in weight if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    syllables = ["ka", "lo", "mi", "ter", "san", "vo", "ri", "dem", "pul", "ash"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        words = [word() for _ in range(rng.randint(20, 80))]
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["grumpleworst", "zibnak", "Fudgewit", "quorx"])
        rows.append((k, " ".join(words), None, None, None))
        labels.append((k, int(toxic)))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), (None, "kalo", None, None, None), (2002, "ka " * 40_000, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels + [(1, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.classify(table, known).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    held = [(found[k].predicted, t) for k, t in labels if found[k].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert found[2000].score == found[2001].score and not found[2000].predicted and not found[2002].predicted
    none = toxicity.classify(table, known.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.classify(table.limit(0), known.limit(0)).count() == 0


def test_toxicity_windows_are_whole_words_and_lengths_are_zstandards(spark):
    import zstandard as z

    rng = random.Random(4)
    for _ in range(50):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 3, 9, 40, 130]))) for _ in range(rng.randint(0, 60))]
        cut = toxicity.windows(words)
        assert b"".join(w for x in cut for w in x.split()) == b"".join(words)
        assert all(x[:1] == x[-1:] == b" " and len(x) < 2 * toxicity.WINDOW + 3 for x in cut) and all(len(x) > toxicity.WINDOW for x in cut[:-1])
    model = toxicity.Model(b" grumpleworst zibnak fudgewit" + b" ka lo mi ter san" * 20, b" ka lo mi ter san" * 20, [0.0] * (toxicity.HIGHEST - toxicity.LOWEST + 1))
    how = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4)

    def length(content, window):
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress(window))

    words = [rng.choice([b"ka", b"lo", b"grumpleworst", b"other", b"zibnak"]) for _ in range(400)]
    wanted = [max(toxicity.LOWEST, min(toxicity.HIGHEST, length(model.ordinary, x) - length(model.toxic, x))) for x in toxicity.windows(words)]
    assert (model.scorer().compare(words) + toxicity.LOWEST).tolist() == wanted and max(wanted) > 3


def test_a_toxic_passage_counts_in_a_long_text():
    rng = random.Random(9)
    syllables = ["ka", "lo", "mi", "ter", "san", "vo", "ri", "dem", "pul", "ash"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grumpleworst", "zibnak", "fudgewit", "quorx"]
    sample = []
    for k in range(600):
        words = [word() for _ in range(rng.randint(150, 300))]
        for _ in range(6 * (k % 3 == 0)):
            words[rng.randrange(len(words))] = rng.choice(bad)
        sample.append((" ".join(words).encode(), int(k % 3 == 0)))
    scorer = toxicity.fit(sample).scorer()
    clean = [word() for _ in range(30_000)]
    passage = [w for _ in range(8) for w in (word(), rng.choice(bad))]
    assert scorer.score(" ".join(clean).encode()) < 0.7
    assert scorer.score(" ".join(clean[:15_000] + passage + clean[15_000:]).encode()) >= 0.7
