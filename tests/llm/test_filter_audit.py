"""The audit against documents that walk through every order, and the carry-save counts against plain sums."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from leadloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part int, digest string, word string, n long, good string"
WORDS = " ".join(f"w{k}" for k in range(60))
TEXTS = [WORDS, WORDS + " #", "few words", "", None, "same " * 80, WORDS.upper(), "A" * 9 + "b" * 171 + " ", WORDS + " x", " \t\n", "x " * 49 + "y", WORDS + " " * 5000 + "end %", "Ü" * 300, WORDS + "\x0bmore"]


def fails(text, smaller):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), smaller]
    return "".join(x for x, t in zip("ABCDE", tests, strict=True) if t)


def wanted(docs, labels):
    known = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in known:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    quality = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out, total = {}, Counter()
    for i, t, s in known:
        f = fails(t, i is not None and i > least[t])
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((s, "".join(order), step), Counter())
                if not gone and x in f:
                    row["removed"] += 1
                    row["good_lost"] += i in quality and i is not None
                    row["toxic_lost"] += i in toxic and i is not None
                    total[s, x] += 1
                    gone = True
                elif not gone:
                    row["kept"] += 1
                elif x in f:
                    row["redundant"] += 1
                row["unique_fails"] += f == x
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: (*[r[n] for n in names], total[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def test_audit_equals_walks(spark):
    rng = random.Random(8)
    docs = [(k, rng.choice(TEXTS), rng.choice(["a", "b", None, "", "é"])) for k in rng.sample(range(500), 150)]
    docs += [(docs[0][0], docs[0][1], "a"), (docs[1][0], "other text", "b"), (None, WORDS, "a"), (None, WORDS, None)]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs[:90]] + [(docs[3][0], 1, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "x", "y", 2, "z") for d in docs], SCHEMA).repartition(4)
    found = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(found) == len({d[2] or "" for d in docs}) * 600
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found} == wanted(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    assert filter_audit.audit(spark.createDataFrame([(1, None, None, 0, "", "", 0, "")], SCHEMA), labels).count() == 600


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100, 5000])
def test_carry_save_counts(n):
    rng = np.random.default_rng(n)
    words, group = rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, max(1, n // 3), n)
    found = filter_audit.popcounts(words, group, n)
    want = np.zeros((n, 32), np.int64)
    np.add.at(want, group, (words[:, None] >> np.arange(32, dtype=np.uint32)) & 1)
    assert (found == want).all()
    groups, sums = filter_audit.planes(words[np.argsort(group, kind="stable")], np.sort(group))
    assert all(len(set(g.tolist())) == len(g) for g in groups) and len(sums) <= n.bit_length()
