"""Filter interaction audit: which documents five filters remove, alone and in every order, from one word per document.

A document that fails the filters in the set f survives the filters in the set S if f and S have none in common. Its
truth-table word has 32 bits, one per subset S of ABCDE, set where it survives S. Positional popcounts of these
words, per part and label, are the survivors of all 32 subsets, and every figure of every order is a difference of two of
them: nothing is counted again for the 120 orders.

The popcounts are taken by carry-save adders: three words of one weight become a sum word of that weight and a carry word of
the next, bit by bit for all 32 positions at once, until each (part, label) has one word per weight. That is done for the rows
of one Arrow batch at a time, so memory doesn't depend on the number of parts; Spark adds the batches' counts by part and subset.

Filter E (an equal text with a smaller doc_id) is decided by a minimum per SHA-256 digest, which combines before the shuffle,
and a join back of 40 bytes a document; the digests are written first, so that a digest with many copies can be split.

Cases: a null text is empty; a null or empty source is the part "". A null doc_id is never larger than another, so it
doesn't fail E, and it makes no other row fail. Rows that repeat a doc_id count as documents of their own, and none of them fails E for the
other. A document is of good quality or toxic if any of its label rows says so; null labels say nothing. Texts are read whole. Other columns
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SPACES, WORD, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)

#: The filters' limits: words at least, percent of distinct words at least, percent of capitals at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def failing(rows: DataFrame) -> DataFrame:
    """rows with the column fails: which of A to D the text fails, as the bits 0 to 3 of an integer."""
    rows = rows.withColumn("words", F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), SPACES))
    rows = rows.withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words")), "blank": ~F.col("text").rlike(WORD)})
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    tests = [
        F.col("blank") | (F.col("n") < LEAST_WORDS),
        ~F.col("blank") & (F.col("distinct") * 100 < F.col("n") * LEAST_DISTINCT),
        capitals * 100 > F.length("text") * MOST_CAPITALS,
        F.col("text").rlike("[#$%&*|]"),
    ]
    bits = [F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)]
    return rows.withColumn("fails", bits[0] + bits[1] + bits[2] + bits[3]).drop("words", "n", "distinct", "blank")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits 0 to 4), good and toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = failing(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")))
    rows, _ = written(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "fails"), "judged")
    first, _ = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "first")
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return (
        rows.join(first, "digest", "left")
        .join(marks, "doc_id", "left")
        .select(
            "doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)).alias("fails"),
            *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")],
        )
    )


def truth_word(fails: Column) -> Column:
    """The 32-bit word, as a long: bit S is set if no filter of the subset S is failed."""
    bits = F.array(*[F.lit(sum(1 << s for s in range(SUBSETS) if not s & f)).cast("long") for f in range(SUBSETS)])
    return F.element_at(bits, fails + 1)


def planes(words: np.ndarray, group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Adds up words per group by carry-save adders: per weight 2^k, the groups and their one word of that weight.

    group must be ascending. Every step works on all groups at once: of each group's words, full triples go through an adder,
    and the last two through a half adder when no triple is left.
    """
    groups, sums = [], []
    while len(words):
        carried_words, carried_groups = [], []
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            if sizes.max() == 1:
                break
            rank = np.arange(len(group)) - np.repeat(starts, sizes)
            room = np.repeat(sizes, sizes)
            full = room // 3 * 3
            at = np.flatnonzero((rank % 3 == 0) & (rank < full))
            a, b, c = words[at], words[at + 1], words[at + 2]
            two = np.flatnonzero((room == 2) & (rank == 0))
            p, q = words[two], words[two + 1]
            carried_words += [(a & b) | (a & c) | (b & c), p & q]
            carried_groups += [group[at], group[two]]
            rest = np.flatnonzero((rank >= full) & (room != 2))
            words, group = np.concatenate([a ^ b ^ c, p ^ q, words[rest]]), np.concatenate([group[at], group[two], group[rest]])
            order = np.argsort(group, kind="stable")
            words, group = words[order], group[order]
        sums.append(words)
        groups.append(group)
        words = np.concatenate(carried_words) if carried_words else words[:0]
        group = np.concatenate(carried_groups) if carried_groups else group[:0]
        order = np.argsort(group, kind="stable")
        words, group = words[order], group[order]
    return groups, sums


def popcounts(words: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """How many of a group's words have each bit: (n_groups, 32)."""
    counts = np.zeros((n_groups, SUBSETS), np.int64)
    order = np.argsort(group, kind="stable")
    for k, (at, word) in enumerate(zip(*planes(words[order], group[order]), strict=True)):
        counts[at] += (word[:, None] >> np.arange(SUBSETS, dtype=np.uint32) & np.uint32(1)).astype(np.int64) << k
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").dictionary_encode()
        code = part.indices.to_numpy()
        word = batch.column("word").to_numpy().astype(np.uint32)
        kinds = [np.ones(len(code), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
        found = [popcounts(word[k], code[k], len(part.dictionary)).ravel() for k in kinds]
        names = part.dictionary.take(pa.array(np.repeat(np.arange(len(part.dictionary)), SUBSETS)))
        subset = np.tile(np.arange(SUBSETS, dtype=np.int32), len(part.dictionary))
        yield pa.RecordBatch.from_arrays([names, pa.array(subset), *map(pa.array, found)], ["part", "subset", "n", "good", "toxic"])


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset and the survivors of that subset's filters: n, good, toxic. rows: part, fails, good, toxic."""
    words = rows.select("part", truth_word(F.col("fails")).alias("word"), "good", "toxic")
    counted = words.mapInArrow(_counted, "part string, subset int, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders(survived: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of all subsets."""
    every = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    parts = survived.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    rows = parts.select("part", *[F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic")], F.explode(every).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii(substring(filter_order, k, 1)) - 65)"
    rows = rows.withColumns({
        "before": F.expr(f"aggregate(filter(sequence(1, 5), k -> k < step), 0, (m, k) -> m | {bit})"),
        "own": F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"),
    }).withColumn("after", F.expr("before | own"))
    at = lambda column, subset: F.expr(f"{column}[{subset}]")
    removed = at("n", "before") - at("n", "after")
    # A filter meets a subset S of the others first in |S|! (4 - |S|)! of the orders.
    shapley = "aggregate(filter(sequence(0, 31), s -> s & own = 0), 0L, (t, s) -> t + array(24, 6, 4, 6, 24)[bit_count(s)] * (n[s] - n[s | own]))"
    return rows.select(
        "part", "filter_order", "step", at("n", "after").alias("kept"), removed.alias("removed"),
        (at("n", "0") - at("n", "own") - removed).alias("redundant"), (at("n", "31 - own") - at("n", "31")).alias("unique_fails"),
        (at("good", "before") - at("good", "after")).alias("good_lost"), (at("toxic", "before") - at("toxic", "after")).alias("toxic_lost"),
        F.expr(shapley).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(survivors(judged(docs, labels)))


#: Written from the filters' definition: each document walks through each order, without subsets or words.
ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
failing AS (
  SELECT part,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS f,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = cut.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = cut.doc_id AND l.toxic = 1) AS toxic
  FROM cut),
kinds AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) t(step)),
walked AS (
  SELECT part, filter_order, step, own, n, good, toxic, f, contains(f, own) AS fails, length(translate(before, f, '')) < length(before) AS gone
  FROM kinds, steps),
counted AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (f = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
