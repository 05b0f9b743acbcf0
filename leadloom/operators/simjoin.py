"""Joins of texts by edit similarity, one less the edit distance over the longer length.

A text of l characters has l - q + 1 q-grams. An edit changes q of them at most, so two texts of which the longer has L characters and
that differ in k = (1 - least) L edits or fewer share L - q + 1 - k q of them. Ordered by frequency over all texts, rare first,
their prefixes of (k + 1) q + 1 q-grams must have one in common. So texts meet by rare q-grams, and only those whose lengths can reach the
similarity; the distance is taken once for each pair that met, and given up beyond k edits. Where the longer text is so short that nothing
needs to be shared, texts meet by their keys and lengths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack for the rounding of a similarity.
_EPS = 1e-9


def _edits(length: Column, least: float) -> Column:
    return F.floor(length * (1 - least) + _EPS).cast("int")


def _grams(text: Column, q: int) -> Column:
    """The q-grams of a text, each with the number of its occurrence, so that repeated ones differ."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substr(text, i, F.lit(q)))
    every = F.when(F.length(text) >= q, grams).otherwise(F.array().cast("array<string>"))
    return F.transform(every, lambda g, i: F.concat(g, F.size(F.filter(F.slice(every, F.lit(1), i), lambda x: x == g)).cast("string")))


def shortest_bound(least: float, q: int) -> int:
    """Up to this length of the longer text, similar texts may have no q-gram in common."""
    if least <= 1 - 1 / q:
        raise ValueError(f"{q}-grams need a similarity over {1 - 1 / q}")
    # From this length on the number of shared ones is above 0 for good.
    enough = math.ceil((q + 1) / (1 - q * (1 - least)))
    return max([n for n in range(enough + 1) if n - q + 1 - q * math.floor(n * (1 - least) + _EPS) < 1], default=0)


def similar_texts(left: DataFrame, right: DataFrame, keys: Sequence[str], least: float, q: int = 2) -> DataFrame:
    """keys, a, b and ratio of the distinct texts a of left and b of right with equal keys and a similarity of at least least.

    left has the columns keys and a, right keys and b, each row once. Two empty texts are equal.
    """
    short = shortest_bound(least, q)
    texts = left.select(F.col("a").alias("text")).unionAll(right.select("b")).distinct()
    grams = texts.select("text", F.explode(_grams(F.col("text"), q)).alias("gram"))
    ranked = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    # A prefix is bounded by the text's own length.
    kept = (_edits(F.length("text"), least) + 1) * q + 1
    prefixes = ranked.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g")).select("text", F.transform(F.slice("g", F.lit(1), kept), lambda x: x["gram"]).alias("prefix"))

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        found = rows.join(prefixes, rows[side] == prefixes["text"], "left").drop("text")
        marks = F.concat(F.coalesce("prefix", F.array().cast("array<string>")), F.when(F.length(side) <= short, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        return found.select(*keys, side, F.explode(marks).alias("mark"))

    la, lb = F.length("a"), F.length("b")
    most = _edits(F.greatest(la, lb), least)
    met = keyed(left, "a").join(keyed(right, "b"), [*keys, "mark"]).where(F.abs(la - lb) <= most).select(*keys, "a", "b").distinct()
    distance = F.expr(f"levenshtein(a, b, cast(floor(greatest(length(a), length(b)) * {1 - least!r} + {_EPS!r}) as int))")
    ratio = F.when(F.greatest(la, lb) == 0, 1.0).otherwise(1 - F.col("edits") / F.greatest(la, lb))
    return met.withColumn("edits", distance).where("edits >= 0").select(*keys, "a", "b", ratio.alias("ratio"))
