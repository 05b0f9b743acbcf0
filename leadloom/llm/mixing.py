"""Mixing sources to target weights by Pareto order sampling.

Sizes are counted in words. Each source gets a share of all words by its weight, at most max_repeat
times what it holds; what a capped source can't take is shared again by weight. In closed form a
target is least(max_repeat * size, level * weight) for one level, found from running sums over the
sources. Every document of a source first gets floor(target / size) certain whole copies. The words
still missing come from a sample of one further copy each, with inclusion probability in proportion
to the document's size (those that would pass 1 are certain): documents are ranked by random odds
divided by inclusion odds, and the rank order is taken until the missing words are reached, to
within half of the last document.

Only tables with a row per source, per (source, size) or per (source, bin of the rank) pass through
windows; the rank order itself is cut at a bin of 2^-12, then of 2^-24, and only that last bin is
sorted, so a source with any share of the documents is never sorted in one task.

Random numbers are digests of doc_id and a seed, so reruns agree. Cases: null text has size 0 and
takes nothing; a null source is a source of its own, after all others; repeated rows are ranked
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import WORD, written

BINS = 4096


def _targets(docs: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """A row per source: source_size, target, whole (certain copies of each document), missing (words to sample)."""
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(ordered) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * max_repeat
    by_ratio = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    # level if this source and all of smaller cap per weight were capped
    level = (F.sum("source_size").over(everything) - (F.sum(cap).over(upto) - cap)) / (
        F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight"))
    )
    levels = weighted.withColumn("level", level)
    first_uncapped = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct((cap / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(everything)
    target = F.least(cap.cast("double"), F.coalesce(first_uncapped["l"], F.lit(float("inf"))) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        levels.withColumn("target", target)
        .withColumn("whole", whole)
        .select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing"))
    )


def _inclusion(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per source: factor, so that a document's inclusion probability is least(1, factor * size)."""
    sizes = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    up = Window.partitionBy("source").orderBy("size")
    words = F.col("size").cast("double") * F.col("n")
    table = sizes.withColumn("larger", F.sum(words).over(down) - words).withColumn("squares", F.sum(words * F.col("size")).over(up))
    joined = table.join(targets, table["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    factor = (F.col("missing") - F.col("larger")) / F.col("squares")
    fits = factor * F.col("size") <= 1
    return joined.groupBy("source").agg(F.max_by(F.when(fits, factor), F.when(fits, F.col("size"))).alias("factor"))


def _rank(seed: str) -> tuple[Column, Column]:
    """Random odds over inclusion odds, and its place in 2^24 equal bins of q / (1 + q)."""
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    p = F.col("factor") * F.col("size")
    q = F.when(p >= 1, F.lit(0.0)).otherwise(F.try_divide(u / (1 - u), p / (1 - p)))
    return q, F.when(F.col("q") == 0, F.lit(-1)).otherwise(F.floor(F.col("q") / (1 + F.col("q")) * float(BINS * BINS))).cast("long")


def _boundary(docs: DataFrame, bin_col: Column, name: str) -> DataFrame:
    """A row per source: the bin (name) in which its missing words are reached, and the words before it."""
    bins = docs.groupBy("source", "missing", bin_col.alias("bin")).agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("source").orderBy("bin")
    passed = bins.withColumn("upto", F.sum("words").over(ordered)).where(F.col("upto") > F.col("missing"))
    first = passed.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("b"))
    return first.select("source", F.col("b.bin").alias(name), F.col("b.before").alias(name + "_before"))


def _with(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of a table with a row per source; null sources meet."""
    return docs.join(table, docs["source"].eqNullSafe(table["source"]), "left").drop(table["source"])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    docs, _ = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    targets, _ = written(_targets(docs, weights, max_repeat), "targets")
    factors, _ = written(_with(targets, _inclusion(docs, targets)), "factors")
    q, place = _rank(seed)
    ranked = _with(docs, factors).withColumn("q", q).withColumn("place", place)
    open_ = ranked.where("size > 0 and factor is not null and missing > 0")
    high = F.floor(F.col("place") / BINS)
    one, _ = written(_boundary(open_, high, "b1"), "bins1")
    inside = _with(open_, one).where(high == F.col("b1"))
    inside, _ = written(inside.withColumn("missing", F.col("missing") - F.col("b1_before")), "inside")
    two, _ = written(_boundary(inside, F.col("place"), "b2"), "bins2")
    last = _with(inside, two).where("place = b2")
    order = Window.partitionBy("source").orderBy("q", "doc_id")
    taken = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    fits = last.where("true").withColumn("half", taken).where(F.col("half") <= F.col("missing") - F.col("b2_before"))
    cut = fits.groupBy("source").agg(F.max(F.struct("q", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("cut"))
    limits, _ = written(_with(_with(_with(factors, one), two), cut), "limits")
    extra = (
        F.when(~((F.col("size") > 0) & F.col("factor").isNotNull() & (F.col("missing") > 0)), False)
        .when(F.col("b1").isNull() | (high < F.col("b1")), True)
        .when(high > F.col("b1"), False)
        .when(F.col("b2").isNull() | (F.col("place") < F.col("b2")), True)
        .when(F.col("place") > F.col("b2"), False)
        .otherwise(F.coalesce(F.struct("q", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")) <= F.col("cut"), F.lit(False)))
    )
    copies = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")
    final = _with(docs, limits).withColumn("q", q).withColumn("place", place).withColumn("copies", copies)
    return final.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), weighted AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap,
    ((sum(source_size) OVER ())::BIGINT - ((sum(3 * source_size) OVER r)::BIGINT - 3 * source_size))::DOUBLE
      / ((sum(weight) OVER ())::BIGINT - ((sum(weight) OVER r)::BIGINT - weight))::DOUBLE AS level
  FROM weighted
  WINDOW r AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, cap::DOUBLE / weight::DOUBLE) FROM levels WHERE level * weight <= cap), 'inf'::DOUBLE) * weight) AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS missing
  FROM targets
), sizes AS (
  SELECT source, size, sum(size::DOUBLE * n) OVER (PARTITION BY source ORDER BY size DESC) - size::DOUBLE * n AS larger,
    sum(size::DOUBLE * n * size) OVER (PARTITION BY source ORDER BY size) AS squares
  FROM (SELECT source, size, count(*) AS n FROM docs WHERE size > 0 GROUP BY source, size)
), factors AS (
  SELECT s.source, arg_max((missing - larger) / squares, size) AS factor
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
  WHERE (missing - larger) / squares * size <= 1 GROUP BY s.source
), ranked AS (
  SELECT d.doc_id, d.source, d.size, source_size, target, whole, missing, factor,
    (('0x' || substr(md5(concat(d.doc_id, ':mix')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
  LEFT JOIN factors f ON d.source IS NOT DISTINCT FROM f.source
), ordered AS (
  SELECT *, CASE WHEN factor * size >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / ((factor * size) / (1 - factor * size)) END AS q,
    size > 0 AND factor IS NOT NULL AND missing > 0 AS open
  FROM ranked
), summed AS (
  SELECT *, sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY open DESC, q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS half
  FROM ordered
)
SELECT doc_id, source, size, source_size, target, whole + CASE WHEN open AND half <= missing THEN 1 ELSE 0 END AS copies,
  (whole + CASE WHEN open AND half <= missing THEN 1 ELSE 0 END) * size AS taken
FROM summed
"""
