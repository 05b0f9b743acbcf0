"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a min per node and a join; its result is written to the shared folder, so lineage stays
short and a lost executor costs one round at most. The mins are written before they are joined, so that both
sides of the join are plain shuffles and the neighbourhood of a hub can be split over tasks. Rounds needed grow
with the logarithm of a component's diameter.

Cases: edges from a node to itself and repeated edges change nothing; null ends aren't allowed; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadloom.llm.common import released, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both(edges).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges go from the larger node a to the smaller b."""
    rest = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b), but for the smallest nodes themselves."""
    spark = edges.sparkSession
    now, path = written(_downward(edges), "edges")
    state = None
    while True:
        least, least_path = written(_both(now).groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large, large_path = written(_downward(_large_star(now, least)), "edges")
        below, below_path = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        seen = Observation()
        after = _downward(_small_star(large, below)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest"))
        after, new_path = written(after, "edges")
        found = (seen.get["n"], seen.get["digest"])
        released(spark, path, least_path, large_path, below_path)
        now, path = after, new_path
        if found == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = found
