"""Exact deduplication against a persistent digest index.

The index is a Parquet table of (digest, keep_id), bucketed and sorted by the SHA-256 digest, at a
location that outlives the session. A batch is deduplicated within itself, anti-joined with the
index by sort-merge join (the index side needs no shuffle), and its new digests are appended. A
batch that is sent again after a failure changes nothing: its digests are there with their keep_id.

Cases: null text is empty text; all empty texts are one group. White-space runs count as one space,
but texts aren't trimmed. A repeated doc_id with the same text is the same document seen again: each
of its rows carries the same decision. A null doc_id loses to any other. Columns besides doc_id and
text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import SPACES, new_path, written


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class DigestIndex:
    """A bucketed, sorted index at a location. The number of buckets is fixed when the index is created and kept beside it."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location = spark, location
        self.buckets = self._kept_buckets(buckets)
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def _kept_buckets(self, buckets: int) -> int:
        """The number that the files at the location were dealt by; a new index takes the given one."""
        path = f"{self.location}-buckets"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema("buckets int").parquet(path).first().buckets
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(path)
        return buckets

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Appends those (digest, keep_id) whose digest is new. groups holds a digest once."""
        new = groups.hint("merge").join(self.entries(), "digest", "left_anti")
        new.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size (rows of this batch), kept, text_sha256."""
    digests, _ = written(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal_text(F.col(text_col)), 256)).alias("digest")), "digests"
    )
    groups, _ = written(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    index.add(groups)
    # Written, so that both sides of the last join are shuffled and a hot digest can be split.
    decided, _ = written(groups.drop("keep_id").hint("merge").join(index.entries(), "digest"), "decided")
    return digests.join(decided, "digest").select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own in the shared folder."""
    return DigestIndex(spark, new_path(spark, "index"), buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


ORACLE_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
