"""What the operators share: written intermediate tables and the contract's notion of a word."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leadloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder (it outlives lost executors and cuts lineage), and its path."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that no later plan reads."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forgotten(spark: SparkSession) -> None:
    """Collects plans that nothing refers to any more: Spark deletes the shuffle files of those that the driver has collected.

    Results that later steps need are written tables by then, so nothing is computed again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: bytes.lower and bytes.split do just that."""
    return text.lower().split() if text else []


def as_bytes(column: str = "text"):
    """The text as UTF-8 for Python tasks, which saves decoding there; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class Memory:
    """Values by key, computed for many keys at once. It keeps the keys used last: size of them at least, twice as many at most."""

    def __init__(self, compute, size: int):
        self.compute, self.size = compute, size
        self.recent: dict = {}
        self.older: dict = {}

    def values(self, keys: list) -> list:
        """The values of keys (never None), in one pass where few are absent."""
        found = list(map(self.recent.get, keys))
        if None not in found:
            return found
        if len(self.recent) > self.size:
            self.recent, self.older = {}, self.recent
        recent, places, new = self.recent, [k for k, v in enumerate(found) if v is None], []
        for key in dict.fromkeys([keys[k] for k in places]):
            if (value := self.older.get(key)) is not None:
                recent[key] = value
            else:
                new.append(key)
        if new:
            recent.update(zip(new, self.compute(new), strict=True))
        for k in places:
            found[k] = recent[keys[k]]
        return found
