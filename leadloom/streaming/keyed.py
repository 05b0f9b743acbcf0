"""A keyed table that micro-batches keep up: merge on read, compaction in the background of batches.

Layout below a folder: delta/<batch>/<bucket> holds the newest row per key of a batch, base/<batch>/<bucket> the newest row per key
of a bucket up to that batch. A batch writes its own keys only. A read takes for each bucket its newest base and the deltas after it,
and the newest version per key of both. Compaction rewrites the buckets that were touched. A folder counts once its writer has
marked it as complete, so a batch that failed half-way isn't seen, and one that is run again replaces its own delta or,
if its bucket is compacted already, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Names of the folders and of the columns that they stand for; a table's own columns have other names.
BATCH, BUCKET = "keyed_batch", "keyed_bucket"


class KeyedTable:
    """Rows of one schema by key; of two rows of a key the one with the higher version stays, of equal ones the later batch's."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, version: Column, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.version, self.buckets = spark, path.rstrip("/"), schema, key, version, buckets

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, path: str, name: str) -> list[int]:
        """The numbers of the sub-folders <name>=<number>."""
        fs, at = self._fs(path)
        if not fs.exists(at):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return sorted(int(x.partition("=")[2]) for x in found if x.startswith(f"{name}="))

    def _complete(self, kind: str) -> list[int]:
        numbers = self._numbers(f"{self.path}/{kind}", BATCH)
        return [n for n in numbers if (x := self._fs(f"{self.path}/{kind}/{BATCH}={n}/_SUCCESS"))[0].exists(x[1])]

    def _files(self) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Per bucket its newest base, and the (batch, bucket) deltas after it."""
        base: dict[int, int] = {}
        for v in self._complete("base"):
            base.update(dict.fromkeys(self._numbers(f"{self.path}/base/{BATCH}={v}", BUCKET), v))
        deltas = [(n, b) for n in self._complete("delta") for b in self._numbers(f"{self.path}/delta/{BATCH}={n}", BUCKET)]
        return base, [(n, b) for n, b in deltas if n > base.get(b, -1)]

    def _rows(self, kind: str, folders: list[tuple[int, int]]) -> DataFrame:
        """Rows of (batch, bucket) folders, with both numbers."""
        schema = StructType([*self.schema.fields, StructField(BATCH, IntegerType()), StructField(BUCKET, IntegerType())])
        paths = [f"{self.path}/{kind}/{BATCH}={n}/{BUCKET}={b}" for n, b in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*self.schema.names), F.struct(self.version.alias("version"), F.col(BATCH).alias("batch")))
        return rows.groupBy(BUCKET, self.key).agg(best.alias("r")).select(BUCKET, "r.*")

    def _merged(self, touched: bool = False) -> DataFrame:
        base, deltas = self._files()
        buckets = {b for _, b in deltas} if touched else set(base)
        kept = [(v, b) for b, v in sorted(base.items()) if b in buckets]
        return self._newest(self._rows("base", kept).unionByName(self._rows("delta", deltas)))

    def read(self) -> DataFrame:
        """The newest row of every key, from what is complete in the folder now."""
        return self._merged().select(*self.schema.names)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Adds a batch under its number; numbers ascend."""
        keyed = batch.select(*self.schema.names, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET), F.lit(number).alias(BATCH))
        self._newest(keyed).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta/{BATCH}={number}")

    def compact(self, most_deltas: int = 0) -> None:
        """Rewrites the touched buckets if there are more than most_deltas batches of deltas, and drops the files that they replace."""
        base, deltas = self._files()
        numbers = {n for n, _ in deltas}
        if len(numbers) <= most_deltas:
            return
        newest = max(numbers)
        self._merged(touched=True).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/base/{BATCH}={newest}")
        dropped = [f"{self.path}/delta/{BATCH}={n}" for n in self._numbers(f"{self.path}/delta", BATCH) if n <= newest]
        dropped += [f"{self.path}/base/{BATCH}={base[b]}/{BUCKET}={b}" for b in {b for _, b in deltas} if b in base]
        for path in dropped:
            fs, at = self._fs(path)
            fs.delete(at, True)
