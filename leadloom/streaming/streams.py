"""Streaming forms of ingest, price drops, series and upserts. Each takes a streaming DataFrame; sinks are the caller's."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from leadloom.streaming.keyed import KeyedTable


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def drop_alerts(stream: DataFrame, key: str, price: str, ts: str, span: str = "30 days", slide: str = "1 day", delay: str = "1 day", min_drop: float = 0.05) -> DataFrame:
    """Per key and sliding span the drop from the first peak to the last price, if it is min_drop or more."""
    p, t = F.col(price), F.col(ts)
    found = stream.withWatermark(ts, delay).groupBy(F.window(ts, span, slide), key).agg(F.count("*").alias("n"), F.max(p).alias("peak"), F.max_by(p, F.struct(t, p)).alias("last"))
    drop = (F.col("peak") - F.col("last")) / F.col("peak")
    return found.where((F.col("n") >= 2) & (F.col("peak") > 0)).where(drop >= min_drop).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "peak", "last", F.round(drop, 4).alias("drop_pct"))


def day_series(stream: DataFrame, ts: str, value: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean")).select(F.col("window.start").alias("day"), "n", "mean")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upserting(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands every micro-batch to apply, which must be idempotent per batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def upserted_table(stream: DataFrame, key: str, version: Column, base: str, most_deltas: int = 8) -> DataFrame:
    """The row of the highest version of every key, kept up by micro-batches over what is there now.

    A batch writes the newest rows of its own keys beside the table; buckets are compacted after more than most_deltas batches. A
    batch that is run again, and a restart without new rows, give the same table.
    """
    table = KeyedTable(stream.sparkSession, f"{base}/table", stream.schema, key, version)

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(batch, number)
        table.compact(most_deltas)

    upserting(stream, apply, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()


class _Late(StreamingQueryListener):
    """Adds up the rows that each batch of a query dropped behind the watermark; the query's own progress list keeps the last hundred batches only."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.rows[str(event.progress.runId)] = self.rows.get(str(event.progress.runId), 0) + found

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))


def counted_with_late(stream: DataFrame, ts: str, span: str, delay: str, base: str) -> DataFrame:
    """Rows per span as far as the watermark closed it, and in late how many rows in all came after their span was closed."""
    spark, late = stream.sparkSession, _Late()
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, span)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    spark.streams.addListener(late)
    try:
        query = counts.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(600):  # events come in order, a little after the query's end
            if str(query.runId) in late.ended:
                break
            time.sleep(0.1)
        else:
            raise TimeoutError("the query's last event didn't come within a minute")
    finally:
        spark.streams.removeListener(late)
    n = late.rows.get(str(query.runId), 0)
    return spark.read.parquet(f"{base}/out").select(F.col("start").cast("string").alias("start"), "n", F.lit(n).cast("long").alias("late"))


class _Drops(StatefulProcessor):
    """A key's state: the prices of the span that can still be a peak (later ones are lower), and rows that the watermark hasn't passed."""

    def __init__(self, span: int, least: float):
        self.span, self.least = span, least

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("history", "peak_at array<long>, peak array<double>, next_at array<long>, next array<double>")

    def _advanced(self, key, times, new: list[tuple[int, float]]) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ([], [], [], [])
        peaks = deque(zip(held[0], held[1], strict=True))
        waiting = [*zip(held[2], held[3], strict=True), *new]
        passed = times.getCurrentWatermarkInMs() * 1000
        out = []
        for at, same in groupby(sorted(x for x in waiting if x[0] <= passed), key=lambda x: x[0]):
            prices = [p for _, p in same]
            while peaks and peaks[0][0] < at - self.span:
                peaks.popleft()
            while peaks and peaks[-1][1] <= prices[-1]:
                peaks.pop()
            peaks.append((at, prices[-1]))
            top = peaks[0][1]
            out += [(key[0], at, p, top, (top - p) / top) for p in prices if top > 0 and (top - p) / top >= self.least]
        waiting = [x for x in waiting if x[0] > passed]
        if not waiting and (not peaks or peaks[-1][0] < passed - self.span):
            self.state.clear()
        else:
            at, peak = zip(*peaks, strict=True) if peaks else ((), ())
            next_at, prices = zip(*waiting, strict=True) if waiting else ((), ())
            self.state.update((list(at), list(peak), list(next_at), list(prices)))
            # When the first waiting row is due, or when nothing of the state can matter any more.
            self.handle.registerTimer((min(next_at) if waiting else peaks[-1][0] + self.span) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "at", "price", "peak", "drop_pct"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(t), float(p)) for df in rows for t, p in zip(df["at"], df["price"], strict=True)]
        yield from self._advanced(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advanced(key, timerValues, [])

    def close(self) -> None:
        pass


def drops_by_key(stream: DataFrame, key: str, price: str, ts: str, span_days: float = 30, delay: str = "1 day", min_drop: float = 0.05) -> DataFrame:
    """Observations that lie min_drop or more under the highest price of the span_days before them: key, ts, price, peak, drop_pct.

    One state row per key instead of a copy of each row for every window it lies in. Rows may come in any order within delay; each is
    rated once the watermark has passed it, in the order of its time, and later ones are dropped. The state of a key goes a span after its
    last row. NULL keys, prices and times are left out. Start it within rocks_state.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(price).isNotNull()).select(F.col(key).alias("key"), F.col(price).cast("double").alias("price"), F.col(ts).alias("ts")).withWatermark("ts", delay)
    kind = rows.schema["key"].dataType.simpleString()
    processor = _Drops(int(span_days * 86_400_000_000), min_drop)
    keyed = rows.select("key", F.unix_micros("ts").alias("at"), "price", "ts").groupBy("key")
    found = keyed.transformWithStateInPandas(processor, f"key {kind}, at long, price double, peak double, drop_pct double", "append", "eventTime")
    # Half up, as SQL does it: the share in ten-thousandths is rounded, not the digits of the share itself.
    rounded = F.round(F.col("drop_pct") * 10_000) / 10_000
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("price").alias(price), "peak", rounded.alias("drop_pct"))


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, as per-key state with timers needs; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition: str | None = None) -> DataFrame:
    """Runs a query over what is there now, into Parquet files, and gives them back."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(partition) if partition else writer).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
