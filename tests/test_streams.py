"""Streams over files in order, against batches."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.streaming import streams

SCHEMA = "id long, k long, v double, ts timestamp"


def files(spark, tmp_path, parts):
    seen = set()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for new in set((tmp_path / "in").glob("part-*")) - seen:
            os.utime(new, (1_700_000_000 + 60 * n,) * 2)  # the stream reads files in order of their times
            seen.add(new)
    return streams.source(spark, f"file://{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)


def test_upserts_over_batches(spark, tmp_path):
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    stream = files(spark, tmp_path, [[(1, 7, 1.0, at(0)), (2, 8, 1.0, at(5))], [(3, 7, 2.0, at(3)), (4, 8, 2.0, at(1))], [(5, 9, 5.0, at(2)), (6, 7, 9.0, at(2))]])
    found = streams.upserted_table(stream, "k", F.struct("ts", "id"), f"file://{tmp_path}/table")
    assert {(r.k, r.id, r.v) for r in found.collect()} == {(7, 3, 2.0), (8, 2, 1.0), (9, 5, 5.0)}


def test_late_rows_are_counted(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n, 12)
    stream = files(spark, tmp_path, [[(1, 1, 1.0, day(1)), (2, 1, 1.0, day(1))], [(3, 1, 1.0, day(9))], [(6, 1, 1.0, day(10))], [(4, 1, 1.0, day(1)), (5, 1, 1.0, day(12))], [(7, 1, 1.0, day(20))]])
    rows = streams.counted_with_late(stream, "ts", "1 day", "1 hour", f"file://{tmp_path}/late").collect()
    assert {(r.start[:10], r.n) for r in rows} == {("2024-01-01", 2), ("2024-01-09", 1), ("2024-01-10", 1), ("2024-01-12", 1)} and {r.late for r in rows} == {1}


def test_drops_and_days_are_those_of_the_batch(spark, tmp_path):
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    rows = [(k, k % 3, 100.0 - k % 7 * 10, at(6 * k)) for k in range(60)]
    stream = files(spark, tmp_path, [rows[:20], rows[20:40], rows[40:] + [(99, 50, 1.0, at(6 * 60 + 24 * 30))]])
    days = streams.drained(streams.day_series(stream, "ts", "v"), f"file://{tmp_path}/d", f"file://{tmp_path}/dc")
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 2).alias("mean"))
    assert {(str(r.day)[:10], r.n, r.mean) for r in days.collect()} == {(str(r.day), r.n, r.mean) for r in batch.collect()}
    drops = streams.drained(streams.drop_alerts(stream, "k", "v", "ts", "5 days", "5 days"), f"file://{tmp_path}/p", f"file://{tmp_path}/pc")
    wanted = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "5 days"), "k").agg(F.count("*").alias("n"), F.max("v").alias("peak"), F.max_by("v", "ts").alias("last")).where("n >= 2 and (peak - last) / peak >= 0.05")
    assert {(r.k, r.n, r.peak, r.last) for r in drops.collect()} == {(r.k, r.n, r.peak, r.last) for r in wanted.collect()}


def test_drops_by_key_over_late_and_unordered_rows(spark, tmp_path):
    """Every row that comes within the delay is rated against the peak of the span before it, whatever the order of files."""
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    rows = [(k, k % 3, float(100 - k * 37 % 50), at(2 * k)) for k in range(80)] + [(200, 1, 100.0, at(20)), (201, 1, 10.0, at(20)), (202, 0, 0.0, at(7)), (203, None, 5.0, at(8)), (204, 2, None, at(9))]
    mixed = sorted(rows, key=lambda r: (r[3] + timedelta(hours=r[0] * 13 % 11), r[0]))
    # A row behind the watermark, and one that moves it to the end.
    parts = [mixed[:30], mixed[30:55], [*mixed[55:], (900, 50, 1.0, at(400))], [(901, 1, 1.0, at(3)), (902, 50, 0.5, at(401))]]
    stream = files(spark, tmp_path, parts)
    with streams.rocks_state(spark):
        found = streams.drained(streams.drops_by_key(stream, "k", "v", "ts", 1, "12 hours", 0.2), f"file://{tmp_path}/o", f"file://{tmp_path}/c").collect()
    wanted = set()
    for _, k, v, t in rows:
        if k is not None and v is not None:
            peak = max(p for _, j, p, s in rows if j == k and p is not None and t - timedelta(days=1) <= s <= t)
            if (peak - v) / peak >= 0.2:
                wanted.add((k, t, v, peak, round((peak - v) / peak, 4)))
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_keyed_table_merges_compacts_and_replays(spark, tmp_path):
    from leadloom.streaming.keyed import KeyedTable

    schema = spark.createDataFrame([], "k long, v double, ver long").schema
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, "k", F.col("ver"), buckets=4)
    new = lambda rows: spark.createDataFrame(rows, schema)
    held = lambda: sorted(map(tuple, KeyedTable(spark, f"file://{tmp_path}/t", schema, "k", F.col("ver"), buckets=4).read().collect()))
    assert held() == []
    table.apply(new([(k, 1.0, 1) for k in range(10)] + [(3, 5.0, 2)]), 0)
    table.apply(new([(1, 9.0, 0), (2, 9.0, 3), (77, 7.0, 1)]), 1)
    wanted = sorted([(k, {3: 5.0, 2: 9.0}.get(k, 1.0), {3: 2, 2: 3}.get(k, 1)) for k in range(10)] + [(77, 7.0, 1)])
    assert held() == wanted
    table.apply(new([(1, 9.0, 0), (2, 9.0, 3), (77, 7.0, 1)]), 1)
    assert held() == wanted
    table.compact()
    assert held() == wanted and not list((tmp_path / "t" / "delta").glob("keyed_batch=*"))
    table.apply(new([(1, 9.0, 0), (2, 9.0, 3), (77, 7.0, 1)]), 1)  # run again after its buckets were compacted
    assert held() == wanted
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "base").rglob("part-*")}
    table.apply(new([(2, 11.0, 3)]), 2)  # the same version: the later batch's row
    table.compact()
    wanted[2] = (2, 11.0, 3)
    assert held() == wanted
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len(kept) >= 3  # only the bucket of key 2 was written anew
    (tmp_path / "t" / "delta" / "keyed_batch=3" / "keyed_bucket=0").mkdir(parents=True)  # a batch that failed half-way
    assert held() == wanted


def test_upserts_after_a_restart_without_new_rows(spark, tmp_path):
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    stream = files(spark, tmp_path, [[(n, n % 3, float(n), at(n))] for n in range(12)])
    run = lambda: {(r.k, r.id) for r in streams.upserted_table(stream, "k", F.struct("ts", "id"), f"file://{tmp_path}/u", most_deltas=2).collect()}
    assert run() == {(0, 9), (1, 10), (2, 11)} == run()


def test_drops_by_key_round_half_up(spark, tmp_path):
    """A share that lies halfway between two of four digits goes up, whatever the double beside it."""
    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    pairs = [(16.0, 5.82, 0.6363), (136.96, 12.84, 0.9063), (152.0, 48.83, 0.6788), (118.4, 6.66, 0.9438)]
    rows = [r for k, (peak, price, _) in enumerate(pairs) for r in ((2 * k, k, peak, at(1)), (2 * k + 1, k, price, at(2)))]
    stream = files(spark, tmp_path, [[*rows, (99, 99, 1.0, at(400))]])
    with streams.rocks_state(spark):
        found = streams.drained(streams.drops_by_key(stream, "k", "v", "ts", 1, "1 hour", 0.2), f"file://{tmp_path}/o", f"file://{tmp_path}/c").collect()
    assert {(r.k, r.drop_pct) for r in found} == {(k, p) for k, (_, _, p) in enumerate(pairs)}


def test_drops_by_key_round_as_sql(spark, tmp_path):
    """Shares that lie beside a tie are rounded as DuckDB's round does it, which takes ten-thousandths first."""
    import duckdb

    at = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    pairs = [(488.0, 225.09), (472.0, 47.79), (480.0, 223.8), (464.0, 17.98), (480.0, 224.28), (400.0, 100.0)]
    rows = [r for k, (peak, price) in enumerate(pairs) for r in ((2 * k, k, peak, at(1)), (2 * k + 1, k, price, at(2)))]
    stream = files(spark, tmp_path, [[*rows, (99, 99, 1.0, at(400))]])
    with streams.rocks_state(spark):
        found = streams.drained(streams.drops_by_key(stream, "k", "v", "ts", 1, "1 hour", 0.2), f"file://{tmp_path}/o", f"file://{tmp_path}/c").collect()
    wanted = {k: duckdb.execute("SELECT round((?::DOUBLE - ?::DOUBLE) / ?::DOUBLE, 4)", [peak, price, peak]).fetchone()[0] for k, (peak, price) in enumerate(pairs)}
    assert {r.k: r.drop_pct for r in found} == wanted and wanted[0] == 0.5387 and wanted[1] == 0.8988
