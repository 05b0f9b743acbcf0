"""Price histories and text edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import elapsed_days


def price_drops(prices: DataFrame, as_of: str, key: str = "lead_id", price: str = "price", ts: str = "recorded_at", lookback_days: int = 30, recent_days: int = 14, min_drop: float = 0.05) -> DataFrame:
    """Keys whose last price lies under the first peak of the span by min_drop or more, with a recent last observation.

    One hash aggregate: histories are not sorted.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    p, t = F.col(price), F.col(ts)
    rows = prices.where(p.isNotNull() & (t >= now - F.expr(f"interval {lookback_days} days")))
    found = rows.groupBy(key).agg(
        F.count("*").alias("observations"),
        F.max(p).alias("peak_price"),
        F.max_by(t, F.struct(p, -F.unix_micros(t.cast("timestamp")))).alias("peak_at"),
        F.max_by(p, F.struct(t, p)).alias("last_price"),
        F.max(t).alias("last_at"),
    )
    drop = (F.col("peak_price") - F.col("last_price")) / F.col("peak_price")
    return found.where((F.col("observations") >= 2) & (F.col("peak_price") > 0)).where((drop >= min_drop) & (F.col("last_at") >= now - F.expr(f"interval {recent_days} days"))).select(
        key, "observations", "peak_price", "last_price", F.round(drop, 4).alias("drop_pct"), F.round(F.col("peak_price") - F.col("last_price"), 2).alias("drop_abs"), F.greatest(elapsed_days(F.col("peak_at"), F.col("last_at")), F.lit(0)).alias("days_since_peak")
    )


def drop_stats(prices: DataFrame, as_of: str, **options) -> DataFrame:
    return price_drops(prices, as_of, **options).agg(F.count("*").alias("dropped"), F.round(F.avg("drop_pct"), 4).alias("avg_drop"))


def is_change(old: Column, new: Column, ratio: float = 0.005) -> Column:
    """Whether a price moved by more than ratio; NULL on a side is no change."""
    moved = F.when(old == 0, new != 0).otherwise(F.abs((new - old) / F.when(old != 0, old)) > ratio)
    return F.coalesce(moved, F.lit(False))


def price_changes(prices: DataFrame, key: str = "lead_id", price: str = "price", ts: str = "recorded_at") -> DataFrame:
    """Per key: observations, changes against the observation before, first and last price."""
    w = Window.partitionBy(key).orderBy(ts, "id")
    rows = prices.withColumn("changed", is_change(F.lag(price).over(w), F.col(price)))
    return rows.groupBy(key).agg(F.count("*").alias("observations"), F.count_if("changed").alias("changes"), F.min_by(price, F.struct(ts, "id")).alias("first_price"), F.max_by(price, F.struct(ts, "id")).alias("last_price"))


def accepted_changes(prices: DataFrame, key: str = "lead_id", price: str = "price", ts: str = "recorded_at", ratio: float = 0.005) -> DataFrame:
    """Changes against the last accepted price, which small moves don't replace: a fold over each key's history."""
    listed = prices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts), F.col("id"), F.col(price).alias("p")))).alias("h"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        moved = is_change(acc["last"], x["p"], ratio)
        return F.struct(F.when(acc["last"].isNull() | moved, x["p"]).otherwise(acc["last"]).alias("last"), (acc["n"] + moved.cast("int")).alias("n"))

    folded = F.aggregate("h", start, step)
    return listed.select(key, folded["n"].alias("accepted"), folded["last"].alias("price"))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def classify_edit(old: Column, new: Column, rewrite: float = 0.78, appended: int = 30, ratio: Column | None = None) -> Column:
    """rewrite, appended, edit, or NULL for no change and a first text."""
    a, b = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    ratio = ratio if ratio is not None else similarity(F.lower(a), F.lower(b))
    return F.when((b == "") | (a == b) | (a == ""), F.lit(None).cast("string")).when(ratio < rewrite, "rewrite").when(b.contains(a) & (F.length(b) > F.length(a) + appended), "appended").otherwise("edit")


def edits(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Changes of title, description, agency and telephone between two versions, one row each."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))

    def text(c: str) -> Column:
        return F.struct(F.lit(c).alias("field"), classify_edit(F.col(f"a.{c}"), F.col(f"b.{c}")).alias("severity"), F.substring(f"a.{c}", 1, 200).alias("old"), F.substring(f"b.{c}", 1, 200).alias("new"))

    def switch(c: str, alike: float | None) -> Column:
        x, y = F.trim(F.coalesce(F.col(f"a.{c}"), F.lit(""))), F.trim(F.coalesce(F.col(f"b.{c}"), F.lit("")))
        differs = (x != "") & (y != "") & (F.lower(x) != F.lower(y))
        if alike is not None:
            differs = differs & (similarity(F.lower(x), F.lower(y)) < alike)
        return F.struct(F.lit(c).alias("field"), F.when(differs, "switch").alias("severity"), x.alias("old"), y.alias("new"))

    changes = F.array(text("title"), text("description"), switch("agency_name", 0.85), switch("contact_phone", None))
    return both.select(F.col(f"a.{key}").alias(key), F.explode(F.filter(changes, lambda x: x["severity"].isNotNull())).alias("c")).select(key, "c.*")


def edit_notes(changes: DataFrame, key: str = "id") -> DataFrame:
    """One note per key with its changes as JSON."""
    listed = F.array_sort(F.collect_list(F.struct("field", "severity", "old", "new")))
    return changes.groupBy(key).agg(F.count("*").alias("n_changes"), F.to_json(listed).alias("changeset"))


def price_in_force(notes: DataFrame, prices: DataFrame) -> DataFrame:
    """As-of join: the last price at or before each note, by one sort of both per lead."""
    both = notes.select("lead_id", F.col("created_at").alias("ts"), F.col("id").alias("note_id"), F.lit(None).cast("double").alias("price")).unionByName(
        prices.select("lead_id", F.col("recorded_at").alias("ts"), F.lit(None).cast("long").alias("note_id"), "price")
    )
    w = Window.partitionBy("lead_id").orderBy(F.col("ts"), F.col("note_id").asc_nulls_first(), "price").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("in_force", F.last("price", ignorenulls=True).over(w)).where("note_id is not null").select("note_id", "lead_id", "in_force")
