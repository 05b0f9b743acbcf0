"""The rule score of a lead: thirteen dimensions, clamped, gated and labelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.classify import URGENCY, urgency
from leadloom.functions.text import elapsed_days, nonzero, present

HOT, WARM = 60, 40


def label(score: Column, hot: int = HOT, warm: int = WARM) -> Column:
    return F.when(score >= hot, "HOT").when(score >= warm, "WARM").otherwise("COLD")


def steps(value: Column, *rungs: tuple[float, int]) -> Column:
    """The points of the first rung that the value reaches, else 0; NULL reaches none."""
    out = None
    for least, points in rungs:
        out = F.when(value >= least, points) if out is None else out.when(value >= least, points)
    return out.otherwise(0)


def national(phone: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(phone, F.lit("")), r"\+351|00351", ""))


def dimensions(as_of: str, zone_points: dict[str, int], urgency_rules: Sequence = URGENCY) -> dict[str, Column]:
    """Points by dimension. The rows need phone_count and zone_bonus (see with_context)."""
    kind, owner, phone = F.col("phone_type"), F.col("owner_type"), F.col("contact_phone")
    mobile = F.coalesce(kind == "mobile", F.lit(False))
    agency = F.coalesce(owner == "agency", F.lit(False))
    n = national(phone)
    points, _ = urgency(F.concat_ws(" ", "title", "description"), urgency_rules)
    zones = F.coalesce(*[F.when(F.col("zone") == z, p) for z, p in zone_points.items()], F.lit(1)) if zone_points else F.lit(1)
    age = elapsed_days(F.col("first_seen_at"), F.lit(as_of).cast("timestamp_ntz"))
    area, zone, price = nonzero(F.col("area_m2")), present(F.col("zone")), nonzero(F.col("price"))
    return {
        "price_opportunity": steps(F.col("price_delta_pct"), (20, 30), (10, 20), (5, 10), (0, 5)),
        "urgency_signals": F.least(points, F.lit(25)),
        "owner_direct": (
            F.when(F.col("lead_type") == "frbo", F.when(mobile, 25).otherwise(20))
            .when(F.col("lead_type") == "active_owner", F.when(mobile, 18).otherwise(15))
            .when(owner == "fsbo", F.when(mobile, 25).otherwise(20))
            .when(owner == "unknown", 10)
            .when(owner == "developer", 5)
            .otherwise(0)
        ),
        "days_on_market": steps(F.col("days_on_market"), (90, 15), (60, 10), (30, 5)),
        "data_quality": F.when(area & zone & price, 5).when(area & zone, 3).when(price & zone, 1).otherwise(0),
        "zone_priority": zones,
        "contact_quality": (
            F.when(present(phone), F.when(mobile, F.when(agency, 15).otherwise(20)).when(kind == "relay", 10).when(kind == "landline", 5).otherwise(12))
            .when(present(F.col("contact_email")), 5)
            .otherwise(-15)
        ),
        "phone_type_bonus": (
            F.when(mobile, F.when(agency, 3).otherwise(8))
            .when(kind == "relay", 0)
            .when(F.substring(n, 1, 2).isin("21", "22"), -8)
            .when(kind == "landline", -3)
            .when(n.startswith("9"), F.when(agency, 0).otherwise(4))
            .otherwise(0)
        ),
        "recency_bonus": F.when(age <= 7, 5).otherwise(0),
        "agency_penalty": F.when(agency, -10).otherwise(0),
        "contact_confidence_bonus": steps(F.col("contact_confidence"), (80, 3), (60, 1)),
        "repeated_phone_penalty": F.when(~present(phone), 0).otherwise(steps(F.col("phone_count"), (8, -10), (4, -5))),
        "premarket_signal_bonus": F.coalesce(F.col("zone_bonus"), F.lit(0)),
    }


def zone_bonus(signals: DataFrame) -> DataFrame:
    """zone, zone_bonus: 10 where there is a permit, else 5."""
    return signals.where(present(F.col("zone"))).groupBy("zone").agg(F.max(F.when(F.col("signal_type").contains("permit"), 10).otherwise(5)).alias("zone_bonus"))


def with_context(leads: DataFrame, signals: DataFrame) -> DataFrame:
    """How many rows share a lead's telephone (a count joined back, so a shared number isn't one task), and its zone's bonus."""
    # Rows without a telephone match nothing; a second key keeps them from meeting in one task. It is a sum, as a constant wouldn't stay a key.
    counts = leads.where(F.col("contact_phone").isNotNull() & ~F.col("is_demo")).groupBy("contact_phone").agg(F.count("*").alias("phone_count"), F.sum(F.lit(0)).alias("deal"))
    dealt = leads.withColumn("deal", F.when(F.col("contact_phone").isNull(), F.xxhash64("id")).otherwise(0))
    counted = dealt.join(counts, ["contact_phone", "deal"], "left").drop("deal")
    return counted.join(zone_bonus(signals), "zone", "left")


def score(leads: DataFrame, signals: DataFrame, as_of: str, zone_points: dict[str, int], hot: int = HOT, warm: int = WARM) -> DataFrame:
    """id, the points of every dimension, total and label. Without telephone and e-mail a lead stays below hot."""
    parts = dimensions(as_of, zone_points)
    rows = with_context(leads, signals).select("id", "contact_phone", "contact_email", *[c.cast("int").alias(k) for k, c in parts.items()])
    total = sum((F.col(k) for k in parts), F.lit(0))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), total))
    gated = F.when(present(F.col("contact_phone")) | present(F.col("contact_email")), clamped).otherwise(F.least(clamped, F.lit(hot - 1)))
    return rows.withColumn("total", gated).select("id", *parts, "total", label(F.col("total"), hot, warm).alias("label"))


def needs_rescore(leads: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    return leads.where(~F.col("archived") & (F.col("scored_at").isNull() | (F.col("scored_at") < limit)))


def bumped(score_: Column, by: int, hot: int = HOT, warm: int = WARM) -> tuple[Column, Column]:
    """A score raised to 100 at most, and its label."""
    raised = F.least(F.lit(100), F.coalesce(score_, F.lit(0)) + by)
    return raised, label(raised, hot, warm)


def phone_frequency(leads: DataFrame) -> DataFrame:
    """Telephones by how many leads carry them."""
    return leads.where(F.col("contact_phone").isNotNull() & ~F.col("is_demo")).groupBy("contact_phone").agg(F.count("*").alias("n"))


def learned_benchmark(leads: DataFrame, min_count: int = 5) -> DataFrame:
    """Exact median price per area by zone and typology where enough rows hold one, else the zone's. A median holds all values of its group: see sketched_benchmark for large zones."""
    rows = leads.where((F.col("price") > 0) & (F.col("area_m2") > 0)).select("zone", "typology", (F.col("price") / F.col("area_m2")).alias("v"))
    both = rows.groupBy("zone", "typology").agg(F.median("v").alias("own"), F.count("*").alias("n"))
    zones = rows.groupBy("zone").agg(F.median("v").alias("zone_median"))
    return both.join(zones, "zone").select("zone", "typology", "n", F.round(F.when(F.col("n") >= min_count, F.col("own")).otherwise(F.col("zone_median")), 2).alias("benchmark"))


def benchmark_sketches(leads: DataFrame, k: int = 400) -> DataFrame:
    """zone, typology, n and a mergeable quantile sketch of the price per area: of every (zone, typology), of every zone (typology NULL) and of all (both NULL).

    Values are read once; zones and the total are merged from the sketches below them, so no task holds a zone's values. The rank
    error of a quantile is about 1.65 / k ** 0.9 at 99 % confidence: under 1 % for k = 400.
    """
    rows = leads.where((F.col("price") > 0) & (F.col("area_m2") > 0)).select("zone", "typology", (F.col("price") / F.col("area_m2")).alias("v"))
    own = rows.groupBy("zone", "typology").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch"))
    merged = F.expr(f"kll_merge_agg_double(sketch, {k})").alias("sketch")
    zones = own.groupBy("zone").agg(F.lit(None).cast("string").alias("typology"), F.sum("n").alias("n"), merged)
    total = own.agg(F.lit(None).cast("string").alias("zone"), F.lit(None).cast("string").alias("typology"), F.sum("n").alias("n"), merged).where("n is not null")
    return own.unionByName(zones).unionByName(total)


def sketched_benchmark(sketches: DataFrame, min_count: int = 5, digits: int = 2) -> DataFrame:
    """learned_benchmark from sketches: the median of (zone, typology) where enough rows hold one, else the zone's."""
    median = F.expr("kll_sketch_get_quantile_double(sketch, 0.5D)")
    zones = sketches.where("zone is not null and typology is null").select("zone", median.alias("zone_median"))
    own = sketches.where("zone is not null and typology is not null").select("zone", "typology", "n", median.alias("own"))
    return own.join(zones, "zone").select("zone", "typology", "n", F.round(F.when(F.col("n") >= min_count, F.col("own")).otherwise(F.col("zone_median")), digits).alias("benchmark"))


def with_benchmark(leads: DataFrame, table: DataFrame, fallback: Sequence[str] = ("T2", "T3", "T1", "T0"), default: float = 2500.0, digits: int | None = 2) -> DataFrame:
    """Benchmark by (zone, typology), else of the zone's first fallback typology, else the default; and the difference in per cent."""
    rounded = lambda c: c if digits is None else F.round(c, digits)
    exact = table.select("zone", "typology", F.col("benchmark").alias("exact"))
    rank = F.coalesce(*[F.when(F.col("typology") == t, k) for k, t in enumerate(fallback)])
    zone = table.where(rank.isNotNull()).groupBy("zone").agg(F.min_by("benchmark", rank).alias("zone_value"))
    joined = leads.join(exact, ["zone", "typology"], "left").join(zone, "zone", "left")
    bench = F.coalesce("exact", "zone_value", F.lit(default))
    per = F.when((F.col("price") > 0) & (F.col("area_m2") > 0), rounded(F.col("price") / F.col("area_m2")))
    return joined.select("id", "zone", "typology", per.alias("price_per_m2"), bench.alias("price_benchmark"), rounded((bench - per) / bench * 100).alias("delta_pct"))


def window_rank(leads: DataFrame, partition: str, order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each value of a column."""
    return leads.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col(name) <= k)
