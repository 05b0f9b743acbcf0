"""Indicator queries over leads: each is one pass of conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import present

HOT, WARM = 60, 40
#: Listings from which a seller counts as one who sells like an agency.
SUPER_SELLER = 5


def live(leads: DataFrame) -> DataFrame:
    return leads.where(~F.col("archived") & ~F.col("is_demo"))


def count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def rate(part: Column, whole: Column, name: str) -> Column:
    """Per cent, to one decimal; 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 1), F.lit(0.0)).alias(name)


def has_phone() -> Column:
    return present(F.col("contact_phone"))


def mobile() -> Column:
    return F.coalesce(F.col("contact_phone").startswith("+3519"), F.lit(False))


def landline() -> Column:
    return F.coalesce(F.col("contact_phone").startswith("+3512"), F.lit(False))


def owner() -> Column:
    return F.col("lead_type").isin("fsbo", "frbo")


def any_contact() -> Column:
    return has_phone() | present(F.col("contact_email")) | present(F.col("contact_whatsapp")) | present(F.col("contact_website"))


def summary(leads: DataFrame, hot: int = HOT, warm: int = WARM) -> DataFrame:
    """Every headline figure in one row, from one global aggregate: coverage, owners, labels, channels, tiers."""
    n = F.count("*")
    return live(leads).agg(
        n.alias("total"),
        count_if(has_phone(), "with_phone"),
        rate(F.count_if(has_phone()), n, "phone_rate"),
        count_if(mobile(), "mobile"),
        count_if(landline(), "landline"),
        count_if(F.col("lead_type") == "fsbo", "fsbo"),
        rate(F.count_if(F.col("lead_type") == "fsbo"), n, "fsbo_rate"),
        rate(F.count_if((F.col("lead_type") == "fsbo") & has_phone()), F.count_if(F.col("lead_type") == "fsbo"), "fsbo_phone_rate"),
        count_if(F.col("lead_type") == "frbo", "frbo"),
        rate(F.count_if(F.col("lead_type") == "frbo"), n, "frbo_rate"),
        count_if(F.col("lead_type") == "active_owner", "active_owners"),
        count_if(F.coalesce(F.col("score") >= hot, F.lit(False)), "hot"),
        count_if(F.coalesce((F.col("score") >= warm) & (F.col("score") < hot), F.lit(False)), "warm"),
        count_if(F.coalesce(F.col("score") < warm, F.lit(True)), "cold"),
        count_if(present(F.col("contact_email")), "with_email"),
        count_if(present(F.col("contact_whatsapp")), "with_whatsapp"),
        count_if(present(F.col("contact_website")), "with_website"),
        count_if(any_contact(), "with_any"),
        count_if(~any_contact(), "with_none"),
        count_if(F.col("contact_confidence") >= 80, "confident"),
        F.round(F.avg("score"), 1).alias("avg_score"),
    )


def by_group(leads: DataFrame, key: str) -> DataFrame:
    """Counts, contact and owner rates and the mean score per value of a column (zone, source, municipality)."""
    n = F.count("*")
    return (
        live(leads)
        .groupBy(F.coalesce(key, F.lit("")).alias("name"))
        .agg(
            n.alias("total"),
            count_if(has_phone(), "with_phone"),
            count_if(mobile(), "mobile"),
            count_if(owner(), "owners"),
            count_if(F.col("score_label") == "HOT", "hot"),
            F.round(F.avg("score"), 1).alias("avg_score"),
            rate(F.count_if(has_phone()), n, "phone_rate"),
            rate(F.count_if(owner()), n, "owner_rate"),
        )
    )


def phones_by_source(leads: DataFrame) -> DataFrame:
    """Leads with a telephone by where the contact came from, and each source's share."""
    counts = live(leads).where(has_phone()).groupBy(F.coalesce("contact_source", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 1))


def source_by_phone_class(leads: DataFrame) -> DataFrame:
    n = F.count("*")
    return live(leads).groupBy("discovery_source").agg(
        n.alias("total"), count_if(has_phone(), "with_phone"), count_if(mobile(), "mobile"), count_if(landline(), "landline"),
        count_if(F.coalesce(F.col("contact_phone").startswith("+3516"), F.lit(False)), "relay"),
        rate(F.count_if(has_phone()), n, "coverage"), rate(F.count_if(mobile()), n, "mobile_rate"),
    )


def quality(leads: DataFrame) -> DataFrame:
    """Counts of lead quality by label."""
    tier = F.when(has_phone() & owner(), "high").when(any_contact() | owner(), "medium").otherwise("low")
    return live(leads).groupBy(tier.alias("quality"), F.coalesce("score_label", F.lit("COLD")).alias("label")).agg(F.count("*").alias("n"))


def counted_sets(leads: DataFrame, keys: Sequence[str] = ("score_label", "zone", "crm_stage")) -> DataFrame:
    """Counts by each of several columns and the total, in one scan by grouping sets."""
    chosen = live(leads).select(*keys)
    grouped = chosen.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    width = len(keys)
    names = {2**width - 1 - 2 ** (width - 1 - i): k for i, k in enumerate(keys)}
    label = F.coalesce(*[F.when(F.col("g") == g, k) for g, k in names.items()], F.lit("total"))
    value = F.coalesce(*[F.when(F.col("g") == g, F.col(k)) for g, k in names.items()])
    return grouped.select(label.alias("by"), value.alias("value"), "n")


def dashboard_summary(leads: DataFrame, as_of: str, urgent_words: Sequence[str] = ("urgente", "remodelar")) -> DataFrame:
    """Totals, today's rows, mean values, price cuts, opportunities, ages and distinct rows with an urgency word."""
    now = F.lit(as_of).cast("timestamp_ntz")
    words = "|".join(urgent_words)
    return live(leads).agg(
        F.count("*").alias("total"),
        count_if(F.col("first_seen_at") >= F.date_trunc("day", now).cast("timestamp_ntz"), "today"),
        F.round(F.avg("price"), 2).alias("avg_price"),
        count_if(F.col("price_changes") > 0, "price_cuts"),
        count_if(F.coalesce(F.col("price_delta_pct") >= 15, F.lit(False)), "opportunities"),
        count_if(F.coalesce(F.col("days_on_market") >= 30, F.lit(False)), "days_30"),
        count_if(F.coalesce(F.col("days_on_market") >= 60, F.lit(False)), "days_60"),
        count_if(F.coalesce(F.col("description").rlike(words), F.lit(False)), "urgent"),
        F.count_distinct("zone").alias("zones"),
    )


def funnel(leads: DataFrame, stages: Sequence[str], since: str | None = None) -> DataFrame:
    """Rows per stage in order, none left out, and per cent of the first stage's count; of rows first seen since a time, if given."""
    leads = leads if since is None else leads.where(F.col("first_seen_at") >= F.lit(since).cast("timestamp_ntz"))
    spark = leads.sparkSession
    dim = spark.createDataFrame([(k, s) for k, s in enumerate(stages)], "place int, stage string")
    counts = live(leads).groupBy(F.col("crm_stage").alias("stage")).agg(F.count("*").alias("n"))
    top = F.max(F.when(F.col("place") == 0, F.coalesce("n", F.lit(0)))).over(Window.partitionBy())
    return F.broadcast(dim).join(counts, "stage", "left").select("place", "stage", F.coalesce("n", F.lit(0)).alias("n"), rate(F.coalesce("n", F.lit(0)), top, "pct"))


def leaderboard(leads: DataFrame, limit: int = 20, min_listings: int = 3) -> DataFrame:
    """Agencies by listings; the limit comes before the filter of small ones."""
    top = (
        live(leads)
        .where(present(F.col("agency_name")))
        .groupBy("agency_name")
        .agg(F.count("*").alias("total"), count_if(F.col("score_label") == "HOT", "hot"), F.round(F.avg("score"), 1).alias("avg_score"), F.round(F.avg("price"), 2).alias("avg_price"), rate(F.count_if(has_phone() | present(F.col("contact_email"))), F.count("*"), "contact_pct"))
        .orderBy(F.desc("total"), "agency_name")
        .limit(limit)
    )
    return top.where(F.col("total") >= min_listings)


def heatmap(leads: DataFrame, centroids: DataFrame, min_count: int = 3) -> DataFrame:
    """Counts and means per zone at the mean position of its rows, or at its given centroid; zones without either go."""
    zones = live(leads).where(present(F.col("zone"))).groupBy("zone").agg(F.count("*").alias("n"), count_if(F.col("score_label") == "HOT", "hot"), F.round(F.avg("score"), 1).alias("avg_score"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    placed = zones.where(F.col("n") >= min_count).join(centroids.select("zone", F.col("lat").alias("clat"), F.col("lon").alias("clon")), "zone", "left")
    return placed.select("zone", "n", "hot", "avg_score", F.round(F.coalesce("lat", "clat"), 4).alias("lat"), F.round(F.coalesce("lon", "clon"), 4).alias("lon")).where("lat is not null and lon is not null")


def histogram(leads: DataFrame, bins: int = 10) -> DataFrame:
    width = max(1, 100 // bins)
    return live(leads).where("score is not null").groupBy((F.floor(F.col("score") / width) * width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recent_signals(leads: DataFrame, notes: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """New rows, new hot rows, drop notes, repeat sellers and contacted rows of the last days, in one row."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    seen = F.col("last_seen_at") >= since
    many = live(leads).where(seen & F.col("contact_name").isNotNull()).groupBy("contact_name").agg(F.count("*").alias("n")).agg(count_if(F.col("n") >= SUPER_SELLER, "super_sellers"))
    left = live(leads).agg(count_if(F.col("first_seen_at") >= since, "new"), count_if((F.col("first_seen_at") >= since) & (F.col("score_label") == "HOT"), "new_hot"), count_if(seen & (F.col("crm_stage") == "contactado"), "contacted")).join(many)
    right = notes.where(F.col("created_at") >= since).agg(count_if(F.col("note_type") == "price_drop", "drops"))
    return left.join(right)


def daily(leads: DataFrame, since: str, until: str) -> DataFrame:
    """A row per day, empty days too: rows, share of hot ones, contact rate, mean score."""
    spark = leads.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(since)), F.to_date(F.lit(until)))).alias("day"))
    counts = live(leads).groupBy(F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("n"), count_if(F.col("score_label") == "HOT", "hot"), count_if(any_contact(), "reached"), F.round(F.avg("score"), 1).alias("avg_score"))
    n = F.coalesce("n", F.lit(0))
    return days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), n.alias("n"), rate(F.coalesce("hot", F.lit(0)), n, "hot_share"), rate(F.coalesce("reached", F.lit(0)), n, "contact_rate"), "avg_score")


def daily_drops(notes: DataFrame) -> DataFrame:
    """Price-drop notes per day."""
    return notes.where(F.col("note_type") == "price_drop").groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("drops"))


def daily_sources(leads: DataFrame) -> DataFrame:
    """Per day and source its rows and their share of the day."""
    counts = live(leads).groupBy(F.to_date("first_seen_at").cast("string").alias("day"), "discovery_source").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("day")), 1))


def run_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots of the same counters, their differences, and the change of the telephone rate in points."""
    def snap(df: DataFrame, tag: str) -> DataFrame:
        return live(df).agg(F.count("*").alias(f"total_{tag}"), count_if(has_phone(), f"phone_{tag}"), count_if(F.col("score_label") == "HOT", f"hot_{tag}"), count_if(F.coalesce(F.col("contact_source").startswith("cross_portal:"), F.lit(False)), f"crossed_{tag}"))

    both = snap(before, "before").join(snap(after, "after"))
    pct = lambda t: F.coalesce(F.try_divide(F.col(f"phone_{t}") * F.lit(100.0), F.col(f"total_{t}")), F.lit(0.0))
    return both.select("*", (F.col("total_after") - F.col("total_before")).alias("total_diff"), (F.col("phone_after") - F.col("phone_before")).alias("phone_diff"), (F.col("hot_after") - F.col("hot_before")).alias("hot_diff"), F.round(pct("after") - pct("before"), 1).alias("phone_points"))


def executive_summary(premium: DataFrame, expanded: DataFrame) -> DataFrame:
    """Label counts and score range of each list."""
    both = premium.select(F.lit("premium").alias("list"), "score", "score_label", "phone_type").unionByName(expanded.select(F.lit("expanded").alias("list"), "score", "score_label", "phone_type"))
    return both.groupBy("list").agg(F.count("*").alias("n"), count_if(F.col("score_label") == "HOT", "hot"), count_if(F.col("score_label") == "WARM", "warm"), F.min("score").alias("min_score"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"), count_if(F.col("phone_type") == "mobile", "mobile"))


def motive_frequency(tagged: DataFrame, top: int = 8) -> DataFrame:
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def contact_mix(leads: DataFrame) -> DataFrame:
    """Share of each source, and of telephone, e-mail-only and unreachable rows within it."""
    n = F.count("*")
    grouped = live(leads).groupBy("discovery_source").agg(n.alias("n"), count_if(has_phone(), "phone"), count_if(~has_phone() & present(F.col("contact_email")), "email_only"), count_if(~has_phone() & ~present(F.col("contact_email")), "unreached"))
    return grouped.withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 1))


def reasons(leads: DataFrame, rules: Sequence[tuple[str, Column]], default: str) -> DataFrame:
    """Rows by the first rule that holds for them: the counters of a job."""
    c = None
    for name, rule in rules:
        c = F.when(rule, name) if c is None else c.when(rule, name)
    return leads.groupBy(c.otherwise(default).alias("reason")).agg(F.count("*").alias("n"))
