"""Filtered and ordered lists of leads: pages, top rows, deliverables, feeds. Every order ends in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import present
from leadloom.operators.kpi import any_contact, has_phone, live
from leadloom.operators.scoring import window_rank


def active(leads: DataFrame, zone=None, typology=None, score_min=None, stage=None, label=None, is_demo=None, contact=None, owner=None, offset=0, limit=None) -> DataFrame:
    """Leads that aren't archived, by optional filters; demo rows last, best score first."""
    rows = leads.where(~F.col("archived"))
    for column, value in (("zone", zone), ("typology", typology), ("crm_stage", stage), ("score_label", label), ("is_demo", is_demo), ("owner_type", owner)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if score_min is not None:
        rows = rows.where(F.col("score") >= score_min)
    if contact is not None:
        phone, email = has_phone(), present(F.col("contact_email"))
        rows = rows.where({"any": phone | email, "phone": phone, "email": email, "none": ~phone & ~email}[contact])
    rows = rows.orderBy(F.col("is_demo").asc(), F.col("score").desc_nulls_last(), "id").offset(offset)
    return rows.limit(limit) if limit is not None else rows


#: Filters that go together: minimum score, owner type, contact mode.
PRESETS = {"owners": {"owner": "fsbo", "contact": "any"}, "hot_reachable": {"score_min": 60, "contact": "phone"}, "unreachable": {"contact": "none"}}


def digest(leads: DataFrame, top: int = 20, score_min: int = 50) -> DataFrame:
    return live(leads).where(F.col("score") >= score_min).orderBy(F.desc("score"), F.col("days_on_market").desc_nulls_last(), F.desc("last_seen_at"), "id").limit(top)


def hot_focus(leads: DataFrame, limit: int = 50) -> DataFrame:
    return live(leads).where(F.col("score_label") == "HOT").orderBy(F.desc("priority_flag"), F.desc("score"), F.col("days_on_market").desc_nulls_last(), F.desc("last_seen_at"), "id").limit(limit)


def top_actionable(leads: DataFrame, limit: int = 5) -> DataFrame:
    """By confidence, then the contact's source (direct, crossed, website), score and owner kind."""
    source = F.when(F.col("contact_source").startswith("cross_portal:"), 2).when(F.col("contact_source").startswith("website:"), 1).otherwise(3)
    rank = F.when(F.col("owner_type") == "fsbo", 3).when(F.col("owner_type") == "unknown", 2).otherwise(1)
    rows = live(leads).where(F.col("contact_confidence") > 0).withColumn("source_rank", source).withColumn("owner_rank", rank)
    return rows.orderBy(F.desc("contact_confidence"), F.desc("source_rank"), F.col("score").desc_nulls_last(), F.desc("owner_rank"), "id").limit(limit)


def per_stage(leads: DataFrame, k: int = 30) -> DataFrame:
    return window_rank(live(leads), "crm_stage", [F.col("score").desc_nulls_last(), F.col("id")], k)


def best_per_phone(leads: DataFrame) -> DataFrame:
    """The best-scored lead of each telephone: a max per number, so no number's rows are sorted together."""
    rows = live(leads).where(has_phone())
    best = rows.groupBy("contact_phone").agg(F.max(F.struct(F.coalesce("score", F.lit(-1)).alias("s"), (-F.col("id")).alias("i"))).alias("b"))
    return best.select((-F.col("b.i")).alias("id"), "contact_phone", F.when(F.col("b.s") >= 0, F.col("b.s")).alias("score"))


def premium(leads: DataFrame, limit: int = 100, score_min: int = 50) -> DataFrame:
    """Owners by telephone: the limit * 5 best candidates, the best of each number, landlines of agencies left out."""
    landline = F.coalesce(F.col("contact_phone").startswith("+35121") | F.col("contact_phone").startswith("+35122"), F.lit(False))
    rows = live(leads).where(has_phone() & (F.col("score") >= score_min) & (F.col("owner_type") != "agency") & ~landline)
    key = F.col("score") + F.when(F.col("phone_type") == "mobile", 5).when(F.col("phone_type") == "relay", 2).otherwise(0)
    candidates = rows.withColumn("rank_key", key).orderBy(F.desc("rank_key"), "id").limit(limit * 5)
    return window_rank(candidates, "contact_phone", [F.desc("rank_key"), F.col("id")], 1).orderBy(F.desc("rank_key"), "id").limit(limit).drop("place")


def expanded(leads: DataFrame, premium_rows: DataFrame, limit: int = 200, score_min: int = 20) -> DataFrame:
    """The best of each number that the premium list doesn't hold."""
    best = best_per_phone(leads).where(F.col("score") >= score_min).join(premium_rows.select("contact_phone").distinct(), "contact_phone", "left_anti")
    return best.orderBy(F.desc("score"), "id").limit(limit)


def similar_sellers(leads: DataFrame, floor: int = 5) -> DataFrame:
    """Roll-up by seller: total listings, whether many, and owner type set to agency from twice that."""
    totals = leads.groupBy("contact_name").agg(F.count("*").alias("listings"))
    kind = F.when((F.col("listings") >= 2 * floor) & (F.col("owner_type") == "fsbo"), "agency").otherwise(F.col("owner_type"))
    return leads.join(totals, "contact_name").select("id", "listings", (F.col("listings") >= floor).alias("super_seller"), kind.alias("owner_type"))


def timeline(leads: DataFrame, notes: DataFrame, as_of: str, hours: int, new_limit: int = 200, note_limit: int = 300, limit: int = 200) -> DataFrame:
    """New leads and notes of a span, newest first."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    new = live(leads).where(F.col("first_seen_at") >= since).orderBy(F.desc("first_seen_at"), "id").limit(new_limit).select(F.lit("new").alias("kind"), F.col("id").alias("lead_id"), F.col("first_seen_at").alias("ts"), F.col("id"))
    noted = notes.where(F.col("created_at") >= since).orderBy(F.desc("created_at"), "id").limit(note_limit).select(F.lit("note").alias("kind"), "lead_id", F.col("created_at").alias("ts"), "id")
    return new.unionByName(noted).orderBy(F.desc("ts"), "kind", "id").limit(limit)


def alert_feed(leads: DataFrame, limit: int = 8) -> DataFrame:
    """Per lead the first rule that holds, and a rule on its text; the first rows in order of score."""
    main = F.when((F.col("score_label") == "HOT") & has_phone(), "hot").when(F.col("price_delta_pct") >= 20, "cheap").when(F.col("days_on_market") >= 90, "old")
    motive = F.when(F.col("description").contains("urgente"), "urgent")
    rows = live(leads).select("id", "score", F.posexplode(F.array_compact(F.array(main, motive))).alias("rule_no", "rule"))
    return rows.orderBy(F.col("score").desc_nulls_last(), "id", "rule_no").limit(limit)


def deliverable(leads: DataFrame) -> DataFrame:
    """Four filtered projections as one table with a sheet column."""
    rows = live(leads)
    sheets = {"owners": F.col("owner_type") == "fsbo", "agencies": F.col("owner_type") == "agency", "reachable": any_contact(), "hot": F.col("score_label") == "HOT"}
    marked = F.array_compact(F.array(*[F.when(c, s) for s, c in sheets.items()]))
    return rows.select(F.explode(marked).alias("sheet"), "id", "zone", "price", "score")


def insight(floor: int = 10) -> Column:
    """A short text from the row's signals, in order of weight."""
    parts = [
        F.when(F.col("description").contains("urgente"), "urgent"),
        F.when(F.col("days_on_market") >= 60, F.concat(F.col("days_on_market").cast("string"), F.lit(" days"))),
        F.when(F.col("price_delta_pct") >= floor, F.concat(F.col("price_delta_pct").cast("int").cast("string"), F.lit("% below"))),
    ]
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("-"))


def contact_list(leads: DataFrame) -> DataFrame:
    """What a caller needs: name split, message link, insight, confidence word, date."""
    from leadloom.functions.text import split_name

    first, last = split_name(F.col("contact_name"))
    link = F.when(has_phone(), F.concat(F.lit("https://wa.me/"), F.substring("contact_phone", 2, 20), F.lit("?text="), F.replace(F.url_encode(F.concat(F.lit("Bom dia "), first)), F.lit("+"), F.lit("%20"))))
    confidence = F.when(F.col("contact_confidence") >= 80, "ALTA").when(F.col("contact_confidence") >= 50, "MÉDIA").otherwise("BAIXA")
    return live(leads).select("id", first.alias("first_name"), last.alias("last_name"), link.alias("link"), insight().alias("insight"), confidence.alias("confidence"), F.date_format("first_seen_at", "dd/MM/yyyy").alias("seen"), F.coalesce(F.nullif(F.concat_ws(" · ", "typology", "zone"), F.lit("")), F.substring("title", 1, 60)).alias("label"))
