"""Indicator queries (E) over the lead view, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import kpi
from leadloom.plans.views import AS_OF, NOTES, leads, table, view, with_leads

PHONE = "coalesce(contact_phone <> '', false)"
EMAIL = "coalesce(contact_email <> '', false)"
ANY = f"({PHONE} OR {EMAIL} OR coalesce(contact_whatsapp <> '', false) OR coalesce(contact_website <> '', false))"
OWNER = "lead_type IN ('fsbo', 'frbo')"
N = "count(*) FILTER"


def pct(part: str, whole: str) -> str:
    return f"coalesce(round(({part}) * 100.0 / nullif({whole}, 0), 1), 0.0)::DOUBLE"


def _group(key: str) -> str:
    return with_leads(f"""SELECT coalesce({key}, '') AS name, count(*) AS total, {N} (WHERE {PHONE}) AS with_phone, {N} (WHERE contact_phone LIKE '+3519%') AS mobile,
  {N} (WHERE {OWNER}) AS owners, {N} (WHERE score_label = 'HOT') AS hot, round(avg(score), 1) AS avg_score,
  {pct(f"{N} (WHERE {PHONE})", "count(*)")} AS phone_rate, {pct(f"{N} (WHERE {OWNER})", "count(*)")} AS owner_rate FROM live GROUP BY 1""")


def _centroids(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("zone"), (F.col("n_nationkey") * 1.0).alias("lat"), F.lit(0.0).alias("lon"))


def e1_summary(spark, sf):
    return kpi.summary(leads(spark, sf))


def e5_by_zone(spark, sf):
    return kpi.by_group(leads(spark, sf), "zone")


def e7_by_source(spark, sf):
    return kpi.by_group(leads(spark, sf), "discovery_source")


def e9_by_municipality(spark, sf):
    return kpi.by_group(leads(spark, sf), "municipality")


def e4_phones_by_source(spark, sf):
    return kpi.phones_by_source(leads(spark, sf))


def e10_source_by_phone_class(spark, sf):
    return kpi.source_by_phone_class(leads(spark, sf))


def e3_quality(spark, sf):
    return kpi.quality(leads(spark, sf))


def e13_grouping_sets(spark, sf):
    return kpi.counted_sets(leads(spark, sf))


def e12_dashboard_summary(spark, sf):
    return kpi.dashboard_summary(leads(spark, sf), AS_OF)


def e14_funnel(spark, sf):
    return kpi.funnel(leads(spark, sf), ["novo", "contactado", "negociacao", "ganho", "perdido"])


def e15_leaderboard(spark, sf):
    return kpi.leaderboard(leads(spark, sf))


def e16_heatmap(spark, sf):
    return kpi.heatmap(leads(spark, sf), _centroids(spark, sf))


def e17_histogram(spark, sf):
    return kpi.histogram(leads(spark, sf))


def e18_recent_signals(spark, sf):
    return kpi.recent_signals(leads(spark, sf), view(spark, sf, NOTES), AS_OF, 30)


def e19_daily_series(spark, sf):
    return kpi.daily(leads(spark, sf), "1998-07-01", "1998-08-15")


def e21_run_report(spark, sf):
    rows = leads(spark, sf)
    return kpi.run_report(rows.where("first_seen_at < timestamp_ntz'1998-01-01 00:00:00'"), rows)


def e24_motives(spark, sf):
    words = F.filter(F.split("description", " "), lambda x: F.length(x) > 3)
    return kpi.motive_frequency(leads(spark, sf).select(words.alias("tags")))


def e27_job_reasons(spark, sf):
    rules = [("demo", F.col("is_demo")), ("archived", F.col("archived")), ("no_price", F.col("price").isNull()), ("no_contact", ~kpi.any_contact())]
    return kpi.reasons(leads(spark, sf), rules, "eligible")


def e29_contact_mix(spark, sf):
    return kpi.contact_mix(leads(spark, sf))


QUERIES = {f.__name__: f for f in (e1_summary, e3_quality, e4_phones_by_source, e5_by_zone, e7_by_source, e9_by_municipality, e10_source_by_phone_class, e12_dashboard_summary, e13_grouping_sets, e14_funnel, e15_leaderboard, e16_heatmap, e17_histogram, e18_recent_signals, e19_daily_series, e21_run_report, e24_motives, e27_job_reasons, e29_contact_mix)}

ORACLE_SQL = {
    "e1_summary": with_leads(f"""SELECT count(*) AS total, {N} (WHERE {PHONE}) AS with_phone, {pct(f"{N} (WHERE {PHONE})", "count(*)")} AS phone_rate,
  {N} (WHERE contact_phone LIKE '+3519%') AS mobile, {N} (WHERE contact_phone LIKE '+3512%') AS landline, {N} (WHERE lead_type = 'fsbo') AS fsbo,
  {pct(f"{N} (WHERE lead_type = 'fsbo')", "count(*)")} AS fsbo_rate, {pct(f"{N} (WHERE lead_type = 'fsbo' AND {PHONE})", f"{N} (WHERE lead_type = 'fsbo')")} AS fsbo_phone_rate,
  {N} (WHERE lead_type = 'frbo') AS frbo, {pct(f"{N} (WHERE lead_type = 'frbo')", "count(*)")} AS frbo_rate, {N} (WHERE lead_type = 'active_owner') AS active_owners,
  {N} (WHERE score >= 60) AS hot, {N} (WHERE score >= 40 AND score < 60) AS warm, {N} (WHERE score IS NULL OR score < 40) AS cold,
  {N} (WHERE {EMAIL}) AS with_email, {N} (WHERE contact_whatsapp <> '') AS with_whatsapp, {N} (WHERE contact_website <> '') AS with_website,
  {N} (WHERE {ANY}) AS with_any, {N} (WHERE NOT {ANY}) AS with_none, {N} (WHERE contact_confidence >= 80) AS confident, round(avg(score), 1) AS avg_score FROM live"""),
    "e3_quality": with_leads(f"SELECT CASE WHEN {PHONE} AND {OWNER} THEN 'high' WHEN {ANY} OR {OWNER} THEN 'medium' ELSE 'low' END AS quality, coalesce(score_label, 'COLD') AS label, count(*) AS n FROM live GROUP BY 1, 2"),
    "e4_phones_by_source": with_leads(f"SELECT coalesce(contact_source, 'unknown') AS name, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM live WHERE {PHONE} GROUP BY 1"),
    "e5_by_zone": _group("zone"),
    "e7_by_source": _group("discovery_source"),
    "e9_by_municipality": _group("municipality"),
    "e10_source_by_phone_class": with_leads(f"""SELECT discovery_source, count(*) AS total, {N} (WHERE {PHONE}) AS with_phone, {N} (WHERE contact_phone LIKE '+3519%') AS mobile,
  {N} (WHERE contact_phone LIKE '+3512%') AS landline, {N} (WHERE contact_phone LIKE '+3516%') AS relay, {pct(f"{N} (WHERE {PHONE})", "count(*)")} AS coverage,
  {pct(f"{N} (WHERE contact_phone LIKE '+3519%')", "count(*)")} AS mobile_rate FROM live GROUP BY 1"""),
    "e12_dashboard_summary": with_leads(f"""SELECT count(*) AS total, {N} (WHERE first_seen_at >= date_trunc('day', TIMESTAMP '{AS_OF}')) AS today, round(avg(price), 2) AS avg_price, {N} (WHERE price_changes > 0) AS price_cuts,
  {N} (WHERE price_delta_pct >= 15) AS opportunities, {N} (WHERE days_on_market >= 30) AS days_30, {N} (WHERE days_on_market >= 60) AS days_60,
  {N} (WHERE regexp_matches(description, 'urgente|remodelar')) AS urgent, count(DISTINCT zone) AS zones FROM live"""),
    "e13_grouping_sets": with_leads("""SELECT 'score_label' AS by, score_label AS value, count(*) AS n FROM live GROUP BY 2 UNION ALL SELECT 'zone', zone, count(*) FROM live GROUP BY 2
UNION ALL SELECT 'crm_stage', crm_stage, count(*) FROM live GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM live"""),
    "e14_funnel": with_leads(f"""SELECT place, stage, coalesce(n, 0) AS n, {pct("coalesce(n, 0)", "max(CASE WHEN place = 0 THEN coalesce(n, 0) END) OVER ()")} AS pct
FROM (VALUES (0, 'novo'), (1, 'contactado'), (2, 'negociacao'), (3, 'ganho'), (4, 'perdido')) d(place, stage) LEFT JOIN (SELECT crm_stage, count(*) AS n FROM live GROUP BY 1) c ON stage = crm_stage"""),
    "e15_leaderboard": with_leads(f"""SELECT * FROM (SELECT agency_name, count(*) AS total, {N} (WHERE score_label = 'HOT') AS hot, round(avg(score), 1) AS avg_score, round(avg(price), 2) AS avg_price,
  {pct(f"{N} (WHERE {PHONE} OR {EMAIL})", "count(*)")} AS contact_pct FROM live WHERE agency_name <> '' GROUP BY 1 ORDER BY total DESC, agency_name LIMIT 20) WHERE total >= 3"""),
    "e16_heatmap": with_leads(f"""SELECT zone, n, hot, avg_score, round(coalesce(lat, n_nationkey * 1.0), 4)::DOUBLE AS lat, round(coalesce(lon, 0.0), 4)::DOUBLE AS lon FROM
  (SELECT zone, count(*) AS n, {N} (WHERE score_label = 'HOT') AS hot, round(avg(score), 1) AS avg_score, avg(latitude::DOUBLE) AS lat, avg(longitude::DOUBLE) AS lon FROM live GROUP BY 1) z JOIN nation ON zone = n_name WHERE n >= 3"""),
    "e17_histogram": with_leads("SELECT (score // 10 * 10)::INT AS bin, count(*) AS n FROM live WHERE score IS NOT NULL GROUP BY 1"),
    "e18_recent_signals": with_leads(f"""SELECT {N} (WHERE first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS "new", {N} (WHERE first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND score_label = 'HOT') AS new_hot,
  {N} (WHERE crm_stage = 'contactado' AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS contacted, (SELECT count(*) FROM (SELECT 1 FROM live WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND contact_name IS NOT NULL GROUP BY contact_name HAVING count(*) >= 5)) AS super_sellers, (SELECT {N} (WHERE note_type = 'price_drop') FROM notes WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS drops FROM live"""),
    "e19_daily_series": with_leads(f"""SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, {pct("coalesce(hot, 0)", "coalesce(n, 0)")} AS hot_share, {pct("coalesce(reached, 0)", "coalesce(n, 0)")} AS contact_rate, avg_score
FROM (SELECT unnest(generate_series(TIMESTAMP '1998-07-01', TIMESTAMP '1998-08-15', INTERVAL 1 DAY)) AS day) d LEFT JOIN
  (SELECT date_trunc('day', first_seen_at) AS day, count(*) AS n, {N} (WHERE score_label = 'HOT') AS hot, {N} (WHERE {ANY}) AS reached, round(avg(score), 1) AS avg_score FROM live GROUP BY 1) c ON d.day = c.day"""),
    "e21_run_report": with_leads(f"""SELECT *, total_after - total_before AS total_diff, phone_after - phone_before AS phone_diff, hot_after - hot_before AS hot_diff,
  round(coalesce(phone_after * 100.0::DOUBLE / nullif(total_after, 0), 0) - coalesce(phone_before * 100.0::DOUBLE / nullif(total_before, 0), 0), 1) AS phone_points FROM
  (SELECT count(*) AS total_before, {N} (WHERE {PHONE}) AS phone_before, {N} (WHERE score_label = 'HOT') AS hot_before, {N} (WHERE contact_source LIKE 'cross_portal:%') AS crossed_before FROM live WHERE first_seen_at < TIMESTAMP '1998-01-01'),
  (SELECT count(*) AS total_after, {N} (WHERE {PHONE}) AS phone_after, {N} (WHERE score_label = 'HOT') AS hot_after, {N} (WHERE contact_source LIKE 'cross_portal:%') AS crossed_after FROM live)"""),
    "e24_motives": with_leads("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(description, ' ')) AS tag FROM leads) WHERE length(tag) > 3 GROUP BY 1 ORDER BY n DESC, tag LIMIT 8"),
    "e27_job_reasons": with_leads(f"SELECT CASE WHEN is_demo THEN 'demo' WHEN archived THEN 'archived' WHEN price IS NULL THEN 'no_price' WHEN NOT {ANY} THEN 'no_contact' ELSE 'eligible' END AS reason, count(*) AS n FROM leads GROUP BY 1"),
    "e29_contact_mix": with_leads(f"""SELECT discovery_source, count(*) AS n, {N} (WHERE {PHONE}) AS phone, {N} (WHERE NOT {PHONE} AND {EMAIL}) AS email_only, {N} (WHERE NOT {PHONE} AND NOT {EMAIL}) AS unreached,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM live GROUP BY 1"""),
}
