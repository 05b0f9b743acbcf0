"""Scoring, lists, histories and lifecycle queries (C, F, G, H, I, J), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import history, lifecycle, lists, scoring
from leadloom.plans.kpi_queries import ANY, EMAIL, PHONE
from leadloom.plans.views import AS_OF, NOTES, PRICES, leads, table, view, with_leads

SIGNALS = "SELECT s_suppkey AS id, n_name AS zone, CASE s_suppkey % 3 WHEN 0 THEN 'building_permit' ELSE 'renovation_ad' END AS signal_type, s_suppkey % 4 = 0 AS promoted, concat('fp', CAST(s_suppkey AS STRING)) AS fingerprint, CAST(s_suppkey % 100 AS INT) AS signal_score FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0"
ALERTS = "SELECT event_id AS id, value AS v, user_id AS lead_id, ts AS sent_at, event_type <> 'error' AS success FROM events WHERE event_type IN ('click', 'error')"
REQUESTS = "SELECT user_id AS lead_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'contactado' WHEN 'error' THEN 'perdido' WHEN 'click' THEN 'negociacao' WHEN 'view' THEN 'arquivado' ELSE 'novo' END AS to_stage FROM events"
STATUSES = "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 301 WHEN 3 THEN 410 ELSE 503 END AS INT) AS status FROM orders"
EVENTS_AS_OF = "2024-01-31 00:00:00"
ZONES = {"NATION_1": 5, "NATION_2": 5, "NATION_3": 3, "NATION_4": 2}
LIVE = "NOT archived AND NOT is_demo"


def _notes(spark, sf):
    return view(spark, sf, NOTES)


def _prices(spark, sf):
    return view(spark, sf, PRICES)


def f1_score(spark, sf):
    return scoring.score(leads(spark, sf), view(spark, sf, SIGNALS), AS_OF, ZONES)


def f12_phone_frequency(spark, sf):
    return scoring.phone_frequency(leads(spark, sf))


def f13_needs_rescore(spark, sf):
    return scoring.needs_rescore(leads(spark, sf), "1995-01-01 00:00:00", 48).select("id", "score")


def f14_score_bump(spark, sf):
    raised, label = scoring.bumped(F.col("score"), 15)
    return leads(spark, sf).where("priority_flag").select("id", raised.alias("score"), label.alias("score_label"))


def d13_sketched_benchmark(spark, sf):
    """Whether the values up to each sketched benchmark are half of its group's, give or take two hundredths and one value."""
    rows = leads(spark, sf)
    found = scoring.sketched_benchmark(scoring.benchmark_sketches(rows), digits=9)
    values = rows.where("price > 0 AND area_m2 > 0").select("zone", "typology", (F.col("price") / F.col("area_m2")).alias("v"))
    ranked = values.join(found, ["zone", "typology"]).groupBy("zone", "typology", "n").agg(F.count_if(F.col("v") <= F.col("benchmark") + 1e-6).alias("below"))
    return ranked.where("n >= 5").select("zone", "typology", "n", (F.abs(F.col("below") - F.col("n") / 2) <= 1 + 0.02 * F.col("n")).alias("is_median"))


def d13_learned_benchmark(spark, sf):
    return scoring.learned_benchmark(leads(spark, sf))


def d12_benchmark_join(spark, sf):
    bench = table(spark, sf, "nation").where("n_nationkey < 15").select(F.col("n_name").alias("zone"), F.explode(F.array(*map(F.lit, ("T2", "T1", "Moradia")))).alias("typology"), (F.col("n_nationkey") * 100.0 + 1000).alias("base"))
    bench = bench.where("NOT (zone = 'NATION_5' AND typology = 'T2')").withColumn("benchmark", F.col("base") + F.length("typology"))
    return scoring.with_benchmark(leads(spark, sf), bench, digits=None)


def g1_price_drops(spark, sf):
    return history.price_drops(_prices(spark, sf), EVENTS_AS_OF)


def g1_drop_stats(spark, sf):
    return history.drop_stats(_prices(spark, sf), EVENTS_AS_OF)


def g2_price_changes(spark, sf):
    return history.price_changes(_prices(spark, sf))


def g2_accepted_changes(spark, sf):
    return history.accepted_changes(_prices(spark, sf), ratio=0.5)


def _versions(spark, sf):
    old = leads(spark, sf)
    new = old.select("id", F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" novo"))).otherwise(F.col("title")).alias("title"), F.when(F.col("id") % 9 == 0, F.concat("description", F.lit(" com todas as divisoes renovadas e luz"))).when(F.col("id") % 12 == 0, F.reverse("description")).otherwise(F.col("description")).alias("description"), F.when(F.col("id") % 5 == 0, F.lit("Other House")).otherwise(F.col("agency_name")).alias("agency_name"), F.when(F.col("id") % 7 == 0, F.lit("+351910000001")).otherwise(F.col("contact_phone")).alias("contact_phone"))
    return old, new


def g3_text_edits(spark, sf):
    return history.edits(*_versions(spark, sf))


def g4_edit_notes(spark, sf):
    return history.edit_notes(history.edits(*_versions(spark, sf)))


def g5_best_per_phone(spark, sf):
    return lists.best_per_phone(leads(spark, sf))


def g7_price_in_force(spark, sf):
    return history.price_in_force(_notes(spark, sf).withColumn("created_at", F.expr("created_at - interval 1 hour")), _prices(spark, sf))


def c1_active_page(spark, sf):
    return lists.active(leads(spark, sf), zone="NATION_1", score_min=30, contact="any", offset=20, limit=50).select("id", "score", "is_demo")


def c5_preset(spark, sf):
    return lists.active(leads(spark, sf), **lists.PRESETS["hot_reachable"]).select("id", "score")


def c8_without_demo(spark, sf):
    return lifecycle.without_demo(leads(spark, sf), _notes(spark, sf)).select("id", "lead_id")


def h2_digest(spark, sf):
    return lists.digest(leads(spark, sf)).select("id", "score", "days_on_market")


def h3_hot_focus(spark, sf):
    return lists.hot_focus(leads(spark, sf)).select("id", "priority_flag", "score")


def h4_premium(spark, sf):
    return lists.premium(leads(spark, sf)).select("id", "contact_phone", "rank_key")


def h5_expanded(spark, sf):
    return lists.expanded(leads(spark, sf), lists.premium(leads(spark, sf)))


def h10_top_actionable(spark, sf):
    return lists.top_actionable(leads(spark, sf), 50).select("id", "contact_confidence", "source_rank", "score", "owner_rank")


def h11_per_stage(spark, sf):
    return lists.per_stage(leads(spark, sf)).select("crm_stage", "place", "id", "score")


def d23_seller_rollup(spark, sf):
    return lists.similar_sellers(leads(spark, sf))


def i4_timeline(spark, sf):
    return lists.timeline(leads(spark, sf), _notes(spark, sf), EVENTS_AS_OF, 24 * 30, note_limit=300).withColumn("ts", F.col("ts").cast("string"))


def i6_alert_feed(spark, sf):
    return lists.alert_feed(leads(spark, sf), 100)


def a13_deliverable(spark, sf):
    return lists.deliverable(leads(spark, sf))


def b31_contact_list(spark, sf):
    return lists.contact_list(leads(spark, sf))


def j1_reminders(spark, sf):
    return lifecycle.reminders(leads(spark, sf), _notes(spark, sf), AS_OF)


def e26_pending_per_stage(spark, sf):
    return lifecycle.pending_per_stage(leads(spark, sf), _notes(spark, sf), AS_OF)


def j2_stale(spark, sf):
    return lifecycle.stale(leads(spark, sf), _notes(spark, sf).withColumn("created_at", F.col("created_at") - F.expr("interval 9360 days")), AS_OF)


def j3_dropped(spark, sf):
    return lifecycle.dropped(leads(spark, sf), view(spark, sf, STATUSES))


def j4_stage_moves(spark, sf):
    return lifecycle.moves(view(spark, sf, REQUESTS), leads(spark, sf))


def j6_promote(spark, sf):
    known = leads(spark, sf).select(F.concat(F.lit("fp"), (F.col("id") % 50).cast("string")).alias("fingerprint"))
    return lifecycle.promote(view(spark, sf, SIGNALS), known)


def j9_bulk_update(spark, sf):
    return lifecycle.bulk_update(leads(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("id")), priority=True, archive=False)


def d18_due_alerts(spark, sf):
    return lifecycle.due_alerts(leads(spark, sf), view(spark, sf, ALERTS), "2024-01-15 00:00:00").select("id", "score")


QUERIES = {f.__name__: f for f in (f1_score, f12_phone_frequency, f13_needs_rescore, f14_score_bump, d12_benchmark_join, d13_learned_benchmark, d13_sketched_benchmark, g1_price_drops, g1_drop_stats, g2_price_changes, g2_accepted_changes, g3_text_edits, g4_edit_notes, g5_best_per_phone, g7_price_in_force, c1_active_page, c5_preset, c8_without_demo, h2_digest, h3_hot_focus, h4_premium, h5_expanded, h10_top_actionable, h11_per_stage, d23_seller_rollup, i4_timeline, i6_alert_feed, a13_deliverable, b31_contact_list, j1_reminders, e26_pending_per_stage, j2_stale, j3_dropped, j4_stage_moves, j6_promote, j9_bulk_update, d18_due_alerts)}

_DROPS = f"""SELECT lead_id, count(*) AS observations, max(price) AS peak_price, arg_min(recorded_at, recorded_at) FILTER (WHERE price = peak) AS peak_at, arg_max(price, recorded_at) AS last_price, max(recorded_at) AS last_at
  FROM (SELECT *, max(price) OVER (PARTITION BY lead_id) AS peak FROM prices WHERE recorded_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) GROUP BY lead_id"""
_DROP_ROWS = f"""SELECT lead_id, observations, peak_price, last_price, round((peak_price - last_price) / peak_price, 4) AS drop_pct, round(peak_price - last_price, 2) AS drop_abs, greatest(date_sub('day', peak_at, last_at), 0) AS days_since_peak
  FROM ({_DROPS}) WHERE observations >= 2 AND peak_price > 0 AND (peak_price - last_price) / peak_price >= 0.05 AND last_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY"""
_SIMILAR = "(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))::DOUBLE)"
_EDITS = f"""pairs AS (SELECT id, title AS t0, CASE WHEN id % 2 = 0 THEN concat(title, ' novo') ELSE title END AS t1, description AS d0,
  CASE WHEN id % 9 = 0 THEN concat(description, ' com todas as divisoes renovadas e luz') WHEN id % 12 = 0 THEN reverse(description) ELSE description END AS d1,
  agency_name AS a0, CASE WHEN id % 5 = 0 THEN 'Other House' ELSE agency_name END AS a1, contact_phone AS p0, CASE WHEN id % 7 = 0 THEN '+351910000001' ELSE contact_phone END AS p1 FROM leads),
edits AS (
  SELECT id, 'title' AS field, CASE WHEN {_SIMILAR.format(a="t0", b="t1")} < 0.78 THEN 'rewrite' WHEN contains(t1, t0) AND length(t1) > length(t0) + 30 THEN 'appended' ELSE 'edit' END AS severity, t0[:200] AS old, t1[:200] AS new FROM pairs WHERE t0 <> t1
  UNION ALL SELECT id, 'description', CASE WHEN {_SIMILAR.format(a="d0", b="d1")} < 0.78 THEN 'rewrite' WHEN contains(d1, d0) AND length(d1) > length(d0) + 30 THEN 'appended' ELSE 'edit' END, d0[:200], d1[:200] FROM pairs WHERE d0 <> d1
  UNION ALL SELECT id, 'agency_name', 'switch', a0, a1 FROM pairs WHERE a0 <> '' AND a1 <> '' AND lower(a0) <> lower(a1) AND {_SIMILAR.format(a="a0", b="a1")} < 0.85
  UNION ALL SELECT id, 'contact_phone', 'switch', p0, p1 FROM pairs WHERE p0 <> '' AND p1 <> '' AND p0 <> p1)"""
_NATIONAL = "coalesce(replace(contact_phone, '+351', ''), '')"
_TEXT = "lower(concat_ws(' ', title, description))"
_PREMIUM = f"""premium AS (SELECT id, contact_phone, rank_key FROM (SELECT *, row_number() OVER (PARTITION BY contact_phone ORDER BY rank_key DESC, id) AS place FROM (SELECT *, score + CASE phone_type WHEN 'mobile' THEN 5 WHEN 'relay' THEN 2 ELSE 0 END AS rank_key FROM leads
  WHERE {LIVE} AND {PHONE} AND score >= 50 AND owner_type <> 'agency' AND NOT (contact_phone LIKE '+35121%' OR contact_phone LIKE '+35122%') ORDER BY rank_key DESC, id LIMIT 500)) WHERE place = 1 ORDER BY rank_key DESC, id LIMIT 100)"""
_BEST = f"SELECT id, contact_phone, score FROM (SELECT *, row_number() OVER (PARTITION BY contact_phone ORDER BY coalesce(score, -1) DESC, id) AS place FROM live WHERE {PHONE}) WHERE place = 1"
_REMIND = f"""due AS (SELECT id, stage, idle_days, threshold FROM (SELECT id, crm_stage AS stage, date_sub('day', last_seen_at, TIMESTAMP '{AS_OF}') AS idle_days FROM live),
  LATERAL (SELECT max(d) AS threshold FROM (VALUES ('novo', 1), ('novo', 3), ('contactado', 3), ('contactado', 7), ('contactado', 14), ('negociacao', 2), ('negociacao', 5), ('negociacao', 10)) s(st, d) WHERE st = stage AND d <= idle_days)
  WHERE idle_days > 0 AND threshold IS NOT NULL AND id NOT IN (SELECT lead_id FROM notes WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY))"""

ORACLE_SQL = {
    "f1_score": with_leads(f"""SELECT id, price_opportunity, urgency_signals, owner_direct, days_on_market, data_quality, zone_priority, contact_quality, phone_type_bonus, recency_bonus, agency_penalty, contact_confidence_bonus, repeated_phone_penalty, premarket_signal_bonus, total,
  CASE WHEN total >= 60 THEN 'HOT' WHEN total >= 40 THEN 'WARM' ELSE 'COLD' END AS label FROM (SELECT *, CASE WHEN reach THEN clamped ELSE least(clamped, 59) END AS total FROM (SELECT *, greatest(0, least(100, price_opportunity + urgency_signals + owner_direct + days_on_market + data_quality + zone_priority
  + contact_quality + phone_type_bonus + recency_bonus + agency_penalty + contact_confidence_bonus + repeated_phone_penalty + premarket_signal_bonus)) AS clamped FROM (SELECT id, {PHONE} OR {EMAIL} AS reach,
  CASE WHEN price_delta_pct >= 20 THEN 30 WHEN price_delta_pct >= 10 THEN 20 WHEN price_delta_pct >= 5 THEN 10 WHEN price_delta_pct >= 0 THEN 5 ELSE 0 END AS price_opportunity,
  CASE WHEN regexp_matches({_TEXT}, '\\burgente\\b') THEN 25 WHEN regexp_matches({_TEXT}, '\\bpara remodelar\\b') THEN 10 WHEN regexp_matches({_TEXT}, '\\baceito propostas\\b') THEN 8 ELSE 0 END AS urgency_signals,
  CASE WHEN lead_type = 'frbo' THEN CASE WHEN phone_type = 'mobile' THEN 25 ELSE 20 END WHEN lead_type = 'active_owner' THEN CASE WHEN phone_type = 'mobile' THEN 18 ELSE 15 END WHEN owner_type = 'fsbo' THEN CASE WHEN phone_type = 'mobile' THEN 25 ELSE 20 END WHEN owner_type = 'unknown' THEN 10 WHEN owner_type = 'developer' THEN 5 ELSE 0 END AS owner_direct,
  CASE WHEN days_on_market >= 90 THEN 15 WHEN days_on_market >= 60 THEN 10 WHEN days_on_market >= 30 THEN 5 ELSE 0 END AS days_on_market,
  CASE WHEN area_m2 > 0 AND price > 0 THEN 5 WHEN area_m2 > 0 THEN 3 WHEN price > 0 THEN 1 ELSE 0 END AS data_quality,
  CASE zone WHEN 'NATION_1' THEN 5 WHEN 'NATION_2' THEN 5 WHEN 'NATION_3' THEN 3 WHEN 'NATION_4' THEN 2 ELSE 1 END AS zone_priority,
  CASE WHEN {PHONE} THEN CASE WHEN phone_type = 'mobile' THEN CASE WHEN owner_type = 'agency' THEN 15 ELSE 20 END WHEN phone_type = 'relay' THEN 10 WHEN phone_type = 'landline' THEN 5 ELSE 12 END WHEN {EMAIL} THEN 5 ELSE -15 END AS contact_quality,
  CASE WHEN phone_type = 'mobile' THEN CASE WHEN owner_type = 'agency' THEN 3 ELSE 8 END WHEN phone_type = 'relay' THEN 0 WHEN {_NATIONAL}[:2] IN ('21', '22') THEN -8 WHEN phone_type = 'landline' THEN -3 ELSE 0 END AS phone_type_bonus,
  CASE WHEN date_sub('day', first_seen_at, TIMESTAMP '{AS_OF}') <= 7 THEN 5 ELSE 0 END AS recency_bonus, CASE WHEN owner_type = 'agency' THEN -10 ELSE 0 END AS agency_penalty,
  CASE WHEN contact_confidence >= 80 THEN 3 WHEN contact_confidence >= 60 THEN 1 ELSE 0 END AS contact_confidence_bonus,
  CASE WHEN NOT {PHONE} THEN 0 WHEN same >= 8 THEN -10 WHEN same >= 4 THEN -5 ELSE 0 END AS repeated_phone_penalty, coalesce(bonus, 0) AS premarket_signal_bonus
  FROM (SELECT *, count(*) FILTER (WHERE NOT is_demo) OVER (PARTITION BY contact_phone) AS same FROM leads) LEFT JOIN (SELECT zone AS z, max(CASE WHEN signal_type LIKE '%permit%' THEN 10 ELSE 5 END) AS bonus FROM ({SIGNALS}) GROUP BY 1) ON zone = z)))"""),
    "f12_phone_frequency": with_leads("SELECT contact_phone, count(*) AS n FROM leads WHERE contact_phone IS NOT NULL AND NOT is_demo GROUP BY 1"),
    "f13_needs_rescore": with_leads("SELECT id, score FROM leads WHERE NOT archived AND (scored_at IS NULL OR scored_at < TIMESTAMP '1994-12-30')"),
    "f14_score_bump": with_leads("SELECT id, least(100, coalesce(score, 0) + 15) AS score, CASE WHEN coalesce(score, 0) + 15 >= 60 THEN 'HOT' WHEN coalesce(score, 0) + 15 >= 40 THEN 'WARM' ELSE 'COLD' END AS score_label FROM leads WHERE priority_flag"),
    "d12_benchmark_join": with_leads("""SELECT id, zone, typology, per AS price_per_m2, bench AS price_benchmark, (bench - per) / bench * 100 AS delta_pct FROM (SELECT id, zone, typology, CASE WHEN price > 0 AND area_m2 > 0 THEN price / area_m2 END AS per,
  CASE WHEN n_nationkey < 15 AND typology IN ('T2', 'T1', 'Moradia') AND NOT (zone = 'NATION_5' AND typology = 'T2') THEN n_nationkey * 100.0::DOUBLE + 1000 + length(typology) WHEN n_nationkey < 15 THEN n_nationkey * 100.0::DOUBLE + 1000 + 2 ELSE 2500.0::DOUBLE END AS bench FROM leads JOIN nation ON zone = n_name)"""),
    "d13_sketched_benchmark": with_leads("SELECT zone, typology, count(*) AS n, true AS is_median FROM leads WHERE price > 0 AND area_m2 > 0 GROUP BY 1, 2 HAVING count(*) >= 5"),
    "d13_learned_benchmark": with_leads("""SELECT b.zone, typology, n, round(CASE WHEN n >= 5 THEN own ELSE zm END, 2) AS benchmark FROM (SELECT zone, typology, count(*) AS n, median(price / area_m2) AS own FROM leads WHERE price > 0 AND area_m2 > 0 GROUP BY 1, 2) b
  JOIN (SELECT zone, median(price / area_m2) AS zm FROM leads WHERE price > 0 AND area_m2 > 0 GROUP BY 1) z ON b.zone = z.zone"""),
    "g1_price_drops": with_leads(_DROP_ROWS),
    "g1_drop_stats": with_leads(f"SELECT count(*) AS dropped, round(avg(drop_pct), 4) AS avg_drop FROM ({_DROP_ROWS})"),
    "g2_price_changes": with_leads("SELECT lead_id, count(*) AS observations, count(*) FILTER (WHERE abs((price - before) / before) > 0.005) AS changes, arg_min(price, (recorded_at, id)) AS first_price, arg_max(price, (recorded_at, id)) AS last_price FROM (SELECT *, lag(price) OVER (PARTITION BY lead_id ORDER BY recorded_at, id) AS before FROM prices) GROUP BY 1"),
    "g2_accepted_changes": with_leads("""SELECT lead_id, len(acc) - 1 AS accepted, acc[-1] AS price FROM (SELECT lead_id, list_reduce(list_transform(list(price ORDER BY recorded_at, id), lambda x: [x]), lambda a, x: CASE WHEN abs((x[1] - a[-1]) / a[-1]) > 0.5 THEN list_append(a, x[1]) ELSE a END) AS acc FROM prices GROUP BY 1)"""),
    "g3_text_edits": with_leads("").rstrip() + f", {_EDITS} SELECT id, field, severity, old, new FROM edits",
    "g4_edit_notes": with_leads("").rstrip() + f""", {_EDITS} SELECT id, count(*) AS n_changes, '[' || string_agg('{{"field":' || to_json(field) || ',"severity":' || to_json(severity) || ',"old":' || to_json(old) || ',"new":' || to_json(new) || '}}', ',' ORDER BY field) || ']' AS changeset FROM edits GROUP BY 1""",
    "g5_best_per_phone": with_leads(_BEST),
    "g7_price_in_force": with_leads("SELECT n.id AS note_id, n.lead_id, p.price AS in_force FROM (SELECT * REPLACE (created_at - INTERVAL 1 HOUR AS created_at) FROM notes) n ASOF LEFT JOIN prices p ON n.lead_id = p.lead_id AND n.created_at >= p.recorded_at"),
    "c1_active_page": with_leads(f"SELECT id, score, is_demo FROM leads WHERE NOT archived AND zone = 'NATION_1' AND score >= 30 AND ({PHONE} OR {EMAIL}) ORDER BY is_demo, score DESC NULLS LAST, id LIMIT 50 OFFSET 20"),
    "c5_preset": with_leads(f"SELECT id, score FROM leads WHERE NOT archived AND score >= 60 AND {PHONE}"),
    "c8_without_demo": with_leads("SELECT id, lead_id FROM notes WHERE lead_id NOT IN (SELECT id FROM leads WHERE is_demo)"),
    "h2_digest": with_leads("SELECT id, score, days_on_market FROM live WHERE score >= 50 ORDER BY score DESC, days_on_market DESC NULLS LAST, last_seen_at DESC, id LIMIT 20"),
    "h3_hot_focus": with_leads("SELECT id, priority_flag, score FROM live WHERE score_label = 'HOT' ORDER BY priority_flag DESC, score DESC, days_on_market DESC NULLS LAST, last_seen_at DESC, id LIMIT 50"),
    "h4_premium": with_leads("").rstrip() + f", {_PREMIUM} SELECT * FROM premium",
    "h5_expanded": with_leads("").rstrip() + f", {_PREMIUM} SELECT id, contact_phone, score FROM ({_BEST}) WHERE score >= 20 AND contact_phone NOT IN (SELECT contact_phone FROM premium) ORDER BY score DESC, id LIMIT 200",
    "h10_top_actionable": with_leads("SELECT id, contact_confidence, CASE WHEN contact_source LIKE 'cross_portal:%' THEN 2 WHEN contact_source LIKE 'website:%' THEN 1 ELSE 3 END AS source_rank, score, CASE owner_type WHEN 'fsbo' THEN 3 WHEN 'unknown' THEN 2 ELSE 1 END AS owner_rank FROM live WHERE contact_confidence > 0 ORDER BY contact_confidence DESC, source_rank DESC, score DESC NULLS LAST, owner_rank DESC, id LIMIT 50"),
    "h11_per_stage": with_leads("SELECT crm_stage, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY crm_stage ORDER BY score DESC NULLS LAST, id) AS place FROM live) WHERE place <= 30"),
    "d23_seller_rollup": with_leads("SELECT id, n AS listings, n >= 5 AS super_seller, CASE WHEN n >= 10 AND owner_type = 'fsbo' THEN 'agency' ELSE owner_type END AS owner_type FROM (SELECT *, count(*) OVER (PARTITION BY contact_name) AS n FROM leads)"),
    "i4_timeline": with_leads(f"SELECT kind, lead_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || coalesce(nullif('.' || rtrim(strftime(ts, '%f'), '0'), '.'), '') AS ts, id FROM (SELECT 'note' AS kind, lead_id, created_at AS ts, id FROM notes WHERE created_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY ORDER BY created_at DESC, id LIMIT 300) ORDER BY ts DESC, kind, id LIMIT 200"),
    "i6_alert_feed": with_leads(f"""SELECT id, score, rule_no, rule FROM (SELECT id, score, rules, generate_subscripts(rules, 1)::INT - 1 AS rule_no, unnest(rules) AS rule FROM (SELECT id, score, list_filter([CASE WHEN score_label = 'HOT' AND {PHONE} THEN 'hot' WHEN price_delta_pct >= 20 THEN 'cheap' WHEN days_on_market >= 90 THEN 'old' END, CASE WHEN contains(description, 'urgente') THEN 'urgent' END], lambda x: x IS NOT NULL) AS rules FROM live)) ORDER BY score DESC NULLS LAST, id, rule_no LIMIT 100"""),
    "a13_deliverable": with_leads(f"SELECT 'owners' AS sheet, id, zone, price, score FROM live WHERE owner_type = 'fsbo' UNION ALL SELECT 'agencies', id, zone, price, score FROM live WHERE owner_type = 'agency' UNION ALL SELECT 'reachable', id, zone, price, score FROM live WHERE {ANY} UNION ALL SELECT 'hot', id, zone, price, score FROM live WHERE score_label = 'HOT'"),
    "b31_contact_list": with_leads(f"""SELECT id, string_split(contact_name, ' ')[1] AS first_name, coalesce(array_to_string(string_split(contact_name, ' ')[2:], ' '), '') AS last_name, CASE WHEN {PHONE} THEN 'https://wa.me/' || contact_phone[2:] || '?text=Bom%20dia%20' || replace(string_split(contact_name, ' ')[1], '#', '%23') END AS link,
  coalesce(nullif(concat_ws('; ', CASE WHEN contains(description, 'urgente') THEN 'urgent' END, CASE WHEN days_on_market >= 60 THEN days_on_market || ' days' END, CASE WHEN price_delta_pct >= 10 THEN price_delta_pct::INT || '% below' END), ''), '-') AS insight,
  CASE WHEN contact_confidence >= 80 THEN 'ALTA' WHEN contact_confidence >= 50 THEN 'MÉDIA' ELSE 'BAIXA' END AS confidence, strftime(first_seen_at, '%d/%m/%Y') AS seen, typology || ' · ' || zone AS label FROM live"""),
    "j1_reminders": with_leads("").rstrip() + f", {_REMIND} SELECT * FROM due",
    "e26_pending_per_stage": with_leads("").rstrip() + f", {_REMIND} SELECT s.stage, (SELECT count(*) FROM due WHERE due.stage = s.stage) AS n FROM (VALUES ('novo'), ('contactado'), ('negociacao')) s(stage)",
    "j2_stale": with_leads(f"""SELECT id, CASE WHEN crm_stage IN ('contactado', 'negociacao') THEN 'kept_active_stage' WHEN priority_flag THEN 'kept_priority' WHEN id IN (SELECT lead_id FROM notes WHERE created_at - INTERVAL 9360 DAY >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY) THEN 'kept_recent_note' ELSE 'archived' END AS outcome FROM live WHERE last_seen_at IS NULL OR last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY"""),
    "j3_dropped": f"SELECT id, status, CASE WHEN status IN (404, 410) THEN 'dropped' WHEN status BETWEEN 200 AND 399 THEN 'alive' ELSE 'error' END AS outcome FROM ({STATUSES})",
    "j6_promote": f"SELECT fingerprint, zone, signal_score AS score, CASE WHEN signal_score >= 50 THEN 'WARM' ELSE 'COLD' END AS score_label FROM ({SIGNALS}) WHERE NOT promoted AND fingerprint NOT IN (SELECT concat('fp', (o_orderkey % 50)::VARCHAR) FROM orders)",
    "j9_bulk_update": with_leads("SELECT id, priority_flag OR id IN (SELECT p_partkey FROM part) AS priority_flag, archived AND id NOT IN (SELECT p_partkey FROM part) AS archived FROM leads"),
    "d18_due_alerts": with_leads(f"SELECT id, score FROM live WHERE score_label = 'HOT' AND id NOT IN (SELECT lead_id FROM ({ALERTS}) WHERE success AND sent_at >= TIMESTAMP '2024-01-15')"),
}
_MOVES = " OR ".join(f"(a[1] = '{a}' AND x[1] IN ({', '.join(repr(b) for b in bs)}))" for a, bs in lifecycle.TRANSITIONS.items())
ORACLE_SQL["j4_stage_moves"] = with_leads(f"""SELECT lead_id, acc[1] AS stage, acc[2]::INT AS accepted, acc[3]::INT AS refused, acc[1] = 'arquivado' AS archived FROM (SELECT lead_id, list_reduce(list_prepend([any_value(crm_stage), '0', '0'], list([to_stage] ORDER BY seq)),
  lambda a, x: CASE WHEN {_MOVES} THEN [x[1], (a[2]::INT + 1)::VARCHAR, a[3]] ELSE [a[1], a[2], (a[3]::INT + 1)::VARCHAR] END) AS acc FROM ({REQUESTS}) JOIN leads ON lead_id = leads.id GROUP BY 1)""")
