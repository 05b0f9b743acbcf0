"""Outreach, filter, sink, import and streaming queries (A, B, C, D, E, G, H, I, J, N), with their oracles."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from leadloom.functions import contact
from leadloom.operators import history, kpi, lifecycle, lists, normalize, outreach, resolve, search
from leadloom.plans.data_queries import _drained, _index, _stream
from leadloom.plans.kpi_queries import EMAIL, PHONE
from leadloom.plans.more_queries import PERMITS, SIGNAL_ROWS
from leadloom.plans.views import AS_OF, NOTES, PRICES, leads, shared_dir, table, view, with_leads
from leadloom.sources import html, ingest
from leadloom.streaming import streams

MOTIVE_ROWS = """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'Herança de família, venda rápida' WHEN 1 THEN 'divórcio' WHEN 2 THEN 'Emigração para França' WHEN 3 THEN 'URGENTE' WHEN 4 THEN 'para remodelar, obras' WHEN 5 THEN 'partilhas entre herdeiros' WHEN 6 THEN 'mudança de cidade' WHEN 7 THEN 'casa bonita' WHEN 8 THEN NULL ELSE concat('lote ', CAST(o_custkey AS STRING)) END AS description FROM orders"""
SNIPPETS = """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Moved to Lisboa, new role' WHEN 1 THEN 'Excited to join Acme' WHEN 2 THEN 'agora em Cascais' WHEN 3 THEN 'Novo emprego' WHEN 4 THEN 'likes boats' ELSE NULL END AS snippet,
  CASE c_custkey % 5 WHEN 0 THEN concat(c_name, ' - Engineer at Acme | Site') WHEN 1 THEN concat(c_name, ' - Chef @ Blue | Site') WHEN 2 THEN concat(c_name, ' - Painter | Site') WHEN 3 THEN c_name ELSE 'Al - Cook' END AS title FROM customer"""
GOODS = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN CONCAT(CAST(p_partkey AS STRING), ' €') WHEN 1 THEN concat(CAST(p_partkey % 900 AS STRING), '.500 €') WHEN 2 THEN 'n/d' WHEN 3 THEN concat(CAST(p_partkey % 90 AS STRING), '.250,50') ELSE NULL END AS raw FROM part"""
RECORDS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN NULL ELSE concat('Casa ', CAST(o_orderkey AS STRING)) END AS title, CASE o_orderkey % 7 WHEN 0 THEN 'Veículos usados' WHEN 1 THEN 'Moda' WHEN 2 THEN NULL ELSE 'Imóveis' END AS category,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://www.other.es/x' WHEN 1 THEN 'https://other.es/y' ELSE 'https://x.pt/z' END AS url, CASE o_orderkey % 3 WHEN 0 THEN 'Évora' ELSE n_name END AS zone, CASE o_orderkey % 6 WHEN 0 THEN 'evora' WHEN 3 THEN 'porto' ELSE lower(n_name) END AS asked FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
NESTED = """SELECT p_partkey AS id, concat('{"title":"', CASE WHEN p_partkey % 8 = 0 THEN 'Abc' ELSE concat('Casa ', p_brand) END, '","categoryName":"', CASE WHEN p_partkey % 7 = 0 THEN 'Desporto' ELSE 'Casas' END, '","listID":', CAST(p_partkey AS STRING), ',"price":', CAST(p_size AS STRING), ',"name":"', p_brand, '","companyAd":', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END, ',"locationNames":{"district":"Lisboa"', CASE WHEN p_partkey % 2 = 0 THEN ',"county":"Oeiras"' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ',"parish":""' ELSE ',"parish":"Algés"' END, '}}') AS payload FROM part"""
STATE_PAGES = """SELECT p_partkey AS page_id, concat('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"listItems":[{"listID":', CAST(p_partkey AS STRING), ',"price":', CAST(p_size AS STRING), '},{"listID":', CAST(p_partkey + 1000000 AS STRING), ',"price":1}]}}}</script></html>') AS html FROM part"""
COMPANIES = "SELECT concat('Agency ', CAST(s_suppkey AS STRING)) AS agency_name, CASE WHEN s_suppkey % 2 = 0 THEN concat('+35121', lpad(CAST(s_suppkey AS STRING), 7, '6')) END AS phone, CASE WHEN s_suppkey % 3 = 0 THEN concat('geral@a', CAST(s_suppkey AS STRING), '.pt') END AS email, concat('a', CAST(s_suppkey AS STRING), '.pt') AS domain FROM supplier WHERE s_suppkey < 24"
ADS = """SELECT o_orderkey AS id, c_custkey % 9 = 0 AS odd, CASE o_orderkey % 5 WHEN 0 THEN concat('Ligue 91', lpad(CAST(o_custkey % 9000000 + 1234567 AS STRING), 7, '4')) WHEN 1 THEN concat('escreva para ana', CAST(o_custkey AS STRING), '@casa.pt hoje') WHEN 2 THEN concat('ver www.casa', CAST(o_custkey % 90 AS STRING), '.pt hoje') ELSE 'sem contacto' END AS ad,
  CASE WHEN o_custkey % 4 = 0 THEN '+351912345678' END AS contact_phone, CASE WHEN o_custkey % 3 = 0 THEN 'x@y.pt' END AS contact_email, CASE WHEN o_custkey % 7 = 0 THEN 'z.pt' END AS contact_website FROM orders JOIN customer ON o_custkey = c_custkey"""
SIGNAL_FEED = "SELECT o_orderkey AS id, o_orderpriority AS source, CASE o_orderkey % 3 WHEN 0 THEN 'building_permit' WHEN 1 THEN 'job_change' ELSE 'renovation_ad' END AS signal_type, o_orderstatus AS zone, CAST(o_custkey % 100 AS INT) AS signal_score, o_orderdate AS created_at FROM orders"
STAGES = ("novo", "contactado", "negociacao", "ganho", "perdido")


#: Leads of which some channels are known, with texts that name others.
HALF_KNOWN = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'ligue 912 345 678' WHEN 1 THEN 'escreva a Rui.X@casa.pt' WHEN 2 THEN 'ver www.casa-x.pt' WHEN 3 THEN 'whatsapp 961 234 567' WHEN 4 THEN '' END AS description,
  CASE o_orderkey % 7 WHEN 0 THEN 'T2, tel 213456789' WHEN 1 THEN 'T1 wa.me/351931112223' ELSE 'T3' END AS title, CASE WHEN o_orderkey % 11 = 0 THEN '+351910000001' END AS contact_phone, CASE WHEN o_orderkey % 13 = 0 THEN 'a@b.pt' END AS contact_email,
  CASE WHEN o_orderkey % 17 = 0 THEN '+351920000001' END AS contact_whatsapp, CASE WHEN o_orderkey % 9 = 0 THEN 'z.pt' END AS contact_website, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' END AS contact_source, CASE WHEN o_orderkey % 2 = 0 THEN 'Ana' END AS contact_name,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS discovery_source, 7 AS contact_confidence FROM orders"""

#: Imported rows that hold one thing, several, or nothing.
THIN = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN '912345678' END AS contact_phone, CASE WHEN o_orderkey % 7 = 0 THEN 'a@b.pt' ELSE '' END AS contact_email, CASE WHEN o_orderkey % 5 = 0 THEN 'T2' END AS title,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Lisboa' ELSE '' END AS zone, CASE WHEN o_orderkey % 9 = 0 THEN 'Rua X' END AS address FROM orders"""


def b8_first_url(spark, sf):
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("u"), F.col("l_partkey").cast("string"))).otherwise("").alias("url")))).alias("sources"))
    return seen.select("id", outreach.first_url(F.col("sources")).alias("url"))


def b16_goods_price(spark, sf):
    return view(spark, sf, GOODS).select("id", outreach.goods_price(F.col("raw"), 50_000).alias("goods"), outreach.goods_price(F.col("raw"), 500_000, 15_000).alias("vehicle"))


def b30_motives(spark, sf):
    return view(spark, sf, MOTIVE_ROWS).select("id", F.array_join(outreach.motives(F.col("description")), ",").alias("motives"))


def b33_signal_type(spark, sf):
    name, role, company = outreach.person(F.col("title"))
    return view(spark, sf, SNIPPETS).select("id", outreach.signal_type(F.col("snippet")).alias("signal_type"), name.alias("name"), role.alias("role"), company.alias("company"))


def b37_label_codes(spark, sf):
    rows = table(spark, sf, "orders")
    kind = lifecycle.mapped(F.col("o_orderpriority"), {"1-urgent": "fsbo", "2-high": "frbo", "3-medium": "agency_listing"}, "unknown")
    return rows.select("o_orderkey", kind.alias("lead_type"))


def c4_client_zones(spark, sf):
    rows = leads(spark, sf)
    return rows.where(outreach.in_zones(F.col("zone"), ("NATION_1", "nation_7"), ("nation_2",)) & outreach.individual()).select("id", "zone")


def c7_without_rooms(spark, sf):
    rows = view(spark, sf, "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Quarto mobilado' WHEN 1 THEN 'T2 com quartos amplos' WHEN 2 THEN 'vaga  em quarto' WHEN 3 THEN 'Camarote' WHEN 4 THEN NULL ELSE p_name END AS title FROM part")
    return rows.where(~outreach.rents_rooms(F.col("title"))).select("id")


def c9_good_records(spark, sf):
    return outreach.good_records(view(spark, sf, RECORDS), F.col("asked"), ("other.es",)).select("id")


def c10_signals(spark, sf):
    return outreach.filtered_signals(view(spark, sf, SIGNAL_FEED), kind="building_permit", zone="F", score_min=40).select("id", "signal_score")


def c10_options(spark, sf):
    return outreach.options(view(spark, sf, SIGNAL_FEED), ["signal_type", "zone", "source"])


def a16_sitemap(spark, sf):
    """Pages' urls as a sitemap, read again."""
    path = f"{shared_dir(spark)}/sitemap-{uuid4().hex}"
    table(spark, sf, "pages").select(F.col("url").alias("loc")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return html.sitemap_urls(spark, path)


def b39_phones_in_ads(spark, sf):
    return view(spark, sf, ADS).select("id", F.array_join(contact.phones_in_text(F.col("ad")), ",").alias("phones"))


def b45_emails_in_ads(spark, sf):
    return view(spark, sf, ADS).select("id", F.array_join(contact.emails_in_text(F.col("ad")), ",").alias("emails"))


def a19_flat_records(spark, sf):
    return outreach.flattened(view(spark, sf, NESTED))


def a17_state_items(spark, sf):
    return html.next_items(view(spark, sf, STATE_PAGES), "listID long, price double").select("page_id", "listID", "price")


def a17_gap_filled(spark, sf):
    rows = leads(spark, sf).select("id", "price", "area_m2", "agency_name")
    found = rows.select("id", F.lit(1.0).alias("price"), F.lit(2.0).alias("area_m2"), F.lit("found").alias("agency_name"))
    return html.gap_filled(rows, found, "id", ["price", "area_m2", "agency_name"])


def d10_staged_fill(spark, sf):
    rows = leads(spark, sf)
    by_name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), F.col("id").cast("string")))
    by_text = F.when(F.col("id") % 5 == 0, F.concat(F.lit("t"), F.col("id").cast("string")))
    return resolve.staged_fill(rows, [("text", by_text), ("name", by_name)])


def d10_stage_counts(spark, sf):
    return d10_staged_fill(spark, sf).groupBy(F.coalesce("stage", F.lit("none")).alias("stage")).agg(F.count("*").alias("n"))


def d19_activity(spark, sf):
    return outreach.activity(view(spark, sf, NOTES), leads(spark, sf))


def d21_searched_list(spark, sf):
    found = search.search(_index(spark, sf), all_of=["the", "of"])
    rows = lists.active(leads(spark, sf), score_min=30)
    return rows.join(found.select("id"), "id", "left_semi").select("id", "score")


def d24_company_contacts(spark, sf):
    return outreach.company_contacts(leads(spark, sf), view(spark, sf, COMPANIES))


def d25_backfilled(spark, sf):
    return outreach.backfilled(view(spark, sf, HALF_KNOWN))


def d25_backfill_counts(spark, sf):
    return outreach.backfill_counts(outreach.backfilled(view(spark, sf, HALF_KNOWN)))


def d25_contacts_from_text(spark, sf):
    return outreach.contacts_from_text(view(spark, sf, ADS), F.col("ad"))


def e14_funnel_window(spark, sf):
    return kpi.funnel(leads(spark, sf), STAGES, "1998-01-01 00:00:00")


def e19_daily_drops(spark, sf):
    return kpi.daily_drops(view(spark, sf, NOTES))


def e19_daily_sources(spark, sf):
    return kpi.daily_sources(leads(spark, sf))


def e20_tiers(spark, sf):
    return outreach.tiers(kpi.live(leads(spark, sf)))


def e24_motive_frequency(spark, sf):
    return kpi.motive_frequency(view(spark, sf, MOTIVE_ROWS).select(outreach.motives(F.col("description")).alias("tags")))


def e25_list_summary(spark, sf):
    return outreach.list_summary(kpi.live(leads(spark, sf)).where(kpi.has_phone()))


def g6_ranked(spark, sf):
    return outreach.ranked(kpi.live(leads(spark, sf)), [F.desc("score"), F.col("id")], 100).select("rank", "id")


def h1_by_score_with_phone(spark, sf):
    return outreach.by_score_with_phone(leads(spark, sf)).select("id", "score", "contact_phone")


def h6_hot_opportunities(spark, sf):
    return outreach.hot_opportunities(leads(spark, sf)).select("id", "score")


def h8_best_signals(spark, sf):
    return outreach.best_signals(view(spark, sf, SIGNAL_FEED)).select("id", "signal_score")


def h9_sweep_page(spark, sf):
    return outreach.sweep_page(leads(spark, sf), 200, 100).select("id")


def i3_imports(spark, sf):
    """Files with different columns as one table, the first row of each key kept."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return ingest.first_per_key(ingest.united([a, b]), "key", "id")


def a11_csv_sink(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    ingest.write_csv(leads(spark, sf).where("score >= 90").select("id", "zone", "contact_phone"), path, mask=["contact_phone"])
    return spark.read.csv(path, header=True, schema="id long, zone string, contact_phone string")


def a12_json_sink(spark, sf):
    path = f"{shared_dir(spark)}/json-{uuid4().hex}"
    rows = kpi.live(leads(spark, sf)).where("score >= 50").select("id", "score", F.array(F.struct(F.col("discovery_source").alias("source"), F.col("external_id").alias("url"))).alias("sources"))
    ingest.write_json(rows, path)
    back = spark.read.json(path, schema="id long, score int, sources array<struct<source:string,url:string>>")
    return back.select("id", "score", F.col("sources")[0]["source"].alias("source"), F.col("sources")[0]["url"].alias("url"))


def a13_sheets_sink(spark, sf):
    path = f"{shared_dir(spark)}/sheets-{uuid4().hex}"
    ingest.write_sheets(lists.deliverable(leads(spark, sf)), path)
    return spark.read.parquet(path).groupBy("sheet").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def c3_actionable(spark, sf):
    return ingest.actionable(view(spark, sf, THIN)).select("id")


def j7_drop_payload(spark, sf):
    drops = history.price_drops(view(spark, sf, PRICES), "2024-01-31 00:00:00")
    return outreach.drop_payload(drops.select("lead_id", F.col("peak_price").alias("old_price"), F.col("last_price").alias("new_price"))).select("lead_id", "drop_pct", "subject")


def j8_recomputed(spark, sf):
    return outreach.recomputed(leads(spark, sf))


def a15_permit_signals(spark, sf):
    return normalize.permit_signals(view(spark, sf, PERMITS.replace(" FROM orders", ", o_orderstatus AS zone FROM orders")), AS_OF, 400)


def i1_signal_counts(spark, sf):
    rows = view(spark, sf, SIGNAL_ROWS)
    old = rows.where("signal_type = 'other'").withColumn("fingerprint", normalize.fingerprint(F.col("signal_type"), F.col("zone"), F.col("signal_text")))
    return normalize.signal_counts([rows.where("source = 'cm'"), rows.where("source = 'ads'")], old)


def b47_known_agencies(spark, sf):
    rows = view(spark, sf, "SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'Engel & Völkers' WHEN 1 THEN 'Quintela + Penalva' WHEN 2 THEN 'Cushman' WHEN 3 THEN 'HabiSale' WHEN 4 THEN 'era uma casa' WHEN 5 THEN 'ERA Lisboa' WHEN 6 THEN 'Predimed Sul' WHEN 7 THEN 'VitalPrime' WHEN 8 THEN 'Coelho da Silva' WHEN 9 THEN '3C Imobiliária' WHEN 10 THEN NULL ELSE c_name END AS name FROM customer")
    return rows.select("id", normalize.agency_site(F.col("name")).alias("site"))


def c2_unscored(spark, sf):
    return outreach.unscored(leads(spark, sf)).select("id")


def c2_hot(spark, sf):
    return outreach.hot_leads(leads(spark, sf)).select("id", "score")


def e3_confidence_shares(spark, sf):
    return outreach.confidence_shares(leads(spark, sf))


def e8_owners_by_source(spark, sf):
    return outreach.active_owners(leads(spark, sf))


def e28_table_counts(spark, sf):
    return outreach.system_counts(leads(spark, sf), table(spark, sf, "events"), view(spark, sf, NOTES))


def j5_latest_notes(spark, sf):
    return lifecycle.latest_notes(view(spark, sf, NOTES)).select("lead_id", "place", "id")


def j9_bulk_move(spark, sf):
    rows = leads(spark, sf)
    return lifecycle.bulk_move(rows, rows.where("priority_flag"), "negociacao")


def n2_stream_drops(spark, sf):
    rows = _stream(spark, sf).select(F.col("user_id").alias("lead_id"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"))
    found = streams.drop_alerts(rows, "lead_id", "price", "ts", "10 days", "5 days", "1 hour", 0.5)
    return _drained(spark, found).select(F.col("start").cast("string").alias("start"), "lead_id", "n", "peak", "last")


def n2_drops_by_key(spark, sf):
    """Drops against the peak of ten days, from one state row per key."""
    rows = _stream(spark, sf).select(F.col("user_id").alias("lead_id"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("ts"))
    with streams.rocks_state(spark):
        found = _drained(spark, streams.drops_by_key(rows, "lead_id", "price", "ts", 10, "1 hour", 0.5))
    return found.select("lead_id", F.unix_micros("ts").alias("seen_at"), "price", "peak", "drop_pct")


def n3_stream_days(spark, sf):
    rows = _stream(spark, sf).select("value", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, streams.day_series(rows, "ts", "value", "1 hour")).select(F.col("day").cast("date").cast("string").alias("day"), "n")


def n4_stream_upserts(spark, sf):
    """The last value of every user, kept up by micro-batches."""
    rows = _stream(spark, sf).select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    base = f"{shared_dir(spark)}/upserts-{uuid4().hex}"
    return streams.upserted_table(rows, "user_id", F.struct("ts", "event_id"), base).select("user_id", "event_id", "value")


def n5_late_rows(spark, sf):
    """Rows counted per day by the stream, and how many came after the watermark."""
    rows = _stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"))
    return streams.counted_with_late(rows, "ts", "1 day", "0 seconds", f"{shared_dir(spark)}/late-{uuid4().hex}")


QUERIES = {f.__name__: f for f in (a15_permit_signals, b47_known_agencies, c2_hot, c2_unscored, e3_confidence_shares, e8_owners_by_source, e28_table_counts, i1_signal_counts, j5_latest_notes, j9_bulk_move, a16_sitemap, b39_phones_in_ads, b45_emails_in_ads, b8_first_url, b16_goods_price, b30_motives, b33_signal_type, b37_label_codes, c3_actionable, c4_client_zones, c7_without_rooms, c9_good_records, c10_signals, c10_options, a11_csv_sink, a12_json_sink, a13_sheets_sink, a19_flat_records, a17_state_items, a17_gap_filled, d10_staged_fill, d10_stage_counts, d19_activity, d21_searched_list, d24_company_contacts, d25_contacts_from_text, d25_backfilled, d25_backfill_counts, e14_funnel_window, e19_daily_drops, e19_daily_sources, e20_tiers, e24_motive_frequency, e25_list_summary, g6_ranked, h1_by_score_with_phone, h6_hot_opportunities, h8_best_signals, h9_sweep_page, i3_imports, j7_drop_payload, j8_recomputed, n2_stream_drops, n2_drops_by_key, n3_stream_days, n4_stream_upserts, n5_late_rows)}

_CASE = lambda values: " ".join(f"WHEN {k} THEN {v}" for k, v in values)
_LIVE = "NOT archived AND NOT is_demo"
_MOTIVE = "CASE id % 11 WHEN 0 THEN 'Heranca,Urgencia' WHEN 1 THEN 'Divorcio' WHEN 2 THEN 'Emigracao' WHEN 3 THEN 'Urgencia' WHEN 4 THEN 'Obras' WHEN 5 THEN 'Heranca,Partilhas' WHEN 6 THEN 'Mudanca' ELSE '' END"
_CONF = f"CASE WHEN {PHONE} OR coalesce(contact_whatsapp <> '', false) THEN 100 WHEN {EMAIL} THEN 70 WHEN coalesce(contact_website <> '', false) THEN 40 WHEN coalesce(contact_name <> '', false) THEN 30 ELSE 0 END"

_BACKFILLED = f"""a AS (SELECT *, CASE WHEN contact_whatsapp IS NULL THEN CASE WHEN description LIKE 'whatsapp%' THEN '+351961234567' WHEN title LIKE '%wa.me%' THEN '+351931112223' END END AS chat1, CASE WHEN contact_website IS NULL AND description LIKE '%www%' THEN 'casa-x.pt' END AS site1, contact_source IS NULL AS bare FROM ({HALF_KNOWN}) WHERE contact_source IS NULL OR contact_whatsapp IS NULL OR contact_website IS NULL),
b AS (SELECT *, CASE WHEN bare AND contact_phone IS NULL AND coalesce(contact_whatsapp, chat1) IS NULL THEN CASE WHEN description LIKE 'ligue%' THEN '+351912345678' WHEN title LIKE '%tel%' THEN '+351213456789' END END AS phone1 FROM a),
c AS (SELECT *, coalesce(contact_phone, phone1, contact_whatsapp, chat1) IS NOT NULL AS reached FROM b),
d AS (SELECT *, CASE WHEN bare AND NOT reached AND contact_email IS NULL AND description LIKE 'escreva%' THEN 'rui.x@casa.pt' END AS mail1 FROM c),
e AS (SELECT *, CASE WHEN bare THEN CASE WHEN reached THEN 100 WHEN coalesce(contact_email, mail1) IS NOT NULL THEN 70 WHEN coalesce(contact_website, site1) IS NOT NULL THEN 40 WHEN contact_name IS NOT NULL THEN 30 END END AS gained FROM d)"""

ORACLE_SQL = {
    "a15_permit_signals": f"SELECT id, sha256('building_permit|' || lower(o_orderstatus) || '|' || lower(subject))[:16] AS fingerprint, 'building_permit' AS signal_type, o_orderstatus AS zone, subject AS signal_text, 80 AS signal_score FROM ({PERMITS.replace(' FROM orders', ', o_orderstatus FROM orders')}) WHERE issued_at >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY AND regexp_matches(lower(subject), 'renova|remodel|obra|repair|alter') ORDER BY issued_at DESC, id LIMIT 100",
    "b47_known_agencies": "SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'engelvoelkers.com/pt-pt' WHEN 1 THEN 'knightfrank.pt' WHEN 2 THEN 'cushmanwakefield.com' WHEN 3 THEN 'habisale.pt' WHEN 5 THEN 'era.pt' WHEN 6 THEN 'predimed.pt' WHEN 7 THEN 'vitalprime.pt' WHEN 8 THEN 'coelhodasilva.pt' WHEN 9 THEN '3cimobiliaria.pt' END AS site FROM customer",
    "c2_hot": with_leads("SELECT id, score FROM live WHERE score >= 60"),
    "c2_unscored": with_leads("SELECT id FROM leads WHERE NOT archived AND score IS NULL"),
    "e3_confidence_shares": with_leads("SELECT score_label, confidence, n, round(n * 100.0 / sum(n) OVER (PARTITION BY score_label), 1)::DOUBLE AS share FROM (SELECT score_label, coalesce(contact_confidence, 0) AS confidence, count(*) AS n FROM live GROUP BY 1, 2)"),
    "e8_owners_by_source": with_leads(f"SELECT discovery_source, count(*) AS n, count(*) FILTER (WHERE {PHONE}) AS with_phone, round(avg(score), 1) AS avg_score FROM live WHERE lead_type = 'active_owner' GROUP BY 1"),
    "e28_table_counts": with_leads(f"SELECT count(*) AS leads, count(*) FILTER (WHERE is_demo) AS demo, count(*) FILTER (WHERE archived) AS archived, count(*) FILTER (WHERE {PHONE}) AS with_phone, (SELECT count(*) FROM events) AS raw, (SELECT count(*) FROM notes) AS notes FROM leads"),
    "i1_signal_counts": f"WITH s AS (SELECT *, concat_ws('|', signal_type, lower(zone), signal_text) AS fp FROM ({SIGNAL_ROWS})), f AS (SELECT fp, arg_min(source, id) AS source FROM s GROUP BY 1 HAVING NOT bool_or(signal_type = 'other')) SELECT source, n, coalesce(m, 0) AS \"new\", n - coalesce(m, 0) AS skipped FROM (SELECT source, count(*) AS n FROM s GROUP BY 1) LEFT JOIN (SELECT source, count(*) AS m FROM f GROUP BY 1) USING (source)",
    "j5_latest_notes": with_leads("SELECT lead_id, place::INT AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) AS place FROM notes) WHERE place <= 3"),
    "j9_bulk_move": with_leads("SELECT id, CASE WHEN crm_stage = 'contactado' THEN 'negociacao' ELSE crm_stage END AS stage, crm_stage = 'contactado' AS moved FROM leads WHERE priority_flag"),
    "a16_sitemap": "SELECT trim(url) AS url FROM pages WHERE trim(url) <> ''",
    "b39_phones_in_ads": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '+35191' || lpad((o_custkey % 9000000 + 1234567)::VARCHAR, 7, '4') ELSE '' END AS phones FROM orders",
    "b45_emails_in_ads": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'ana' || o_custkey || '@casa.pt' ELSE '' END AS emails FROM orders",
    "b8_first_url": "SELECT l_orderkey AS id, coalesce(arg_min('u' || l_partkey, (l_linenumber, 'u' || l_partkey)) FILTER (WHERE l_partkey % 3 <> 0), '') AS url FROM lineitem GROUP BY 1",
    "b16_goods_price": "SELECT id, CASE WHEN v > 0 AND v < 50000 THEN v END AS goods, CASE WHEN v >= 15000 AND v < 500000 THEN v END AS vehicle FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_partkey WHEN 1 THEN (p_partkey % 900) * 1000 + 500 WHEN 3 THEN (p_partkey % 90) * 1000 + 250.5 END::DOUBLE AS v FROM part)",
    "b30_motives": f"SELECT id, {_MOTIVE} AS motives FROM (SELECT o_orderkey AS id FROM orders)",
    "b33_signal_type": "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'city_change' WHEN 1 THEN 'job_change' WHEN 2 THEN 'city_change' WHEN 3 THEN 'job_change' END AS signal_type, CASE WHEN c_custkey % 5 < 3 THEN c_name END AS name, CASE c_custkey % 5 WHEN 0 THEN 'Engineer' WHEN 1 THEN 'Chef' WHEN 2 THEN 'Painter' WHEN 4 THEN 'Cook' END AS role, CASE c_custkey % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Blue' END AS company FROM customer",
    "b37_label_codes": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fsbo' WHEN '2-HIGH' THEN 'frbo' WHEN '3-MEDIUM' THEN 'agency_listing' ELSE 'unknown' END AS lead_type FROM orders",
    "c3_actionable": f"SELECT id FROM ({THIN}) WHERE contact_phone <> '' OR contact_email <> '' OR title <> '' OR zone <> '' OR address <> ''",
    "c4_client_zones": with_leads(f"SELECT id, zone FROM leads WHERE (zone IN ('NATION_1', 'NATION_7') OR zone LIKE 'NATION\\_2%' ESCAPE '\\') AND {PHONE} AND owner_type NOT IN ('agency', 'bank', 'developer', 'auction')"),
    "c7_without_rooms": "SELECT p_partkey AS id FROM part WHERE p_partkey % 6 IN (3, 4, 5)",
    "c9_good_records": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 NOT IN (0, 1) AND o_orderkey % 7 NOT IN (0, 1) AND o_orderkey % 4 NOT IN (0, 1) AND o_orderkey % 6 <> 3",
    "c10_signals": f"SELECT id, signal_score FROM ({SIGNAL_FEED}) WHERE signal_type = 'building_permit' AND zone = 'F' AND signal_score >= 40",
    "c10_options": f"WITH s AS ({SIGNAL_FEED}) SELECT 'signal_type' AS field, signal_type AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'zone', zone, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY 2",
    "a11_csv_sink": with_leads("SELECT id, zone, sha256(contact_phone) AS contact_phone FROM leads WHERE score >= 90"),
    "a12_json_sink": with_leads("SELECT id, score, discovery_source AS source, external_id AS url FROM live WHERE score >= 50"),
    "a13_sheets_sink": with_leads(f"SELECT sheet, count(*) AS n, max(score) AS best FROM (SELECT unnest(['owners', 'agencies', 'reachable', 'hot']) AS sheet, * FROM live) WHERE CASE sheet WHEN 'owners' THEN owner_type = 'fsbo' WHEN 'agencies' THEN owner_type = 'agency' WHEN 'hot' THEN score_label = 'HOT' ELSE {PHONE} OR {EMAIL} OR contact_whatsapp <> '' OR contact_website <> '' END GROUP BY 1"),
    "a19_flat_records": "SELECT p_partkey AS id, 'Casa ' || p_brand AS title, p_partkey::VARCHAR AS external_id, p_size::DOUBLE AS price, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Algés, ' END || CASE WHEN p_partkey % 2 = 0 THEN 'Oeiras, ' ELSE '' END || 'Lisboa' AS location, CASE WHEN p_partkey % 3 = 0 THEN 'agency' ELSE 'fsbo' END AS owner_type, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS agency_name FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 7 <> 0",
    "a17_state_items": "SELECT p_partkey AS page_id, p_partkey AS \"listID\", p_size::DOUBLE AS price FROM part UNION ALL SELECT p_partkey, p_partkey + 1000000, 1.0 FROM part",
    "a17_gap_filled": with_leads("SELECT id, coalesce(price, 1.0) AS price, coalesce(area_m2, 2.0) AS area_m2, coalesce(agency_name, 'found') AS agency_name FROM leads"),
    "d10_staged_fill": with_leads(f"SELECT id, CASE WHEN id % 5 = 0 THEN 't' || id WHEN id % 3 = 0 THEN 'n' || id END AS phone, CASE WHEN id % 5 = 0 THEN 'text' WHEN id % 3 = 0 THEN 'name' END AS stage FROM leads WHERE NOT {PHONE}"),
    "d10_stage_counts": with_leads(f"SELECT CASE WHEN id % 5 = 0 THEN 'text' WHEN id % 3 = 0 THEN 'name' ELSE 'none' END AS stage, count(*) AS n FROM leads WHERE NOT {PHONE} GROUP BY 1"),
    "d19_activity": with_leads("SELECT n.id, lead_id, note_type, zone, score FROM notes n JOIN leads l ON l.id = lead_id"),
    "d21_searched_list": with_leads("SELECT id, score FROM leads WHERE NOT archived AND score >= 30 AND id IN (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])of([^\\p{L}\\p{N}_]|$)'))"),
    "d24_company_contacts": with_leads(f"""SELECT id, CASE WHEN gp THEN phone ELSE contact_phone END AS contact_phone, CASE WHEN ge THEN email ELSE contact_email END AS contact_email, CASE WHEN gw THEN domain ELSE contact_website END AS contact_website, 'website:' || domain AS contact_source, CASE WHEN gp THEN 100 WHEN ge THEN 70 ELSE 40 END AS contact_confidence
  FROM (SELECT l.*, c.phone, c.email, c.domain, c.phone IS NOT NULL AND coalesce(l.contact_phone, '') = '' AS gp, c.email IS NOT NULL AND coalesce(l.contact_email, '') = '' AS ge, coalesce(l.contact_website, '') = '' AS gw FROM live l JOIN ({COMPANIES}) c ON l.agency_name = c.agency_name) WHERE gp OR ge OR gw"""),
    "e14_funnel_window": with_leads(f"""SELECT place, stage, coalesce(n, 0) AS n, coalesce(round(coalesce(n, 0) * 100.0 / nullif(max(CASE WHEN place = 0 THEN coalesce(n, 0) END) OVER (), 0), 1), 0)::DOUBLE AS pct FROM (SELECT unnest(range({len(STAGES)}))::INT AS place, unnest({list(STAGES)}) AS stage) LEFT JOIN (SELECT crm_stage AS stage, count(*) AS n FROM live WHERE first_seen_at >= TIMESTAMP '1998-01-01' GROUP BY 1) USING (stage)"""),
    "e19_daily_drops": with_leads("SELECT created_at::DATE::VARCHAR AS day, count(*) AS drops FROM notes WHERE note_type = 'price_drop' GROUP BY 1"),
    "e19_daily_sources": with_leads("SELECT day, discovery_source, n, round(n * 100.0 / sum(n) OVER (PARTITION BY day), 1)::DOUBLE AS share FROM (SELECT first_seen_at::DATE::VARCHAR AS day, discovery_source, count(*) AS n FROM live GROUP BY 1, 2)"),
    "e20_tiers": with_leads("SELECT count(*) FILTER (WHERE contact_confidence >= 70) AS high, count(*) FILTER (WHERE contact_confidence = 30) AS named, count(*) FILTER (WHERE contact_confidence = 0) AS \"none\", count(*) FILTER (WHERE contact_source <> '' AND NOT regexp_matches(contact_source, '^(website|cross_portal):')) AS direct, count(*) FILTER (WHERE contact_source LIKE 'website:%') AS website, count(*) FILTER (WHERE contact_source LIKE 'cross_portal:%') AS crossed, count(*) FILTER (WHERE lead_type = 'fsbo') AS fsbo, count(*) FILTER (WHERE lead_type = 'frbo') AS frbo, count(*) FILTER (WHERE lead_type = 'agency_listing') AS agency FROM live"),
    "e24_motive_frequency": f"SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(m, ',')) AS tag FROM (SELECT {_MOTIVE} AS m FROM (SELECT o_orderkey AS id FROM orders)) WHERE m <> '') GROUP BY 1 ORDER BY n DESC, tag LIMIT 8",
    "e25_list_summary": with_leads(f"SELECT count(*) AS total, count(*) FILTER (WHERE score_label = 'HOT') AS hot, count(*) FILTER (WHERE score_label = 'WARM') AS warm, count(*) FILTER (WHERE score_label = 'COLD') AS cold, count(*) FILTER (WHERE owner_type <> 'agency') AS owners, count(*) FILTER (WHERE owner_type = 'agency') AS agencies, count(DISTINCT zone) AS zones, count(DISTINCT discovery_source) AS sources FROM live WHERE {PHONE}"),
    "g6_ranked": with_leads("SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, id)::INT AS rank, id FROM live ORDER BY score DESC NULLS LAST, id LIMIT 100"),
    "h1_by_score_with_phone": with_leads(f"SELECT id, score, contact_phone FROM leads WHERE {PHONE} AND score IS NOT NULL ORDER BY score DESC, id LIMIT 20"),
    "h6_hot_opportunities": with_leads("SELECT id, score FROM live WHERE score_label = 'HOT' ORDER BY score DESC, last_seen_at DESC, id LIMIT 10"),
    "h8_best_signals": f"SELECT id, signal_score FROM ({SIGNAL_FEED}) ORDER BY signal_score DESC, created_at DESC, id LIMIT 50",
    "h9_sweep_page": with_leads("SELECT id FROM live ORDER BY last_seen_at, id LIMIT 200 OFFSET 100"),
    "i3_imports": "SELECT id, key, name, balance FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS place FROM (SELECT c_custkey AS id, c_nationkey AS key, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey + 10000000, s_nationkey, NULL, s_acctbal FROM supplier)) WHERE place = 1",
    "j7_drop_payload": with_leads("""SELECT lead_id, round(abs((last - peak) / peak * 100), 1) AS drop_pct, '-' || printf('%.1f', round(abs((last - peak) / peak * 100), 1)) || '%' AS subject FROM (SELECT lead_id, count(*) AS n, max(price) AS peak, arg_max(price, (recorded_at, price)) AS last, max(recorded_at) AS last_at FROM prices WHERE recorded_at >= TIMESTAMP '2024-01-01' GROUP BY 1) WHERE n >= 2 AND (peak - last) / peak >= 0.05 AND last_at >= TIMESTAMP '2024-01-17'"""),
    "j8_recomputed": with_leads(f"SELECT id, {_CONF} AS contact_confidence, CASE WHEN ({PHONE} OR coalesce(contact_whatsapp <> '', false)) AND lead_type IN ('fsbo', 'frbo') THEN 'high' WHEN {EMAIL} OR coalesce(contact_website <> '', false) OR lead_type IN ('fsbo', 'frbo') THEN 'medium' ELSE 'low' END AS lead_quality FROM leads"),
    "d25_backfilled": f"WITH {_BACKFILLED} SELECT id, coalesce(phone1, contact_phone) AS contact_phone, coalesce(mail1, contact_email) AS contact_email, coalesce(contact_whatsapp, chat1) AS contact_whatsapp, coalesce(contact_website, site1) AS contact_website, coalesce(contact_source, CASE WHEN gained IS NOT NULL THEN coalesce(nullif(discovery_source, ''), 'listagem') END) AS contact_source, coalesce(gained, contact_confidence) AS contact_confidence, gained IS NOT NULL AS new_source, chat1 IS NOT NULL AS new_whatsapp, site1 IS NOT NULL AS new_website FROM e",
    "d25_backfill_counts": f"WITH {_BACKFILLED} SELECT count(*) AS checked, count(gained) AS sources, count(chat1) AS whatsapps, count(site1) AS websites, count(*) FILTER (WHERE gained IS NULL AND chat1 IS NULL AND site1 IS NULL) AS skipped FROM e",
    "n2_drops_by_key": "SELECT lead_id, seen_at, price, peak, round((peak - price) / peak, 4) AS drop_pct FROM (SELECT user_id AS lead_id, epoch_us(ts) AS seen_at, ts, value AS price, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW) AS peak FROM events) WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AND (peak - price) / peak >= 0.5",
    "n2_stream_drops": "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, lead_id, n, peak, last FROM (SELECT start, user_id AS lead_id, count(*) AS n, max(value) AS peak, arg_max(value, (ts, value)) AS last FROM (SELECT *, unnest([s, s - INTERVAL 5 DAY]) AS start FROM (SELECT *, time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM events)) GROUP BY 1, 2) WHERE n >= 2 AND (peak - last) / peak >= 0.5 AND start + INTERVAL 10 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "n3_stream_days": "SELECT strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "n5_late_rows": "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, 0::BIGINT AS late FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)",
    "n4_stream_upserts": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1",
}
