"""Normalisation, signals, relaxed matching and further counts (A-15, B-11, B-47..B-51, C, D-9, E, I, J), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import kpi, lists, normalize
from leadloom.plans.kpi_queries import ANY, N, PHONE, pct
from leadloom.plans.text_queries import FRAGMENTS, raw, with_raw
from leadloom.plans.views import AS_OF, leads, table, view, with_leads

SIGNAL_ROWS = "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'cm' ELSE 'ads' END AS source, CASE s_suppkey % 4 WHEN 0 THEN 'building_permit' WHEN 1 THEN 'renovation_ad' ELSE 'other' END AS signal_type, n_name AS zone, concat('text ', CAST(s_suppkey % 7 AS STRING)) AS signal_text FROM supplier JOIN nation ON s_nationkey = n_nationkey"
PERMITS = "SELECT o_orderkey AS id, o_orderdate AS issued_at, CASE o_orderkey % 4 WHEN 0 THEN 'Obras de remodelacao' WHEN 1 THEN 'Licenca de esplanada' WHEN 2 THEN 'House alteration' ELSE 'Piscina' END AS subject FROM orders"
CONFIG = {
    "alpha": {"title": ("title",), "description": ("description",), "price_raw": ("price_raw",), "area_raw": ("area_raw",), "location": ("location",), "url": ("url",), "phone_raw": ("phone_raw",), "contact_name": ("p_name",)},
    "beta": {"title": ("p_name", "title"), "description": ("description",), "price_raw": ("price_raw",), "location": ("location",), "phone_raw": ("bool_raw", "phone_raw")},
}


def b49_normalize_sources(spark, sf):
    rows = raw(spark, sf)
    found = normalize.normalize_sources({"alpha": rows.where("id % 2 = 0"), "beta": rows.where("id % 2 = 1")}, CONFIG, zones=FRAGMENTS, owner_sources=("alpha",), residential_only=("alpha",))
    return found.select("id", "source", "title", "price", "area_m2", "typology", "zone", "owner_type", "phone_type")


def b47_agency_site(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Remax Vantagem", "era uma vez", "Grupo ERA", "Century 21 X", "Casa Boa Lda", "Keller Williams"))), (F.col("id") % 6 + 1).cast("int")), F.lit(" "), F.col("id").cast("string"))
    rows = raw(spark, sf).withColumn("agency", name)
    return rows.select("id", normalize.agency_site(F.col("agency")).alias("site"), F.array_join(normalize.candidate_sites(F.col("agency")), ",").alias("candidates"))


def b51_message(spark, sf):
    return leads(spark, sf).select("id", normalize.message(F.lit("Ana"), F.col("typology"), F.col("zone"), F.col("price"), F.col("owner_type")).alias("message"))


def i2_new_signals(spark, sf):
    rows = view(spark, sf, SIGNAL_ROWS)
    old = rows.where("id % 10 = 0").withColumn("fingerprint", normalize.fingerprint(F.col("signal_type"), F.col("zone"), F.col("signal_text")))
    return normalize.new_signals([rows.where("source = 'cm'"), rows.where("source = 'ads'")], old)


def a15_permits(spark, sf):
    return normalize.permits(view(spark, sf, PERMITS), AS_OF, 400).select("id", "subject")


def d9_relaxed_match(spark, sf):
    rows = leads(spark, sf).where("NOT archived AND NOT is_demo")
    base = rows.select("id", F.lower("zone").alias("zone_n"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("typology")).alias("kind"), "price", "title", F.lower("title").alias("title_n"), F.col("contact_phone").alias("phone"))
    return normalize.relaxed_match(base.where("phone IS NULL"), base.where("phone IS NOT NULL"))


def c6_row_filters(spark, sf):
    rows = lists.active(leads(spark, sf)).where(kpi.mobile() & (F.col("price_changes") > 0) & ~F.col("title").rlike("(?i)loja"))
    return rows.select("id", "lead_type")


def e23_executive_summary(spark, sf):
    rows = leads(spark, sf)
    return kpi.executive_summary(kpi.live(rows).where("score >= 70"), kpi.live(rows).where("score < 70"))


def e28_system_counts(spark, sf):
    return leads(spark, sf).agg(F.count("*").alias("leads"), kpi.count_if(F.col("is_demo"), "demo"), kpi.count_if(F.col("archived"), "archived"), kpi.count_if(kpi.has_phone(), "with_phone"), F.count_distinct("zone").alias("zones"), F.count_distinct("discovery_source").alias("sources"))


def j5_stage_counts(spark, sf):
    rows = kpi.live(leads(spark, sf))
    return rows.groupBy("crm_stage").agg(F.count("*").alias("n"), kpi.rate(F.count_if(kpi.any_contact()), F.count("*"), "reachable"), F.max("score").alias("best"))


def h7_top_zones(spark, sf):
    return kpi.by_group(leads(spark, sf), "zone").where("total >= 3").orderBy(F.desc("avg_score"), "name").limit(15).select("name", "total", "avg_score")


def a10_first_per_key(spark, sf):
    from leadloom.operators.resolve import dedup_by_key

    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return dedup_by_key(docs, "key", [F.col("doc_id")]).select("doc_id", "source")


QUERIES = {f.__name__: f for f in (a10_first_per_key, a15_permits, b47_agency_site, b49_normalize_sources, b51_message, c6_row_filters, d9_relaxed_match, e23_executive_summary, e28_system_counts, h7_top_zones, i2_new_signals, j5_stage_counts)}

_SIGNAL_KEY = "sha256(concat_ws('|', signal_type, lower(zone), signal_text))[:16]"
_RELAXED = """SELECT t.id, d.id AS donor_id, d.phone, (1 - levenshtein(t.title_n, d.title_n) / greatest(length(t.title_n), length(d.title_n))::DOUBLE + CASE WHEN t.price > 0 AND d.price > 0 THEN CASE WHEN g <= 0.02 THEN 1.0 WHEN g <= 0.10 THEN 0.6 WHEN g <= 0.20 THEN 0.25 ELSE 0.0 END::DOUBLE * 1.5 WHEN coalesce(t.price > 0, false) <> coalesce(d.price > 0, false) THEN 0.1 ELSE 0.0 END)
  / (1.0 + CASE WHEN t.price > 0 AND d.price > 0 THEN 1.5 WHEN coalesce(t.price > 0, false) <> coalesce(d.price > 0, false) THEN 0.5 ELSE 0.0 END)::DOUBLE AS score, coalesce(t.price > 0 AND d.price > 0, false) AS priced
  FROM b t JOIN b d ON t.zone_n = d.zone_n AND (t.kind = d.kind OR d.kind = '') AND t.id <> d.id, LATERAL (SELECT abs(t.price - d.price) / greatest(t.price, d.price) AS g) WHERE t.phone IS NULL AND d.phone IS NOT NULL"""

ORACLE_SQL = {
    "a10_first_per_key": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents) WHERE place = 1",
    "a15_permits": f"SELECT id, subject FROM ({PERMITS}) WHERE issued_at >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY AND regexp_matches(lower(subject), 'renova|remodel|obra|repair|alter') ORDER BY issued_at DESC, id LIMIT 100",
    "b47_agency_site": with_raw("SELECT id, CASE id % 6 WHEN 0 THEN 'remax.pt' WHEN 2 THEN 'era.pt' WHEN 3 THEN 'century21.pt' WHEN 5 THEN 'kwportugal.pt' END AS site, array_to_string(list_distinct_ordered, ',') AS candidates FROM (SELECT id, CASE WHEN contains(core, '-') THEN [replace(core, '-', '') || '.pt', core || '.pt', replace(core, '-', '') || '.com'] ELSE [core || '.pt', core || '.com'] END AS list_distinct_ordered FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'remax-vantagem-' WHEN 1 THEN 'era-uma-vez-' WHEN 2 THEN 'era-' WHEN 3 THEN 'century-21-x-' WHEN 4 THEN 'casa-boa-' ELSE 'keller-williams-' END || id AS core FROM raw))"),
    "b51_message": with_leads("SELECT id, 'Bom dia Ana, vi o seu anuncio ' || typology || ' em ' || zone || CASE WHEN price > 0 THEN ', por ' || floor(price)::BIGINT || ' EUR' ELSE '' END || '. ' || CASE WHEN owner_type = 'agency' THEN 'Podemos falar do imovel?' ELSE 'Podemos falar diretamente?' END AS message FROM leads"),
    "c6_row_filters": with_leads("SELECT id, lead_type FROM leads WHERE NOT archived AND contact_phone LIKE '+3519%' AND price_changes > 0 AND NOT contains(lower(title), 'loja')"),
    "d9_relaxed_match": with_leads("").rstrip() + f", b AS (SELECT id, lower(zone) AS zone_n, CASE WHEN id % 3 = 0 THEN '' ELSE typology END AS kind, price, lower(title) AS title_n, contact_phone AS phone FROM live) SELECT id, donor_id, round(score, 6) AS score, phone FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, donor_id) AS place FROM ({_RELAXED}) WHERE score >= CASE WHEN priced THEN 0.60 ELSE 0.65 END) WHERE place = 1",
    "e23_executive_summary": with_leads(f"SELECT CASE WHEN score >= 70 THEN 'premium' ELSE 'expanded' END AS list, count(*) AS n, {N} (WHERE score_label = 'HOT') AS hot, {N} (WHERE score_label = 'WARM') AS warm, min(score) AS min_score, round(avg(score), 1) AS avg_score, max(score) AS max_score, {N} (WHERE phone_type = 'mobile') AS mobile FROM live WHERE score IS NOT NULL GROUP BY 1"),
    "e28_system_counts": with_leads(f"SELECT count(*) AS leads, {N} (WHERE is_demo) AS demo, {N} (WHERE archived) AS archived, {N} (WHERE {PHONE}) AS with_phone, count(DISTINCT zone) AS zones, count(DISTINCT discovery_source) AS sources FROM leads"),
    "h7_top_zones": with_leads("SELECT zone AS name, count(*) AS total, round(avg(score), 1) AS avg_score FROM live GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg_score DESC, name LIMIT 15"),
    "i2_new_signals": f"WITH s AS (SELECT *, {_SIGNAL_KEY} AS fingerprint FROM ({SIGNAL_ROWS})) SELECT fingerprint, min(id) AS id, arg_min(source, id) AS source, any_value(signal_type) AS signal_type, any_value(zone) AS zone, CASE any_value(signal_type) WHEN 'building_permit' THEN 80 WHEN 'renovation_ad' THEN 60 ELSE 50 END AS signal_score FROM s WHERE fingerprint NOT IN (SELECT fingerprint FROM s WHERE id % 10 = 0) GROUP BY 1",
    "j5_stage_counts": with_leads(f"SELECT crm_stage, count(*) AS n, {pct(f'{N} (WHERE {ANY})', 'count(*)')} AS reachable, max(score) AS best FROM live GROUP BY 1"),
}
