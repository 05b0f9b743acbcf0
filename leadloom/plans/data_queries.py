"""Ingest, entity resolution, search, learning and streaming queries (A, D, K, L, N), with their oracles."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from leadloom.functions.text import norm_text
from leadloom.operators import learn, resolve, search
from leadloom.plans.kpi_queries import EMAIL, PHONE
from leadloom.plans.views import leads, shared_dir, table, view, with_leads
from leadloom.sources import ingest
from leadloom.streaming import streams

LANDED = "SELECT event_id AS id, event_type AS source, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 700 AS STRING) END AS external_id, ts AS scraped_at, CAST(user_id % 9 AS STRING) AS batch_id FROM events"
OLD, NEW = "CAST(scraped_at AS DATE) < DATE '2024-01-10'", "CAST(scraped_at AS DATE) >= DATE '2024-01-10'"
#: Half of the customers as one portal, half as another; places and typologies from keys.
SELLERS = """SELECT c_custkey AS id, concat('Name ', CAST(c_custkey % 200 AS STRING)) AS name, n_name AS zone, CASE WHEN c_custkey % 3 = 0 THEN concat('+35191', lpad(CAST(c_custkey AS STRING), 7, '4')) END AS phone FROM customer JOIN nation ON c_nationkey = n_nationkey"""
IMPORTS = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN concat('+35191', lpad(CAST(s_suppkey * 5 + 1 AS STRING), 7, '4')) END AS contact_phone, CASE WHEN s_suppkey % 3 = 0 THEN concat('c', CAST(s_suppkey * 3 AS STRING), '@mail.pt') END AS contact_email,
  n_name AS zone, CASE s_suppkey % 3 WHEN 0 THEN 'T2' WHEN 1 THEN 'T1' ELSE 'Moradia' END AS typology, 1000.0 * (50 + s_suppkey) AS price FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
CODES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, xor(CAST((o_custkey % 400) * 4611686018427 + (o_custkey % 400) * 97 AS BIGINT), CAST((o_orderkey % 5) * (o_orderkey % 3) * 2251799813685248 + o_orderkey % 4 AS BIGINT)) AS code FROM orders"""
CODES_SPARK = CODES.replace("xor(CAST((o_custkey % 400) * 4611686018427 + (o_custkey % 400) * 97 AS BIGINT), ", "(CAST((o_custkey % 400) * 4611686018427 + (o_custkey % 400) * 97 AS BIGINT) ^ ").replace(" + o_orderkey % 4 AS BIGINT))", " + o_orderkey % 4 AS BIGINT))")
BATCH = """SELECT o_orderkey AS id, concat('fp', CAST(o_custkey % 900 AS STRING)) AS fp, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 0 THEN concat('+35191', lpad(CAST(o_orderkey AS STRING), 7, '4')) END AS contact_phone,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('m', CAST(o_orderkey AS STRING), '@mail.pt') END AS contact_email, concat('text ', lpad('', CAST(o_orderkey % 17 AS INT), 'x')) AS description, o_orderdate AS scraped_at FROM orders"""


def _landed(spark, sf):
    return view(spark, sf, LANDED)


def a2_delta_ingest(spark, sf):
    rows = _landed(spark, sf)
    return ingest.unseen(rows.where(NEW), rows.where(OLD))


def a3_queue(spark, sf):
    rows = _landed(spark, sf)
    return ingest.queue(rows, rows.where("id % 3 = 0"), "click", 500).select("id", "external_id")


def a4_known_ids(spark, sf):
    return ingest.known_ids(_landed(spark, sf))


def a4_landed_today(spark, sf):
    return ingest.landed_today(_landed(spark, sf), "2024-01-28 12:00:00")


def a5_novelty(spark, sf):
    rows = _landed(spark, sf)
    return ingest.novelty(rows.where(NEW), rows.where(OLD), 0.6)


def a14_upsert(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).alias("version"))
    return ingest.upserted(orders, new, "o_orderkey", F.col("version"))


def d1_listing_key(spark, sf):
    rows = leads(spark, sf)
    return rows.select("id", resolve.listing_key(F.col("title"), F.col("typology"), F.col("zone"), F.col("price"), F.col("area_m2")).alias("fingerprint"))


def d2_upsert_merge(spark, sf):
    rows = view(spark, sf, BATCH)
    first = rows.where("id % 3 = 0")
    start = resolve.fold_batch(first).withColumn("price_changes", F.lit(0))
    return resolve.upsert(start, rows.where("id % 3 <> 0")).select("fp", "price", "price_changes", "contact_phone", "contact_email", F.length("description").alias("text_chars"), "is_new")


def d3_merged_sources(spark, sf):
    seen = leads(spark, sf).select(F.col("contact_name").alias("fp"), F.col("discovery_source").alias("source"), F.col("external_id").alias("url"), F.col("first_seen_at").alias("seen_at"))
    found = resolve.merged_sources(seen)
    return found.select("fp", "n_sources", F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit("@"), s["url"])), ",").alias("sources"))


def d4_fuzzy_match(spark, sf):
    """With the edit-distance ratio, which SQL has too."""
    return resolve.fuzzy_match(leads(spark, sf), exact_ratio=False)


def d4_fuzzy_match_exact_ratio(spark, sf):
    return resolve.fuzzy_match(leads(spark, sf))


def d6_filled_from_donors(spark, sf):
    rows = leads(spark, sf)
    return resolve.filled_from_donors(rows, resolve.fuzzy_match(rows, exact_ratio=False, counted=False).select("id", "donor_id"))


def d8_name_propagation(spark, sf):
    return resolve.propagate_by_name(view(spark, sf, SELLERS), "name", "zone")


def d11_find_existing(spark, sf):
    return resolve.find_existing(view(spark, sf, IMPORTS), leads(spark, sf))


def d16_near_codes(spark, sf):
    """Pairs of classes of equal codes; d16_code_classes has their members."""
    return resolve.near_codes(view(spark, sf, CODES_SPARK))


def d16_code_classes(spark, sf):
    return resolve.code_classes(view(spark, sf, CODES_SPARK))


def d17_merge_clusters(spark, sf):
    """Leads with a telephone or e-mail in common are one."""
    rows = leads(spark, sf)
    shared_dir(spark)
    pairs = resolve.same_contact(rows, ["contact_phone", "contact_email"])
    return resolve.merge_clusters(rows, resolve.clusters(pairs)).select("cluster", "canonical_id", "contact_phone", "score", "members", F.array_join("sources", ",").alias("sources"))


def d22_geo_resolved(spark, sf):
    rows = leads(spark, sf).select("id", F.col("title").alias("address"), "zone")
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("zone"), "n_nationkey")
    cache = rows.where("id % 5 = 0").select(F.sha2(F.concat_ws("|", norm_text(F.col("address")), norm_text(F.col("zone"))), 256).alias("cache_key")).distinct().select("cache_key", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    return resolve.geo_resolved(rows, cache, nations.where("n_nationkey % 2 = 0").select("zone", (F.col("n_nationkey") * 1.0).alias("lat"), F.lit(0.5).alias("lon")))


#: Where the index of a folder's documents lies, by application and by the files with their times and sizes.
_BUILT: dict[tuple, str] = {}


def _stamp(spark, path: str) -> tuple:
    """The files at a path with their times and sizes: other documents have another stamp."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((str(f.getPath()), f.getModificationTime(), f.getLen()) for f in found))


def _stored_index(spark, sf):
    """Built once for an application and the documents as they are now."""
    key = (spark.sparkContext.applicationId, _stamp(spark, f"{sf}/documents.parquet"))
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/postings-{uuid4().hex}"
        search.Index.build(table(spark, sf, "documents"), path, "doc_id", "text")
        _BUILT[key] = path
    return search.Index(spark, _BUILT[key])


def _index(spark, sf):
    return _stored_index(spark, sf).postings


def k1_search(spark, sf):
    return search.search(_index(spark, sf), all_of=["the", "of", "tion"], none_of=["license"], prefix_last=True)


def k1_phrase_near(spark, sf):
    return search.search(_index(spark, sf), phrases=[["of", "the"]], near=[("and", "to", 3)], any_of=["in", "de"])


def k1_bm25(spark, sf):
    stored = _stored_index(spark, sf)
    words = ["license", "copyright", "under"]
    found = search.ranked(stored.postings, search.search(stored.postings, any_of=words), words, 100, stored.lengths)
    return found.select("id", F.round("score", 6).alias("score"))


def k3_contains(spark, sf):
    return search.contains_any(leads(spark, sf), "Urgente", ["title", "description", "zone"]).select("id")


def k4_similar_items(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), "p_name", "p_brand", "p_type")
    blob = F.lower(F.concat_ws(" ", "p_type", "p_type", "p_brand", "p_name"))
    shared_dir(spark)
    weights = search.tfidf(rows, "id", blob).checkpoint()
    return search.similar(weights, rows, rows.where("id % 20 = 0").select("id"), top=5)


def _labelled(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return table(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "text", "label")


def _outcomes(spark, sf):
    rows = _labelled(spark, sf)
    model = learn.train(learn.training_rows(rows), "doc_id", f"{shared_dir(spark)}/classifier-{uuid4().hex}", least=30)
    return learn.relabelled(rows.select("doc_id", "label", (F.col("doc_id") % 10 == 0).alias("locked")), learn.scored(model, rows, "doc_id"), "doc_id")


def l2_text_classifier(spark, sf):
    return _outcomes(spark, sf)


def l2_cross_validation(spark, sf):
    return learn.cross_validated(learn.training_rows(_labelled(spark, sf)), "doc_id", f"{shared_dir(spark)}/folds-{uuid4().hex}", 3, least=20)


def l3_rules_without_model(spark, sf):
    rows = leads(spark, sf).withColumn("text", F.concat_ws(" ", "title", "description", F.lit("para"), "contact_name"))
    return learn.by_rules(rows, "id", agency="agency_name")


def l4_flips(spark, sf):
    """Labels of owners against the rules: what changes, and what is kept for which reason."""
    rows = leads(spark, sf).withColumn("text", F.concat_ws(" ", "title", "description", F.lit("para"), "contact_name"))
    labels = rows.select("id", F.when(F.col("owner_type") == "agency", 1).when(F.col("owner_type") == "fsbo", 0).alias("label"), (F.col("discovery_source") == "1-URGENT").alias("locked")).where("label is not null")
    return learn.flips(learn.relabelled(labels, learn.by_rules(rows, "id", agency="agency_name"), "id", 0.6))


def _stream(spark, sf):
    path = f"{sf}/events.parquet"
    static = spark.read.parquet(path)
    # The source reads a folder; a lone file is matched by name.
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "events*.parquet").parquet(sf) if not _is_folder(static) else spark.readStream.schema(static.schema).parquet(path)


def _is_folder(df) -> bool:
    return any("/events.parquet/" in f for f in df.inputFiles()[:1])


def _drained(spark, stream, mode="append"):
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    return streams.drained(stream, f"{base}/out", f"{base}/checkpoint", mode)


def n1_stream_dedup(spark, sf):
    rows = _stream(spark, sf).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.first_seen(rows, ["event_id"], "ts", "60 days")
    return _drained(spark, found).select("event_id", "user_id", "event_type")


def n3_stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    rows = _stream(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = _drained(spark, streams.sessions(rows, "user_id", "ts", "6 hours", "1 hour"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (a2_delta_ingest, a3_queue, a4_known_ids, a4_landed_today, a5_novelty, a14_upsert, d1_listing_key, d2_upsert_merge, d3_merged_sources, d4_fuzzy_match, d4_fuzzy_match_exact_ratio, d6_filled_from_donors, d8_name_propagation, d11_find_existing, d16_near_codes, d16_code_classes, d17_merge_clusters, d22_geo_resolved, k1_search, k1_phrase_near, k1_bm25, k3_contains, k4_similar_items, l2_text_classifier, l2_cross_validation, l3_rules_without_model, l4_flips, n1_stream_dedup, n3_stream_sessions)}

_REACH = f"({PHONE} OR {EMAIL} OR coalesce(contact_whatsapp <> '', false))"
_RUNGS = lambda d, rungs: "CASE " + " ".join(f"WHEN {d} <= {m} THEN {v}" for m, v in rungs) + " ELSE 0.0 END"
_GAP = lambda c: f"abs(t.{c} - d.{c}) / greatest(t.{c}, d.{c})"
_MATCH = f"""base AS (SELECT id, lower(zone) AS zone, typology, price, area_m2 AS area, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS title, discovery_source AS source, {_REACH} AS reach, is_demo, coalesce(contact_source, '') AS cs FROM leads WHERE NOT archived),
rated AS (SELECT t.id, d.id AS donor_id, CASE WHEN t.price > 0 AND d.price > 0 THEN 1 ELSE 0 END AS hp, CASE WHEN t.area > 0 AND d.area > 0 THEN 1 ELSE 0 END AS ha,
  CASE WHEN t.price > 0 AND d.price > 0 THEN ({_RUNGS(_GAP("price"), resolve.PRICE_RUNGS)})::DOUBLE * 2.0 ELSE 0.0 END AS p, CASE WHEN t.area > 0 AND d.area > 0 THEN ({_RUNGS(_GAP("area"), resolve.AREA_RUNGS)})::DOUBLE * 1.5 ELSE 0.0 END AS a,
  1 - levenshtein(t.title, d.title) / greatest(length(t.title), length(d.title))::DOUBLE AS ratio
  FROM base t JOIN base d ON t.zone = d.zone AND t.source <> d.source AND t.typology = d.typology WHERE NOT t.reach AND NOT t.is_demo AND d.reach AND NOT d.is_demo AND NOT regexp_matches(d.cs, '^(cross_portal|website):')),
scored AS (SELECT id, donor_id, (p + 1.5 + a + ratio) / (hp * 2.0 + 1.5 + ha * 1.5 + 1.0)::DOUBLE AS score FROM rated WHERE hp = 1 OR ha = 1),
best AS (SELECT id, donor_id, score, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, donor_id) AS place, count(*) OVER (PARTITION BY id) AS n FROM scored WHERE score >= 0.72) WHERE place = 1)"""
_TERMS = "terms AS (SELECT doc_id AS id, t.pos, t.term FROM documents, LATERAL (SELECT unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT string_split(trim(regexp_replace(regexp_replace(lower(translate(text, 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w)) t WHERE t.term <> '')"

_TOKEN = lambda words: "regexp_matches(lower(title || ' ' || description || concat(' para ', contact_name)), '" + "|".join(w.replace(".", "[.]") for w in words) + "')"
_RULED = f"CASE WHEN agency_name <> '' OR {_TOKEN(learn.AGENCY_TOKENS)} THEN 1 ELSE 0 END AS predicted, CASE WHEN agency_name <> '' THEN 0.85 WHEN {_TOKEN(learn.AGENCY_TOKENS)} OR {_TOKEN(learn.OWNER_TOKENS)} THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence"

ORACLE_SQL = {
    "a2_delta_ingest": f"WITH l AS ({LANDED}) SELECT min(id) AS id, source, external_id FROM l WHERE {NEW} AND external_id IS NOT NULL AND (source, external_id) NOT IN (SELECT (source, external_id) FROM l WHERE {OLD} AND external_id IS NOT NULL) GROUP BY source, external_id UNION ALL SELECT id, source, external_id FROM l WHERE {NEW} AND external_id IS NULL",
    "a3_queue": f"SELECT id, external_id FROM ({LANDED}) WHERE source = 'click' AND id % 3 <> 0 ORDER BY scraped_at, id LIMIT 500",
    "a4_known_ids": f"SELECT DISTINCT source, external_id FROM ({LANDED}) WHERE external_id IS NOT NULL",
    "a4_landed_today": f"SELECT source, count(*) AS n FROM ({LANDED}) WHERE scraped_at >= TIMESTAMP '2024-01-28' GROUP BY 1",
    "a5_novelty": f"WITH l AS ({LANDED}) SELECT batch_id, count(*) AS n, round(avg(s), 4) AS known_share, avg(s) >= 0.6 AS stop FROM (SELECT batch_id, CASE WHEN (source, external_id) IN (SELECT (source, external_id) FROM l WHERE {OLD} AND external_id IS NOT NULL) THEN 1.0 ELSE 0.0 END AS s FROM l WHERE {NEW} AND external_id IS NOT NULL) GROUP BY 1",
    "a14_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM orders",
    "d1_listing_key": with_leads("SELECT id, sha256(concat_ws('|', lower(typology), lower(zone), (round_even(coalesce(price, 0) / 1000, 0)::BIGINT * 1000)::VARCHAR, (round_even(coalesce(area_m2, 0) / 5, 0)::BIGINT * 5)::VARCHAR, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g')))[:16] AS fingerprint FROM leads"),
    "d2_upsert_merge": f"""WITH b AS ({BATCH}), f AS (SELECT fp, id % 3 = 0 AS old, arg_max(price, (scraped_at, id)) AS price, arg_min(contact_phone, (scraped_at, id)) AS contact_phone, arg_min(contact_email, (scraped_at, id)) AS contact_email, max(length(description)) AS n FROM b GROUP BY 1, 2),
  j AS (SELECT coalesce(o.fp, n.fp) AS fp, o.fp IS NULL AS is_new, o.price AS p0, n.price AS p1, coalesce(o.contact_phone, n.contact_phone) AS contact_phone, coalesce(o.contact_email, n.contact_email) AS contact_email, greatest(coalesce(o.n, 0), coalesce(n.n, 0)) AS text_chars FROM (SELECT * FROM f WHERE old) o FULL JOIN (SELECT * FROM f WHERE NOT old) n ON o.fp = n.fp)
  SELECT fp, CASE WHEN p0 IS NULL OR abs((p1 - p0) / p0) > 0.005 THEN coalesce(p1, p0) ELSE p0 END AS price, CASE WHEN abs((p1 - p0) / p0) > 0.005 THEN 1 ELSE 0 END AS price_changes, contact_phone, contact_email, text_chars, is_new FROM j""",
    "d3_merged_sources": with_leads("SELECT fp, count(*) AS n_sources, string_agg(source || '@' || url, ',' ORDER BY seen_at, source) AS sources FROM (SELECT contact_name AS fp, discovery_source AS source, arg_min(external_id, (first_seen_at, external_id)) AS url, min(first_seen_at) AS seen_at FROM leads GROUP BY 1, 2) GROUP BY 1"),
    "d4_fuzzy_match": with_leads("").rstrip() + f", {_MATCH} SELECT id, donor_id, round(score, 6) AS score, n AS n_candidates FROM best",
    "d6_filled_from_donors": with_leads("").rstrip() + f""", {_MATCH}, filled AS (SELECT l.id, b.donor_id, d.discovery_source AS s, l.contact_name, {", ".join(f"CASE WHEN l.{c} <> '' THEN l.{c} ELSE d.{c} END AS {c}" for c in ("contact_phone", "contact_email", "contact_whatsapp", "contact_website"))} FROM best b JOIN leads l ON l.id = b.id JOIN leads d ON d.id = b.donor_id)
  SELECT id, donor_id, contact_phone, contact_email, contact_whatsapp, contact_website, 'cross_portal:' || s AS contact_source, CASE WHEN contact_phone <> '' OR contact_whatsapp <> '' THEN 100 WHEN contact_email <> '' THEN 70 WHEN contact_website <> '' THEN 40 ELSE 30 END AS contact_confidence FROM filled""",
    "d8_name_propagation": f"WITH s AS ({SELLERS}) SELECT a.id, b.phone FROM s a JOIN (SELECT lower(name) AS n, lower(zone) AS z, arg_min(phone, id) AS phone FROM s WHERE phone IS NOT NULL GROUP BY 1, 2) b ON lower(a.name) = n AND lower(a.zone) = z WHERE a.phone IS NULL",
    "d11_find_existing": with_leads(f"""SELECT id, coalesce(p, e, r) AS lead_id, CASE WHEN p IS NOT NULL THEN 'phone' WHEN e IS NOT NULL THEN 'email' WHEN r IS NOT NULL THEN 'price' ELSE 'new' END AS matched_by FROM (SELECT i.id, (SELECT min(l.id) FROM leads l WHERE l.contact_phone = i.contact_phone) AS p, (SELECT min(l.id) FROM leads l WHERE l.contact_email = i.contact_email) AS e,
  (SELECT min(l.id) FROM leads l WHERE l.zone = i.zone AND l.typology = i.typology AND l.price >= i.price * 0.95::DOUBLE AND l.price <= i.price * 1.05::DOUBLE) AS r FROM (SELECT * REPLACE (price::DOUBLE AS price) FROM ({IMPORTS})) i)"""),
    "d16_near_codes": f"""WITH c AS (SELECT code, min(id) AS id, count(*) FILTER (WHERE source = 'a') AS na, count(*) FILTER (WHERE source = 'b') AS nb FROM ({CODES}) GROUP BY 1)
  SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, bit_count(xor(x.code, y.code))::INT AS bits, CASE WHEN x.id = y.id THEN x.na * x.nb ELSE x.na * y.nb + x.nb * y.na END AS links FROM c x JOIN c y ON x.id <= y.id AND bit_count(xor(x.code, y.code)) <= 5 WHERE CASE WHEN x.id = y.id THEN x.na * x.nb ELSE x.na * y.nb + x.nb * y.na END > 0""",
    "d16_code_classes": f"SELECT id, min(id) OVER (PARTITION BY code) AS class_id FROM ({CODES})",
    "d17_merge_clusters": with_leads("""SELECT min(id) AS cluster, arg_min(id, (first_seen_at, id)) AS canonical_id, any_value(contact_phone) AS contact_phone, max(score) AS score, count(*) AS members, array_to_string(list_sort(list_distinct(list(discovery_source))), ',') AS sources
  FROM leads WHERE contact_phone <> '' OR contact_email <> '' GROUP BY coalesce(contact_phone, contact_email) HAVING count(*) > 1"""),
    "d22_geo_resolved": with_leads("SELECT id, CASE WHEN hit THEN 1.5 WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1.0 END::DOUBLE AS lat, CASE WHEN hit THEN 2.5 WHEN n_nationkey % 2 = 0 THEN 0.5 END::DOUBLE AS lon, CASE WHEN hit THEN 'cache' WHEN n_nationkey % 2 = 0 THEN 'zone' ELSE 'none' END AS geo_source FROM (SELECT id, zone, (title, zone) IN (SELECT (title, zone) FROM leads WHERE id % 5 = 0) AS hit FROM leads) JOIN nation ON zone = n_name"),
    "k1_search": f"WITH {_TERMS} SELECT id FROM terms GROUP BY id HAVING bool_or(term = 'the') AND bool_or(term = 'of') AND bool_or(term LIKE 'tion%') AND NOT bool_or(term = 'license')",
    "k1_phrase_near": f"WITH {_TERMS} SELECT DISTINCT id FROM terms WHERE id IN (SELECT a.id FROM terms a JOIN terms b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') AND id IN (SELECT a.id FROM terms a JOIN terms b ON a.id = b.id AND abs(a.pos - b.pos) <= 4 WHERE a.term = 'and' AND b.term = 'to') AND term IN ('in', 'de')",
    "k1_bm25": f"""WITH {_TERMS}, len AS (SELECT id, count(*) AS l FROM terms GROUP BY 1), tf AS (SELECT id, term, count(*) AS tf FROM terms WHERE term IN ('license', 'copyright', 'under') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
  SELECT id, round(score, 6) AS score FROM (SELECT tf.id, sum(ln(1 + ((SELECT count(*) FROM len) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT avg(l) FROM len)))) AS score FROM tf JOIN df USING (term) JOIN len USING (id) GROUP BY 1) ORDER BY score DESC, id LIMIT 100""",
    "k3_contains": with_leads("SELECT id FROM leads WHERE contains(lower(title), 'urgente') OR contains(lower(description), 'urgente') OR contains(lower(zone), 'urgente')"),
    "l3_rules_without_model": with_leads(f"SELECT id, {_RULED} FROM leads"),
    "l4_flips": with_leads(f"SELECT outcome, CASE WHEN outcome = 'changed' THEN label END AS before, CASE WHEN outcome = 'changed' THEN predicted END AS after, count(*) AS n FROM (SELECT *, CASE WHEN discovery_source = '1-URGENT' THEN 'locked' WHEN label = predicted THEN 'same' WHEN confidence < 0.6 THEN 'uncertain' ELSE 'changed' END AS outcome FROM (SELECT *, CASE owner_type WHEN 'agency' THEN 1 WHEN 'fsbo' THEN 0 END AS label, {_RULED} FROM leads) WHERE label IS NOT NULL) GROUP BY 1, 2, 3"),
    "n3_stream_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, k, count(*) AS n, max(ts) AS last FROM s GROUP BY 1, 2) WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1",
    "k4_similar_items": """WITH words AS (SELECT p_partkey AS id, p_retailprice AS price, list_filter(string_split_regex(lower(concat_ws(' ', p_type, p_type, p_brand, p_name)), '\\s+'), lambda x: x <> '') AS w FROM part),
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words) GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM part),
  raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS r FROM tf JOIN df USING (term), n WHERE df >= 2 AND df <= 0.85::DOUBLE * n),
  v AS (SELECT id, term, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM raw),
  c AS (SELECT a.id AS q, b.id, sum(a.w * b.w) AS cosine FROM v a JOIN v b ON a.term = b.term AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2)
  SELECT q, place::INT AS place, id, round(cosine, 6) AS cosine FROM (SELECT q, c.id, cosine, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, c.id) AS place FROM c JOIN part x ON x.p_partkey = q JOIN part y ON y.p_partkey = c.id
    WHERE y.p_retailprice >= x.p_retailprice * 0.85::DOUBLE AND y.p_retailprice <= x.p_retailprice * 1.15::DOUBLE) WHERE place <= 5""",
    "n1_stream_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
}
