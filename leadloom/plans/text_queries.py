"""Text, parsing, classification, contact and page queries (B, A-16..A-18), with their oracles.

RAW derives listing-like strings from the part table; both engines run the same text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import classify, contact, parse, text
from leadloom.plans.views import table, view
from leadloom.sources import html, ingest
from leadloom.sources.landing import spread

RAW = """
SELECT p_partkey AS id, p_name,
  CASE p_partkey % 8 WHEN 0 THEN concat(CAST(p_partkey * 13 % 900 + 10 AS STRING), '.000 €') WHEN 1 THEN concat(CAST(p_partkey * 7 % 900 + 10 AS STRING), ' 000€') WHEN 2 THEN '195,000' WHEN 3 THEN concat('desde ', CAST(p_partkey % 700 + 6 AS STRING), '.500,00 EUR') WHEN 4 THEN 'sob consulta' WHEN 5 THEN '4.000 €' WHEN 6 THEN '99.000.000 €' ELSE NULL END AS price_raw,
  CASE p_partkey % 5 WHEN 0 THEN concat(CAST(p_size AS STRING), ' m²') WHEN 1 THEN concat('area ', CAST(p_size AS STRING), ',5m2') WHEN 2 THEN 'grande' WHEN 3 THEN concat(CAST(p_size AS STRING), '.25 M') ELSE NULL END AS area_raw,
  CASE p_partkey % 7 WHEN 0 THEN '250.000 EUR' WHEN 1 THEN concat(CAST(p_partkey AS STRING), ',50') WHEN 2 THEN concat('1.', CAST(100 + p_partkey % 900 AS STRING), ',75') WHEN 3 THEN concat('1,', CAST(100 + p_partkey % 900 AS STRING), '.5') WHEN 4 THEN '12.5' WHEN 5 THEN 'n/d' ELSE NULL END AS import_price,
  CASE p_partkey % 6 WHEN 0 THEN ' Sim ' WHEN 1 THEN 'não' WHEN 2 THEN 'particular' WHEN 3 THEN 'talvez' WHEN 4 THEN '0' ELSE NULL END AS bool_raw,
  CASE p_partkey % 13 WHEN 0 THEN concat('Apartamento T', CAST(p_partkey % 9 AS STRING), ' ') WHEN 1 THEN 'Terreno urbano' WHEN 2 THEN 'Loja comercial ' WHEN 3 THEN 'Moradia isolada V4' WHEN 4 THEN 'studio novo' WHEN 5 THEN 'Quarto mobilado T2' WHEN 6 THEN 'Garagem fechada' WHEN 7 THEN 'Quinta com casa' WHEN 8 THEN 'Gabinete de trabalho' WHEN 9 THEN 'T 1 para arrendar' WHEN 10 THEN 'duplex usado' WHEN 11 THEN 'lote para renovar' ELSE p_name END AS title,
  CASE p_partkey % 11 WHEN 0 THEN 'vendo urgente, aceito propostas' WHEN 1 THEN 'divorcio, precisa de obras' WHEN 2 THEN 'banco penhora' WHEN 3 THEN 'piscina, garagem e vista para o mar' WHEN 4 THEN 'perto do metro com varandas e elevador' WHEN 5 THEN 'particular vende sem comissao' WHEN 6 THEN 'empreiteiro obra nova' WHEN 7 THEN 'imobiliaria remax' WHEN 8 THEN 'renda mensal' WHEN 9 THEN 'entrega 2025' ELSE '' END AS description,
  CASE p_partkey % 9 WHEN 0 THEN 'Rua do Carmo, Chiado, Misericordia, Lisboa, Lisboa' WHEN 1 THEN 'Monte Estoril, Cascais e Estoril, Cascais, Lisboa' WHEN 2 THEN 'Sesimbra, Sesimbra' WHEN 3 THEN 'almada' WHEN 4 THEN 'Rua 25, Lote 4, Seixal' WHEN 5 THEN 'none' WHEN 6 THEN 'xx' WHEN 7 THEN 'costa da caparica, almada' ELSE 'terra nova' END AS location,
  CASE p_partkey % 12 WHEN 0 THEN concat('+351 91', lpad(CAST(p_partkey * 37 % 10000000 AS STRING), 7, '0')) WHEN 1 THEN concat('0035121', lpad(CAST(p_partkey * 41 % 10000000 AS STRING), 7, '1')) WHEN 2 THEN '707 123 456' WHEN 3 THEN '(966) 123-987' WHEN 4 THEN '999999999' WHEN 5 THEN '12345' WHEN 6 THEN concat('66', lpad(CAST(p_partkey % 10000000 AS STRING), 7, '7')) WHEN 7 THEN '' WHEN 8 THEN '512345678' WHEN 9 THEN '123456789' WHEN 10 THEN concat('7', lpad(CAST(p_partkey * 11 % 100000000 AS STRING), 8, '3')) ELSE NULL END AS phone_raw,
  CASE p_partkey % 4 WHEN 0 THEN concat('https://x.pt/d/t', CAST(p_partkey AS STRING), '-IDa', CAST(p_partkey AS STRING), '.html') WHEN 1 THEN concat('https://x.pt/comprar/apartamento/', CAST(100000 + p_partkey AS STRING)) WHEN 2 THEN 'https://x.pt/moradias/casa-bonita/?q=1' ELSE concat('https://y.pt/quinta/', p_type) END AS url
FROM part
"""
FRAGMENTS = (("lisboa", "Lisboa"), ("cascais", "Cascais"), ("estoril", "Cascais"), ("costa da caparica", "Almada"), ("almada", "Almada"), ("seixal", "Seixal"), ("chiado", "Lisboa"))
OWNER_SOURCES = ("olx",)


def raw(spark, sf):
    return spread(view(spark, sf, RAW), "id")


def b2_norm_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.norm_text(F.col("text"), keep_punctuation=True)).alias("norm_md5"), F.md5(text.slug(F.col("text"))).alias("slug_md5"), F.md5(text.clean_text(F.col("text"))).alias("clean_md5"))


def b6_split_name(spark, sf):
    first, last = text.split_name(F.col("p_name"))
    return raw(spark, sf).select("id", first.alias("first"), last.alias("last"), text.header_key(F.col("p_name")).alias("header"))


def b12_listing_numbers(spark, sf):
    return raw(spark, sf).select("id", parse.listing_price(F.col("price_raw")).alias("price"), parse.listing_area(F.col("area_raw")).alias("area"))


def b14_import_values(spark, sf):
    return raw(spark, sf).select("id", parse.import_price(F.col("import_price")).alias("price"), parse.import_bool(F.col("bool_raw")).alias("flag"))


def b18_typology(spark, sf):
    rows = raw(spark, sf)
    return rows.select("id", classify.typology(F.col("title")).alias("typology"), classify.property_type(F.col("title"), F.col("url")).alias("property_type"), classify.condition(F.col("title")).alias("condition"), classify.is_residential(F.col("title"), parse.listing_area(F.col("area_raw"))).alias("residential"))


def b19_places(spark, sf):
    town, parish = classify.municipality(F.col("location"), F.lit("-"))
    return raw(spark, sf).select("id", classify.zone(F.col("location"), FRAGMENTS).alias("zone"), classify.longest_fragment(F.col("location"), [f for f, _ in FRAGMENTS]).alias("parish"), town.alias("municipality"), parish.alias("sub_zone"))


def b22_urgency(spark, sf):
    points, found = classify.urgency(F.col("description"))
    return raw(spark, sf).select("id", points.alias("points"), F.array_join(found.cast("array<string>"), ",").alias("rules"), classify.is_direct(F.col("description")).alias("direct"))


def b24_owner_lead_type(spark, sf):
    source = F.when(F.col("id") % 2 == 0, "olx").otherwise("other")
    owner = classify.owner_type(F.concat_ws(" ", "title", "description"), F.when(F.col("id") % 17 == 0, "Some House"), source, F.when(F.col("id") % 19 == 0, "fsbo"), OWNER_SOURCES)
    rows = raw(spark, sf).withColumn("owner_type", owner)
    return rows.select("id", "owner_type", classify.lead_type(F.col("owner_type"), F.concat_ws(" ", "title", "description")).alias("lead_type"))


def b29_amenities(spark, sf):
    return raw(spark, sf).select("id", F.array_join(classify.tags(F.concat_ws(" ", "title", "description"), classify.AMENITIES), ",").alias("tags"))


def b38_phone(spark, sf):
    return raw(spark, sf).select("id", contact.phone(F.col("phone_raw")).alias("p")).select("id", "p.valid", "p.canonical", "p.kind", "p.suspicious", "p.confidence", "p.reason")


def b39_phones_in_text(spark, sf):
    t = F.concat(F.lit("Tlm: "), F.coalesce("phone_raw", F.lit("-")), F.lit(" ou 213 456 789 / 917.654.321, wa.me/351912345678"))
    rows = raw(spark, sf).withColumn("t", t)
    return rows.select("id", F.array_join(contact.phones_in_text(F.col("t")), ",").alias("phones"), contact.whatsapp(F.col("t")).alias("whatsapp"), contact.best_phone(F.array("phone_raw", F.lit("661234568"), F.lit("213456789"))).alias("best"))


def b45_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(contact.emails_in_text(F.col("text")), ",").alias("emails"), contact.website_in_text(F.col("text")).alias("website")).where("emails <> '' OR website IS NOT NULL")


def _pages(spark, sf):
    rows = raw(spark, sf)
    offer = F.to_json(F.struct(F.col("id").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency"), F.struct(F.col("location").alias("name")).alias("areaServed")))
    body = F.concat(F.lit('{"@type":"Product","description":"'), "description", F.lit('","sku":"s'), F.col("id").cast("string"), F.lit('","offers":'), F.when(F.col("id") % 2 == 0, F.concat(F.lit("["), offer, F.lit("]"))).otherwise(offer), F.lit("}"))
    block = F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(F.col("id") % 3 == 1, F.concat(F.lit('{"@graph":['), body, F.lit("]}"))).when(F.col("id") % 5 == 0, F.lit("{broken")).otherwise(body)
    return rows.select(F.col("id").alias("page_id"), "url", "phone_raw", F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit("</script><p>Tel 213 456 789</p><a href='tel:+351661234567'>"), F.lit("</a><div data-phone='"), F.coalesce("phone_raw", F.lit("")), F.lit("'></div></html>")).alias("html"))


def a17_embedded_json(spark, sf):
    return html.embedded(_pages(spark, sf)).drop("phone_raw", "url")


def a18_listing_id(spark, sf):
    return raw(spark, sf).select("id", html.listing_id(F.col("url")).alias("listing_id"))


def a16_kept_urls(spark, sf):
    return html.kept_urls(table(spark, sf, "pages"), ["/en/", "/de/"], ["example"], 1000)


def b44_page_phones(spark, sf):
    return _pages(spark, sf).select("page_id", F.array_join(html.page_phones(F.col("html")), ",").alias("phones"))


def a7_canonical_columns(spark, sf):
    rows = raw(spark, sf).select(F.col("id").cast("string").alias("Telefone"), F.col("title").alias("Título"), F.col("import_price").alias("Preço"), F.col("bool_raw").alias("Extra"), F.col("title").alias("imovel"))
    return ingest.canonical(rows).select("contact_phone", "title", "price", "raw")


def a1_json_payload(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props")).alias("raw_data"))
    return ingest.parsed(rows, "k long").select("event_id", "k", F.col("corrupt").isNotNull().alias("corrupt"))


QUERIES = {f.__name__: f for f in (b2_norm_text, b6_split_name, b12_listing_numbers, b14_import_values, b18_typology, b19_places, b22_urgency, b24_owner_lead_type, b29_amenities, b38_phone, b39_phones_in_text, b45_emails, a1_json_payload, a7_canonical_columns, a16_kept_urls, a17_embedded_json, a18_listing_id, b44_page_phones)}


def with_raw(sql: str) -> str:
    return f"WITH raw AS ({RAW}) {sql}"


def _case(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{v}'" for p, v in rules) + f" ELSE {default} END"


_PHONE = """SELECT id, phone_raw, n, CASE WHEN coalesce(trim(phone_raw), '') = '' THEN 'empty' WHEN NOT regexp_full_match(n, '[0-9]{9}') THEN 'not 9 digits'
  WHEN n IN ('123456789', '987654321', '123123123', '112112112', '999999998', '000000001') OR regexp_matches(n, '0{6}|1{6}|2{6}|3{6}|4{6}|5{6}|6{6}|7{6}|8{6}|9{6}') THEN 'placeholder'
  WHEN n[1] NOT IN ('2', '6', '7', '9') THEN 'first digit' WHEN n[:3] IN ('707', '708', '800', '808', '809') THEN 'premium' ELSE '' END AS reason,
  CASE WHEN n[:3] IN ('707', '708', '800', '808', '809') THEN 'premium' WHEN n[:2] IN ('90', '91', '92', '93', '96') THEN 'mobile' WHEN n[1] = '6' THEN 'relay' WHEN n[1] = '2' THEN 'landline' ELSE 'unknown' END AS k
  FROM (SELECT id, phone_raw, CASE WHEN s LIKE '351%' AND length(s) = 12 THEN s[4:] WHEN s LIKE '00351%' AND length(s) = 14 THEN s[6:] ELSE s END AS n FROM (SELECT id, phone_raw, regexp_replace(trim(coalesce(phone_raw, '')), '[\\s()./+-]', '', 'g') AS s FROM raw))"""
_TAGS = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(t, '{p}')" if " " in p else f"regexp_matches(t, '\\b{p}\\b')" for p in phrases) + f" THEN '{tag}' END" for tag, phrases in classify.AMENITIES.items()
)
_POINTS = "greatest(0, " + ", ".join(f"CASE WHEN regexp_matches(description, '{p}') THEN {n} ELSE 0 END" for p, n in classify.URGENCY) + ")"
_RULES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(description, '{p}') THEN '{k}' END" for k, (p, _) in enumerate(classify.URGENCY)) + "], lambda x: x IS NOT NULL), ',')"
_ALL = "concat_ws(' ', title, description)"

ORACLE_SQL = {
    "b2_norm_text": r"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\s+', ' ', 'g'), ' ')) AS norm_md5, md5(regexp_replace(regexp_replace(translate(lower(text), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS clean_md5 FROM documents",
    "b6_split_name": with_raw("SELECT id, string_split(p_name, ' ')[1] AS first, array_to_string(string_split(p_name, ' ')[2:], ' ') AS last, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS header FROM raw"),
    "b12_listing_numbers": with_raw(r"""SELECT id, CASE WHEN p > 5000 AND p < 10000000 THEN p END AS price, CASE WHEN a > 5 AND a < 50000 THEN a END AS area FROM (SELECT id, try_cast(replace(regexp_replace(regexp_extract(price_raw, '[\d\s.,]+'), '[\s.]', '', 'g'), ',', '.') AS DOUBLE) AS p, try_cast(replace(regexp_extract(area_raw, '(?i)(\d+[.,]?\d*)\s*m²?', 1), ',', '.') AS DOUBLE) AS a FROM raw)"""),
    "b14_import_values": with_raw(r"""SELECT id, try_cast(CASE WHEN contains(s, ',') AND contains(s, '.') AND strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') WHEN contains(s, ',') AND contains(s, '.') THEN replace(s, ',', '') WHEN contains(s, ',') THEN replace(s, ',', '.') WHEN regexp_matches(s, '\.\d{3}$') THEN replace(s, '.', '') ELSE s END AS DOUBLE) AS price,
  CASE WHEN lower(trim(bool_raw)) IN ('1', 'true', 'yes', 'sim', 'y', 's', 'particular', 'owner') THEN true WHEN lower(trim(bool_raw)) IN ('0', 'false', 'no', 'nao', 'não', 'n', 'agencia', 'agência') THEN false END AS flag FROM (SELECT *, regexp_replace(import_price, '[^\d,.]', '', 'g') AS s FROM raw)"""),
    "b18_typology": with_raw(f"""SELECT id, {_case("title", classify.TYPOLOGY, "CASE WHEN regexp_extract(title, '(?i)\\bT\\s*([0-9])\\b', 1) = '' THEN 'Desconhecido' WHEN regexp_extract(title, '(?i)\\bT\\s*([0-9])\\b', 1) >= '5' THEN 'T5+' ELSE 'T' || regexp_extract(title, '(?i)\\bT\\s*([0-9])\\b', 1) END")} AS typology,
  CASE WHEN contains(url, '/apartamento') THEN 'Apartamento' WHEN contains(url, '/moradia') THEN 'Moradia' WHEN contains(url, '/quinta') THEN 'Quinta' ELSE {_case("title", [r for r in classify.PROPERTY_WORDS if "(?!" not in r[0]][:6] + [(r"\bloja\b", "Loja"), classify.PROPERTY_WORDS[7]], "''")} END AS property_type,
  {_case("lower(title)", classify.CONDITION, "'desconhecido'")} AS condition, NOT (coalesce(area < 10, false) OR (regexp_matches(title, '{classify.NON_RESIDENTIAL}', 'i') AND NOT regexp_matches(title, '{classify.RESIDENTIAL}', 'i'))) AS residential
  FROM (SELECT *, CASE WHEN a > 5 AND a < 50000 THEN a END AS area FROM (SELECT *, try_cast(replace(regexp_extract(area_raw, '(?i)(\\d+[.,]?\\d*)\\s*m²?', 1), ',', '.') AS DOUBLE) AS a FROM raw))"""),
    "b19_places": with_raw("""SELECT id, CASE p WHEN 0 THEN 'Lisboa' WHEN 1 THEN 'Lisboa' WHEN 2 THEN 'Sesimbra, Sesimbra' WHEN 3 THEN 'Almada' WHEN 4 THEN 'Seixal' WHEN 5 THEN 'Outra' WHEN 6 THEN 'Outra' WHEN 7 THEN 'Almada' ELSE 'Terra Nova' END AS zone,
  CASE p WHEN 0 THEN 'Lisboa' WHEN 1 THEN 'Cascais' WHEN 3 THEN 'Almada' WHEN 4 THEN 'Seixal' WHEN 7 THEN 'Costa Da Caparica' ELSE '' END AS parish,
  CASE p WHEN 0 THEN 'Lisboa' WHEN 1 THEN 'Cascais' WHEN 2 THEN 'Sesimbra' WHEN 7 THEN 'costa da caparica' ELSE '-' END AS municipality,
  CASE p WHEN 0 THEN 'Misericordia' WHEN 1 THEN 'Cascais e Estoril' ELSE '' END AS sub_zone FROM (SELECT id, id % 9 AS p FROM raw)"""),
    "b22_urgency": with_raw(f"SELECT id, {_POINTS} AS points, {_RULES} AS rules, NOT regexp_matches(description, '{classify.AGENCY_WORDS}', 'i') AS direct FROM raw"),
    "b24_owner_lead_type": with_raw(f"""SELECT id, owner_type, CASE WHEN owner_type = 'agency' THEN 'agency_listing' WHEN owner_type = 'developer' THEN 'developer_listing' WHEN regexp_matches(t, '{classify.RENTAL}', 'i') THEN 'frbo' WHEN owner_type = 'fsbo' THEN 'fsbo' ELSE 'unknown' END AS lead_type
  FROM (SELECT id, {_ALL} AS t, CASE WHEN id % 19 = 0 THEN 'fsbo' WHEN id % 17 = 0 THEN 'agency' WHEN regexp_matches({_ALL}, '{classify.DEVELOPER}', 'i') THEN 'developer' WHEN regexp_matches({_ALL}, '{classify.AGENCY}', 'i') THEN 'agency' WHEN regexp_matches({_ALL}, '{classify.OWNER}', 'i') THEN 'fsbo' WHEN id % 2 = 0 THEN 'fsbo' ELSE 'unknown' END AS owner_type FROM raw)"""),
    "b29_amenities": with_raw(f"SELECT id, array_to_string(list_sort(list_filter([{_TAGS}], lambda x: x IS NOT NULL)), ',') AS tags FROM (SELECT id, trim(regexp_replace(lower(strip_accents({_ALL})), '\\s+', ' ', 'g')) AS t FROM raw)"),
    "b38_phone": with_raw(f"""SELECT id, reason = '' AS valid, CASE WHEN reason = '' THEN '+351' || n END AS canonical, CASE WHEN reason = '' OR (k = 'premium' AND regexp_full_match(n, '[0-9]{{9}}')) THEN k ELSE 'unknown' END AS kind,
  regexp_full_match(n, '[0-9]{{9}}') AND (reason = 'placeholder') AS suspicious, CASE WHEN reason <> '' THEN 0 WHEN k = 'mobile' THEN 90 WHEN k = 'landline' THEN 70 WHEN k = 'relay' THEN 50 ELSE 40 END AS confidence, reason FROM ({_PHONE})"""),
    "a1_json_payload": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::BIGINT END AS k, event_id % 7 = 0 AS corrupt FROM events",
    "a7_canonical_columns": with_raw("""SELECT id::VARCHAR AS contact_phone, title, import_price AS price, CASE WHEN bool_raw IS NULL THEN '{"imovel":' || to_json(title)::VARCHAR || '}' ELSE '{"Extra":' || to_json(bool_raw)::VARCHAR || ',"imovel":' || to_json(title)::VARCHAR || '}' END AS raw FROM raw"""),
    "a16_kept_urls": "SELECT DISTINCT url FROM pages WHERE regexp_matches(lower(url), '/en/|/de/') AND contains(lower(url), 'example') ORDER BY url LIMIT 1000",
    "a17_embedded_json": with_raw("""SELECT id AS page_id, CASE WHEN ok THEN id::DOUBLE END AS price, CASE WHEN ok THEN 'EUR' END AS currency, CASE WHEN ok THEN location END AS place, CASE WHEN ok THEN description END AS description, CASE WHEN ok THEN 's' || id END AS sku FROM (SELECT *, NOT (id % 3 = 2 AND id % 5 = 0) AS ok FROM raw)"""),
    "a18_listing_id": with_raw(r"SELECT id, CASE id % 4 WHEN 0 THEN 'a' || id WHEN 1 THEN (100000 + id)::VARCHAR WHEN 2 THEN 'casa-bonita' ELSE regexp_extract(url, '([^/]*)$', 1) END AS listing_id FROM raw"),
    "b44_page_phones": with_raw(f"""SELECT id AS page_id, CASE WHEN reason = '' AND n <> '661234567' THEN '+351' || n || ',' ELSE '' END || '+351661234567,+351213456789' AS phones FROM ({_PHONE})"""),
}
