"""Payloads of many sources and files of imports (A-1, A-9, A-10, A-17, B-37, B-49), with their oracles.

The payloads are made of orders, by one SQL text for both engines: thirteen shapes, and texts that reach each rule of the mappers.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from leadloom.plans.text_queries import FRAGMENTS
from leadloom.plans.views import shared_dir, view
from leadloom.sources import html, imports, landing

TOWNS = (("Lisboa", "Lisboa"), ("Cascais", "Cascais"), ("Porto", "Porto"))
_K = "o_orderkey"
_CODES = ("olx", "olx_marketplace", "standvirtual", "imovirtual", "idealista", "sapo", "custojusto", "linkedin", "novobanco_imoveis", "leiloes", "facebook_marketplace", "portal_x", "custojusto")
_TITLES = ("Apartamento T2 com piscina", "Moradia V3 com jardim", "  ", "Garagem box 20 m2", "Terreno urbano 900 m2", "T1 novo particular 912345678", "Andar T7 para arrendar", "Loja era central", "Estúdio bom estado", "Empreiteiro vende T3", "Arrecadação 8 m2", "Quarto wa.me/351961234567")
_TEXTS = ("", "Vende o dono, ligue 962 345 678", "Escreva a ana.k@casa.pt ou veja www.casa-k.pt", "whatsapp 913 456 789", "Imobiliária boa, para renovar", "Construtora, entrega 2026", "Sem comissão, habitar e renovar", "obra nova com varanda")
_PLACES = ("Rua X, Parede, Cascais, Lisboa", "Setubal", "", "Lote 12, Rua 3, Lisboa", "n/a", "Almada", "Estoril, Cascais")
_PHONES = ("", "912 345 678", "+351211234567", "123", "+351999999999", "661234567")


def _pick(values: tuple[str, ...], divisor: int) -> str:
    return f"CASE CAST(floor({_K} / {divisor}) AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_TITLE, _TEXT, _PLACE, _PHONE = _pick(_TITLES, 13), _pick(_TEXTS, 5), _pick(_PLACES, 3), _pick(_PHONES, 7)
_COMMON = f""" '"url":"https://x.pt/', CASE {_K} % 5 WHEN 0 THEN 'apartamento/' WHEN 1 THEN 'moradia/' ELSE '' END, CAST({_K} AS STRING), '","description":"', {_TEXT}, '","contact_phone":"', {_PHONE}, '"' """
_PRICE = f"CASE WHEN {_K} % 19 = 0 THEN '' ELSE concat(CAST(5 + {_K} % 600 AS STRING), '.', lpad(CAST({_K} % 1000 AS STRING), 3, '0'), ' EUR') END"
_FLAT = f"""concat('{{"title":"', {_TITLE}, '","price_raw":"', {_PRICE}, '","area_raw":"', CASE {_K} % 4 WHEN 0 THEN '85 m2' WHEN 1 THEN 'grande' ELSE '' END, '","location_raw":"', {_PLACE}, '","zone_query":"porto","external_id":"x', CAST({_K} AS STRING),
 '","contact_name":"', CASE {_K} % 3 WHEN 0 THEN 'Ana Maria da Silva' WHEN 1 THEN 'Rui' ELSE '' END, '","agency_name":"', CASE WHEN {_K} % 11 = 0 THEN 'Casa Lda' ELSE '' END, '","contact_email":"', CASE WHEN {_K} % 9 = 0 THEN 'dono@x.pt' ELSE '' END,
 '","typology_raw":"', CASE {_K} % 6 WHEN 0 THEN 'T4' ELSE '' END, '","rooms_raw":"', CASE {_K} % 6 WHEN 1 THEN 'T6' ELSE '' END, '","owner_type_raw":"', CASE {_K} % 23 WHEN 0 THEN 'developer' ELSE '' END, '","owner_type":"', CASE {_K} % 17 WHEN 0 THEN 'agency' ELSE '' END,
 '","contact_source":"', CASE WHEN {_K} % 29 = 0 THEN 'seen' ELSE '' END, '","auction_status_raw":"', CASE WHEN {_K} % 2 = 0 THEN 'open' ELSE '' END, '","contact_messenger":"m.me/', CAST({_K} AS STRING), '",', {_COMMON}, '}}')"""
_POST = f"""concat('{{"text":"', {_TITLE}, '. ', {_TEXT}, ' 250.000 EUR","location":"', {_PLACE}, '","company":"', CASE WHEN {_K} % 4 = 0 THEN 'Casa SA' ELSE '' END, '","author_name":"Rui Costa","author_email":"rui@x.pt","post_id":', CAST({_K} AS STRING), ',"likes":', CAST({_K} % 7 AS STRING), '}}')"""
_STATE = f"""concat('{{"title":"', {_TITLE}, '","price":', CAST(5000 + {_K} % 9000 AS STRING), ',"locationNames":{{"parish":"Parede","county":"Cascais","district":"Lisboa"}},"companyAd":', CASE WHEN {_K} % 2 = 0 THEN 'true' ELSE 'false' END, ',"name":"Eva","listID":', CAST({_K} AS STRING), ',', {_COMMON}, '}}')"""
_SOURCE = f"CASE {_K} % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
PAYLOADS = f"SELECT {_K} AS id, {_SOURCE} AS source, CASE WHEN {_K} % 37 = 0 THEN '{{bad' WHEN {_K} % 13 = 7 THEN {_POST} WHEN {_K} % 13 = 12 THEN {_STATE} ELSE {_FLAT} END AS raw_data FROM orders"
#: The pages of a portal: a list, or a detail page with its seller, in the state block.
STATE_PAGES = """SELECT o_orderkey AS page_id, concat('<html><script id="__NEXT_DATA__" type="application/json">', CASE o_orderkey % 4
 WHEN 0 THEN concat('{"props":{"pageProps":{"listItems":[{"listID":', CAST(o_orderkey AS STRING), ',"price":5},{"listID":', CAST(o_orderkey + 1000000000 AS STRING), '}]}}}')
 WHEN 1 THEN concat('{"props":{"pageProps":{"adData":{"listID":', CAST(o_orderkey AS STRING), ',"price":7},"userData":{"name":"Eva ', CAST(o_orderkey % 5 AS STRING), '"}}}}')
 WHEN 2 THEN '{"props":{"pageProps":{"listItems":[]}}}' ELSE '{bad' END, '</script></html>') AS html FROM orders"""


#: Rows as people keep them; every tenth pair of keys is the same listing again, and some rows are empty.
IMPORTED = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE concat(CASE o_orderkey % 4 WHEN 0 THEN 'T2 centro' WHEN 1 THEN 'Moradia antiga' WHEN 2 THEN 'Loja' ELSE 'T1 novo' END, ' ', CAST(o_custkey % 40 AS STRING)) END AS title,
  CASE WHEN o_orderkey % 25 = 0 THEN '' WHEN o_custkey % 3 = 0 THEN 'Cascais' WHEN o_custkey % 3 = 1 THEN 'Almada' ELSE 'Evora' END AS zone, CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE concat(CAST(100 + o_custkey % 7 AS STRING), '.000 EUR') END AS price,
  CASE WHEN o_orderkey % 25 = 0 OR o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '912 345 678' ELSE '123' END AS phone, CASE WHEN o_orderkey % 25 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'Casa Lda' WHEN o_orderkey % 7 = 1 THEN 'Não' ELSE '' END AS agency,
  CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Proprietário Venda' WHEN 2 THEN 'promotor' ELSE 'sonst' END END AS lead, CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE CASE o_orderkey % 10 WHEN 0 THEN 'Sapo Casa' WHEN 2 THEN 'OLX' WHEN 4 THEN 'Jornal' ELSE '' END END AS source,
  CASE WHEN o_orderkey % 25 <> 0 AND o_orderkey % 8 = 0 THEN 'https://wa.me/351961234567' ELSE '' END AS wa, CASE WHEN o_orderkey % 25 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'Sim' ELSE 'false' END AS owner, CASE WHEN o_orderkey % 25 = 0 THEN '' ELSE '80 m2' END AS area FROM orders"""


#: Pages whose seller's number stands in one of the marked places, beside a relay.
PHONE_PAGES = """SELECT o_orderkey AS page_id, concat('<html>', CASE o_orderkey % 7 WHEN 0 THEN '<span itemprop="telephone">912 345 678</span>' WHEN 1 THEN '<meta property="og:phone_number" content="+351961234567">' WHEN 2 THEN '<span itemprop="phone" content="213456789"></span>'
  WHEN 3 THEN '<input type="hidden" name="telefone" value="931112223">' WHEN 4 THEN '<meta name="telefone" content="707123456">' WHEN 5 THEN '<p>Tel 213 456 780 ou 924 445 556</p>' ELSE '' END, '<a href="tel:+351661234567">x</a></html>') AS html FROM orders"""


def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def _landing(spark, sf):
    return landing.stored(landing.landed(landing.spread(view(spark, sf, PAYLOADS), "id")), _new(spark, "landing"))


def _mapped(spark, sf):
    return landing.stored(landing.mapped(_landing(spark, sf), FRAGMENTS, TOWNS), _new(spark, "mapped"))


def b49_source_mappers(spark, sf):
    """Listings of thirteen shapes of payload."""
    return landing.listings(_mapped(spark, sf)).drop("payload", "tags", "description", "first_name", "last_name", "birthday")


def b49_refused(spark, sf):
    return landing.refused_counts(_mapped(spark, sf))


def a1_payload_fields(spark, sf):
    return landing.payload_fields(_landing(spark, sf))


def _import_folder(spark, sf) -> str:
    """Orders as CSV files of two kinds: semicolons and headers of one language, commas and headers of another."""
    folder, rows = _new(spark, "imports"), view(spark, sf, IMPORTED)
    even = rows.where("k % 2 = 0").select(F.col("title").alias("Titulo"), F.col("zone").alias("Zona"), F.col("price").alias("Valor"), F.col("phone").alias("Telefone"), F.col("agency").alias("Agencia"), F.col("lead").alias("Tipo_Lead"), F.col("source").alias("Fonte"), F.col("wa").alias("WhatsApp"), F.col("area").alias("Area_m2"))
    odd = rows.where("k % 2 = 1").select(F.col("price"), "title", "zone", F.col("phone").alias("contact_phone"), F.col("owner").alias("is_owner"), F.col("agency").alias("agency_name"), F.lit("x").alias("unknown"), F.col("area"))
    even.write.csv(f"{folder}/a", header=True, sep=";", emptyValue="", quoteAll=True)
    odd.write.csv(f"{folder}/b", header=True, emptyValue="", quoteAll=True)
    return f"{folder}/*"


def a10_export_job(spark, sf):
    """Unique leads of a folder's files, counted by what all rows of a fingerprint have in common."""
    out = _new(spark, "export")
    imports.export_job(spark, _import_folder(spark, sf), out, FRAGMENTS)
    rows = spark.read.csv(out, header=True, escape='"')
    return rows.groupBy("typology", "zone").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("keys"), F.round(F.sum(F.bround(F.col("price").cast("double") / 1000)), 0).alias("thousands"))


def a10_job_counts(spark, sf):
    c = imports.export_job(spark, _import_folder(spark, sf), _new(spark, "export"), FRAGMENTS)
    return spark.createDataFrame([(c.read, c.refused["empty"], c.repeated, c.written)], "read long, empty long, repeated long, written long")


def b37_import_codes(spark, sf):
    """Rows of the imported files by lead type, source, owner and agency, as the label maps and rules have them."""
    rows = imports.normalized(imports.read_folder(spark, _import_folder(spark, sf)), FRAGMENTS).where("refused is null")
    return rows.groupBy("lead_type", "discovery_source", "is_owner", "owner_type", "agency_name", "phone_type", "contact_confidence").agg(F.count("*").alias("n"))


def b44_best_real_phone(spark, sf):
    pages = landing.spread(view(spark, sf, PHONE_PAGES), "page_id").select("page_id", html.page_phones(F.col("html")).alias("found"))
    return pages.select("page_id", html.best_real_phone(F.col("found")).alias("phone"), F.array_join("found", ",").alias("phones"))


def a17_state_rows(spark, sf):
    rows = landing.state_rows(view(spark, sf, STATE_PAGES))
    text = lambda c, path, kind: F.try_variant_get(c, path, kind)
    return rows.select("page_id", "kind", text("payload", "$.listID", "long").alias("list_id"), text("payload", "$.price", "double").alias("price"), text("seller", "$.name", "string").alias("seller"))


QUERIES = {f.__name__: f for f in (b49_source_mappers, b49_refused, a1_payload_fields, a10_export_job, a10_job_counts, b37_import_codes, b44_best_real_phone, a17_state_rows)}

_NUMBER = r"(9[1236][0-9] ?[0-9]{3} ?[0-9]{3})(?:[^0-9]|$)"
_GOODS = "source IN ('olx_marketplace', 'standvirtual')"
_FIRST = lambda *xs: "coalesce(" + ", ".join(f"nullif(trim({x}), '')" for x in xs) + ")"
_J = lambda f: f"j->>'$.{f}'"
#: The mappers' rules as a reader of the survey would put them, over the same payloads; \b and case as RE2 has them.
_MAPPED = rf"""p AS (SELECT id, source, CASE WHEN json_valid(raw_data) THEN raw_data::JSON END AS j FROM ({PAYLOADS})),
f AS (SELECT *, coalesce({_FIRST(_J("title"), f"left({_J('text')}, 200)")}, '') AS title0, regexp_replace(title0, '\s+', ' ', 'g') AS title, coalesce({_FIRST(_J("description"), _J("text"))}, '') AS body, {_FIRST(_J("agency_name"), _J("company"))} AS agency0,
  coalesce({_FIRST(_J("contact_name"), _J("name"), _J("author_name"))}, '') AS name, source = 'linkedin' AS post, source IN ('olx', 'imovirtual', 'idealista') AS portal, {_GOODS} AS goods,
  source IN ('novobanco_imoveis', 'leiloes', 'facebook_marketplace', 'portal_x') AS generic, CASE WHEN source = 'custojusto' THEN {_FIRST(_J("location_raw"), "j->>'$.locationNames.parish'")} WHEN source = 'linkedin' THEN {_FIRST(_J("location"))} ELSE {_FIRST(_J("location_raw"))} END AS loc,
  CASE WHEN source = 'custojusto' THEN {_FIRST(_J("location_raw"), "j->>'$.locationNames.district'", _J("zone_query"))} WHEN source = 'linkedin' THEN {_FIRST(_J("location"))} WHEN source IN ('novobanco_imoveis', 'leiloes', 'facebook_marketplace', 'portal_x') THEN {_FIRST(_J("location_raw"))} ELSE {_FIRST(_J("location_raw"), _J("zone_query"))} END AS place FROM p),
g AS (SELECT *, CASE WHEN goods OR source = 'custojusto' THEN NULL ELSE coalesce(agency0, '') END AS agency, title || CASE WHEN title <> '' OR body <> '' THEN ' ' ELSE '' END || body AS blob,
  CASE WHEN place IS NULL OR lower(place) = 'n/a' THEN 'Outra' WHEN contains(lower(place), 'lisboa') THEN 'Lisboa' WHEN contains(lower(place), 'cascais') OR contains(lower(place), 'estoril') THEN 'Cascais' WHEN contains(lower(place), 'almada') THEN 'Almada' ELSE upper(place[1]) || lower(place[2:]) END AS zone,
  CASE WHEN post THEN {_J("text")} WHEN source = 'custojusto' THEN {_FIRST(_J("price_raw"), _J("price"))} ELSE {_J("price_raw")} END AS price_text,
  CASE WHEN post THEN {_J("text")} WHEN source IN ('olx', 'idealista', 'sapo', 'custojusto') THEN {_FIRST(_J("area_raw"), "title")} ELSE {_J("area_raw")} END AS area_text,
  CASE WHEN source IN ('imovirtual', 'sapo') THEN {_FIRST(_J("typology_raw"), _J("rooms_raw"), "title")} WHEN source = 'idealista' THEN {_FIRST(_J("typology_raw"), "title")} WHEN post THEN {_J("text")} ELSE title END AS rooms,
  regexp_replace({_J("contact_phone")}, '[ +]', '', 'g') AS given, list_filter(string_split(loc, ','), lambda x: trim(x) <> '') AS parts FROM f),
h AS (SELECT *, regexp_replace(regexp_extract(price_text, '[0-9\s.,]+'), '[\s.]', '', 'g') AS price_digits, CASE WHEN goods THEN NULL ELSE TRY_CAST(regexp_extract(area_text, '(?i)([0-9]+[.,]?[0-9]*)\s*m', 1) AS DOUBLE) END AS area0,
  CASE WHEN regexp_matches(given, '^(351)?(21|66|91)[0-9]{{7}}$') THEN '+351' || right(given, 9) END AS phone_given,
  nullif('+351' || replace(regexp_extract(body, '{_NUMBER}', 1), ' ', ''), '+351') AS phone_body, nullif('+351' || replace(regexp_extract(replace(title, 'wa.me/351', ''), '{_NUMBER}', 1), ' ', ''), '+351') AS phone_title,
  CASE WHEN len(parts) >= 2 AND NOT regexp_matches(parts[-2], '[0-9]') THEN trim(parts[-2]) ELSE CASE zone WHEN 'Lisboa' THEN 'Lisboa' WHEN 'Cascais' THEN 'Cascais' WHEN 'Porto' THEN 'Porto' ELSE '' END END AS town,
  CASE WHEN len(parts) >= 3 AND NOT regexp_matches(parts[-2], '[0-9]') THEN trim(parts[-3]) ELSE '' END AS listed,
  CASE WHEN contains(lower(loc), 'cascais') THEN 'Cascais' WHEN contains(lower(loc), 'estoril') THEN 'Estoril' WHEN contains(lower(loc), 'lisboa') THEN 'Lisboa' WHEN contains(lower(loc), 'almada') THEN 'Almada' ELSE '' END AS known FROM g),
i AS (SELECT *, CASE WHEN area0 > 5 AND area0 < 50000 THEN area0 END AS area_m2, TRY_CAST(price_digits AS DOUBLE) AS price0, coalesce(phone_given, phone_body, CASE WHEN source IN ('olx', 'custojusto') OR goods THEN phone_title END) AS contact_phone,
  blob || ' ' || name || ' ' || coalesce(agency, '') AS words, CASE WHEN source = 'custojusto' THEN {_J("owner_type")} WHEN portal THEN {_J("owner_type_raw")} END AS said FROM h),
k AS (SELECT *, CASE WHEN price0 > 5000 AND price0 < 10000000 THEN price0 END AS price1, coalesce({_FIRST("CASE WHEN NOT post THEN " + _J("contact_email") + " ELSE " + _J("author_email") + " END")}, CASE WHEN portal OR goods OR source = 'sapo' THEN nullif(regexp_extract(body, '[a-z.]+@[a-z.-]+\.[a-z]+'), '') END) AS contact_email,
  CASE WHEN portal OR goods OR source = 'sapo' THEN coalesce(nullif('+351' || replace(regexp_extract(body, '(?i)whatsapp ([0-9 ]{{11}})', 1), ' ', ''), '+351'), CASE WHEN source = 'olx' THEN nullif('+351' || regexp_extract(title, 'wa.me/351([0-9]{{9}})', 1), '+351') END) END AS contact_whatsapp,
  CASE WHEN source = 'facebook_marketplace' THEN {_J("contact_messenger")} WHEN portal OR source = 'sapo' THEN nullif(regexp_extract(body, 'www\.([a-z0-9-]+\.pt)', 1), '') END AS contact_website,
  CASE WHEN goods OR source = 'facebook_marketplace' THEN 'fsbo' WHEN source = 'novobanco_imoveis' THEN 'agency' WHEN source = 'leiloes' THEN 'auction' WHEN said IN ('fsbo', 'agency', 'developer') THEN said WHEN agency <> '' THEN 'agency'
    WHEN regexp_matches(words, '(?i)empreiteiro|constru[çc]|obra nova|entrega [0-9]{{4}}') THEN 'developer' WHEN regexp_matches(words, '(?i)imobili[aá]ria|\bera\b') THEN 'agency' WHEN regexp_matches(words, '(?i)\bparticular\b|\bdono\b|sem comiss[aã]o') THEN 'fsbo' WHEN source IN ('custojusto', 'olx') THEN 'fsbo' ELSE 'unknown' END AS owner_type,
  CASE WHEN j IS NULL THEN 'unparsable' WHEN title = '' THEN 'no title' WHEN source = 'olx' AND (coalesce(area_m2 < 10, false) OR (regexp_matches(blob, '(?i)\bgaragem\b|\barrecada[çc]') AND NOT regexp_matches(blob, '(?i)\bapartamento\b|\bmoradia\b|\bquarto\b|\bandar\b|\bt[0-9]\b|habita[çc]'))) THEN 'not residential' END AS refused FROM i)"""
_CONDITION = r"CASE WHEN regexp_matches(lower(blob), '\bnovo\b') THEN 'novo' WHEN regexp_matches(lower(blob), 'para renovar|habitar e renovar') THEN 'renovar' WHEN contains(lower(blob), 'bom estado') THEN 'usado' ELSE 'desconhecido' END"

_IMPORTED_KEY = "CASE WHEN title LIKE 'T2%' THEN 'T2' WHEN title LIKE 'T1%' THEN 'T1' WHEN title LIKE 'Loja%' THEN 'Comercial' WHEN title LIKE 'Moradia%' THEN 'Moradia' ELSE 'Desconhecido' END AS typology, CASE zone WHEN '' THEN 'Outra' ELSE zone END AS zone, title, try_cast(price[1:3] AS INT) AS p"

ORACLE_SQL = {
    "b49_source_mappers": rf"""WITH {_MAPPED} SELECT id, source, title, CASE WHEN NOT goods THEN price1 END AS price, area_m2,
  CASE WHEN goods THEN NULL WHEN regexp_matches(rooms, '(?i)terreno|lote') THEN 'Terreno' WHEN regexp_matches(rooms, '(?i)loja') THEN 'Comercial' WHEN regexp_matches(rooms, '(?i)moradia|\bv\s*[1-9]\b') THEN 'Moradia' WHEN regexp_matches(rooms, '(?i)est[úu]dio') THEN 'T0'
    WHEN regexp_matches(rooms, '\bT[5-9]\b') THEN 'T5+' WHEN regexp_matches(rooms, '\bT[0-4]\b') THEN regexp_extract(rooms, '\bT[0-4]\b') ELSE 'Desconhecido' END AS typology,
  CASE WHEN NOT portal THEN NULL WHEN id % 5 = 0 THEN 'Apartamento' WHEN id % 5 = 1 THEN 'Moradia' WHEN regexp_matches(blob, '(?i)\bapartamento\b|\best[uú]dio\b') THEN 'Apartamento' WHEN regexp_matches(blob, '(?i)\bmoradia\b') THEN 'Moradia' WHEN regexp_matches(blob, '(?i)\bterreno\b') THEN 'Terreno' WHEN regexp_matches(blob, '(?i)\bloja\b') THEN 'Loja' WHEN regexp_matches(blob, '(?i)\bgaragem\b') THEN 'Garagem' ELSE '' END AS property_type,
  CASE WHEN goods THEN NULL WHEN generic THEN 'desconhecido' ELSE {_CONDITION} END AS condition, zone,
  CASE WHEN portal OR goods THEN town WHEN source = 'custojusto' THEN coalesce({_FIRST("j->>'$.locationNames.county'")}, zone) END AS municipality,
  CASE WHEN goods THEN listed WHEN portal THEN coalesce(nullif(listed, ''), known) WHEN source = 'custojusto' THEN coalesce({_FIRST("j->>'$.locationNames.parish'")}, known) ELSE known END AS parish,
  coalesce(loc, '') AS address, name AS contact_name, contact_phone, CASE WHEN contact_phone IS NULL THEN 'unknown' WHEN contact_phone LIKE '+3519%' THEN 'mobile' WHEN contact_phone LIKE '+3516%' THEN 'relay' ELSE 'landline' END AS phone_type,
  CASE WHEN contact_phone IS NULL THEN 0 WHEN contact_phone LIKE '+3519%' THEN 90 WHEN contact_phone LIKE '+3516%' THEN 50 ELSE 70 END AS contact_confidence, contact_email, contact_whatsapp, contact_website,
  coalesce(CASE WHEN portal OR goods THEN {_FIRST(_J("contact_source"))} END, CASE WHEN contact_phone IS NOT NULL OR ((portal OR source = 'sapo') AND coalesce(contact_email, contact_whatsapp, contact_website) IS NOT NULL) THEN source END) AS contact_source,
  CASE WHEN goods THEN NULL WHEN source = 'custojusto' THEN '' ELSE coalesce(agency, '') END AS agency_name, owner_type, owner_type IN ('fsbo', 'unknown') AS is_owner,
  CASE WHEN goods THEN 'active_owner' WHEN source = 'novobanco_imoveis' THEN 'bank_reo' WHEN source = 'leiloes' THEN 'auction' WHEN source = 'facebook_marketplace' THEN 'fsbo' WHEN owner_type = 'agency' THEN 'agency_listing' WHEN owner_type = 'developer' THEN 'developer_listing' WHEN contains(blob, 'arrendar') THEN 'frbo' WHEN owner_type = 'fsbo' THEN 'fsbo' ELSE 'unknown' END AS lead_type,
  CASE WHEN goods THEN title WHEN source = 'leiloes' THEN {_FIRST(_J("auction_status_raw"))} END AS product_title, CASE WHEN source = 'olx_marketplace' AND price1 < 50000 OR source = 'standvirtual' AND price1 < 500000 THEN price1 END AS product_value,
  {_J("url")} AS url, {_FIRST(_J("external_id"), _J("post_id"), _J("listID"))} AS external_id FROM k WHERE refused IS NULL""",
    "b49_refused": f"WITH {_MAPPED} SELECT source, count(*) AS n, count(*) FILTER (WHERE refused IS NULL) AS listings, count(*) FILTER (WHERE refused = 'unparsable') AS unparsable, count(*) FILTER (WHERE refused = 'no title') AS no_title, count(*) FILTER (WHERE refused = 'not residential') AS not_residential FROM k GROUP BY 1",
    "a1_payload_fields": f"SELECT source, field, count(*) AS n FROM (SELECT source, unnest(json_keys(raw_data::JSON)) AS field FROM ({PAYLOADS}) WHERE json_valid(raw_data)) GROUP BY 1, 2",
    "a10_export_job": f"SELECT typology, zone, count(*) AS n, count(*) AS keys, sum(p)::DOUBLE AS thousands FROM (SELECT DISTINCT {_IMPORTED_KEY} FROM ({IMPORTED}) WHERE k % 25 <> 0) GROUP BY 1, 2",
    "a10_job_counts": f"SELECT count(*) AS read, count(*) FILTER (WHERE k % 25 = 0) AS empty, count(*) FILTER (WHERE k % 25 <> 0) - written AS repeated, any_value(written) AS written FROM ({IMPORTED}), (SELECT count(*) AS written FROM (SELECT DISTINCT {_IMPORTED_KEY} FROM ({IMPORTED}) WHERE k % 25 <> 0)) GROUP BY written",
    "b37_import_codes": f"""SELECT CASE WHEN k % 2 = 1 THEN 'unknown' WHEN k % 6 = 0 THEN 'fsbo' WHEN k % 6 = 2 THEN 'developer_listing' ELSE 'unknown' END AS lead_type, CASE WHEN k % 2 = 1 THEN 'import' WHEN k % 10 = 0 THEN 'sapo' WHEN k % 10 = 2 THEN 'olx' WHEN k % 10 = 4 THEN 'jornal' ELSE 'import' END AS discovery_source,
  is_owner, CASE WHEN is_owner THEN 'fsbo' ELSE 'agency' END AS owner_type, CASE WHEN NOT is_owner AND agency NOT IN ('', 'Não') THEN agency END AS agency_name, CASE WHEN reach THEN 'mobile' ELSE 'unknown' END AS phone_type, CASE WHEN reach THEN 100 ELSE 0 END AS contact_confidence, count(*) AS n
  FROM (SELECT *, CASE WHEN k % 2 = 1 THEN owner = 'Sim' ELSE agency IN ('', 'Não') END AS is_owner, phone = '912 345 678' OR (k % 2 = 0 AND wa <> '') AS reach FROM ({IMPORTED}) WHERE k % 25 <> 0) GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "b44_best_real_phone": "SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN '+351912345678' WHEN 1 THEN '+351961234567' WHEN 2 THEN '+351213456789' WHEN 3 THEN '+351931112223' WHEN 5 THEN '+351924445556' END AS phone, CASE o_orderkey % 7 WHEN 0 THEN '+351912345678,' WHEN 1 THEN '+351961234567,' WHEN 2 THEN '+351213456789,' WHEN 3 THEN '+351931112223,' ELSE '' END || '+351661234567' || CASE o_orderkey % 7 WHEN 5 THEN ',+351213456780,+351924445556' ELSE '' END AS phones FROM orders",
    "a17_state_rows": f"SELECT page_id, kind, list_id, price, seller FROM (SELECT {_K} AS page_id, 'item' AS kind, {_K} AS list_id, 5.0::DOUBLE AS price, NULL AS seller FROM orders WHERE {_K} % 4 = 0 UNION ALL SELECT {_K}, 'item', {_K} + 1000000000, NULL, NULL FROM orders WHERE {_K} % 4 = 0 UNION ALL SELECT {_K}, 'detail', {_K}, 7.0, 'Eva ' || {_K} % 5 FROM orders WHERE {_K} % 4 = 1)",
}
