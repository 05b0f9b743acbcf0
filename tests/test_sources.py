"""Payload mappers and import jobs on the shapes of the survey's fixtures."""

import json

import pytest

from leadloom.plans.text_queries import FRAGMENTS
from leadloom.sources import imports, landing


def mapped(spark, rows):
    raw = spark.createDataFrame([(k, s, p if isinstance(p, str) or p is None else json.dumps(p)) for k, (s, p) in enumerate(rows)], "id long, source string, raw_data string")
    return {r.id: r for r in landing.mapped(landing.landed(raw), FRAGMENTS, (("Lisboa", "Lisboa"),)).drop("payload").collect()}


def test_portal_payload(spark):
    base = {"title": "T2 Lisboa Alvalade excelente localização", "price_raw": "195.000 €", "area_raw": "78 m²", "location_raw": "Lisboa, Alvalade", "url": "https://x.pt/d/t2-IDabc123.html", "external_id": "abc123", "contact_phone": "912345678", "description": "Ótimo apartamento", "agency_name": ""}
    r = mapped(spark, [("olx", base), ("olx", {**base, "title": "  "}), ("olx", {**base, "title": "Garagem box", "description": ""}), ("idealista", {**base, "typology_raw": "T3"}), ("olx", "{bad"), ("olx", None)])
    assert (r[0].price, r[0].area_m2, r[0].typology, r[0].zone, r[0].contact_phone, r[0].phone_type) == (195000.0, 78.0, "T2", "Lisboa", "+351912345678", "mobile")
    assert (r[0].owner_type, r[0].is_owner, r[0].contact_source, r[0].refused) == ("fsbo", True, "olx", None)
    assert [r[k].refused for k in range(1, 6)] == ["no title", "not residential", None, "unparsable", "unparsable"] and r[3].typology == "T3"


def test_overrides_and_unknown_sources(spark):
    base = {"title": "Moradia T4", "price_raw": "300.000", "location_raw": "Cascais", "contact_phone": "211234567"}
    r = mapped(spark, [("cgd_imoveis", base), ("leiloes", {**base, "auction_status_raw": "aberto"}), ("facebook_marketplace", {**base, "contact_messenger": "m.me/9"}), ("nova", base), ("olx_marketplace", {"title": "Sofá", "price_raw": "6.000 €", "location_raw": "Almada"}),
                       ("linkedin", {"text": "Vendo T1 em Lisboa por 150.000 euros, 912 345 678", "location": "Lisboa", "author_name": "Rui Costa", "post_id": 7})])
    assert [(r[k].owner_type, r[k].lead_type, r[k].is_owner) for k in range(4)] == [("agency", "bank_reo", False), ("auction", "auction", False), ("fsbo", "fsbo", True), ("unknown", "unknown", True)]
    assert r[1].product_title == "aberto" and r[2].contact_website == "m.me/9" and r[3].contact_source == "nova"
    assert (r[4].price, r[4].product_value, r[4].lead_type, r[4].typology) == (None, 6000.0, "active_owner", None)
    assert (r[5].title, r[5].typology, r[5].contact_name, r[5].first_name, r[5].external_id, r[5].contact_phone) == ("Vendo T1 em Lisboa por 150.000 euros, 912 345 678", "T1", "Rui Costa", "Rui", "7", "+351912345678")


def test_unknown_fields_survive_and_lists_are_rows(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a", '[{"title":"x","new":{"deep":[1,2]}},{"title":"y"}]'), (2, "a", '{"title":"z"}'), (3, "b", "{bad")], "id long, source string, raw_data string")
    items = landing.payload_items(landing.stored(landing.landed(raw), f"file://{tmp_path}/landing"))
    assert sorted((r.id, r.t) for r in items.selectExpr("id", "try_variant_get(payload, '$.title', 'string') AS t").collect() if r.t) == [(1, "x"), (1, "y"), (2, "z")]
    assert items.where("id = 1").selectExpr("try_variant_get(payload, '$.new.deep[1]', 'int') AS v").where("v = 2").count() == 1
    assert {(r.source, r.field, r.n) for r in landing.payload_fields(items).collect()} == {("a", "title", 3), ("a", "new", 1)}
    assert "new" in landing.payload_schemas(items).first().schema


def test_state_blocks(spark):
    page = lambda props: f'<script id="__NEXT_DATA__" type="x">{json.dumps({"props": {"pageProps": props}})}</script>'
    pages = spark.createDataFrame([(1, page({"listItems": [{"title": "a"}, {"title": "b"}]})), (2, page({"adData": {"title": "c"}, "userData": {"name": "Eva"}})), (3, "<p>none"), (4, '<script id="__NEXT_DATA__">{x</script>')], "page_id long, html string")
    rows = landing.state_rows(pages).selectExpr("page_id", "kind", "try_variant_get(payload, '$.title', 'string') AS t", "try_variant_get(seller, '$.name', 'string') AS s").collect()
    assert sorted(map(tuple, rows)) == [(1, "item", "a", None), (1, "item", "b", None), (2, "detail", "c", "Eva")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Titulo;Zona;Valor;Telefone;Tipo_Lead;Fonte;Agencia\nT2 centro;Lisboa;250.000 €;912345678;Senhorio arrendamento;Sapo Casa;Não\n;;;;;;\nT2 centro;Lisboa;250.200 €;;promotor;Jornal;Casa Lda\n", encoding="utf-8-sig")
    (tmp_path / "in" / "b.csv").write_text('title,zone,price,contact_phone,is_owner,agency_name\n"T2 centro",Lisboa,250.000,123,false,Era\n"Quinta, grande",Almada,900.000,,yes,\n')
    (tmp_path / "in" / "c.csv").write_text("x,y\n1,2\n")
    return f"file://{tmp_path}/in"


def test_import_job(spark, folder, tmp_path):
    counts = imports.export_job(spark, folder, f"file://{tmp_path}/out", FRAGMENTS)
    assert counts == imports.JobCounts(3, 6, {"empty": 2}, 2, 2)
    rows = {r.title: r for r in spark.read.csv(f"file://{tmp_path}/out", header=True, escape='"').collect()}
    first = rows["T2 centro"]
    assert (first.contact_phone, first.lead_type, first.discovery_source, first.owner_type, first.contact_confidence) == ("+351912345678", "frbo", "sapo", "fsbo", "100")
    assert (rows["Quinta, grande"].zone, rows["Quinta, grande"].price, rows["Quinta, grande"].is_owner) == ("Almada", "900000.0", "true")


def test_empty_folder_of_rows(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text("title;zona\n")
    assert imports.export_job(spark, f"file://{tmp_path}/e", f"file://{tmp_path}/o", FRAGMENTS).written == 0


def test_a_small_file_is_mapped_by_many_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    rows = landing.spread(spark.read.parquet(f"file://{tmp_path}/one"), "id")
    assert rows.rdd.glom().filter(bool).count() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in rows.collect()) == list(range(1000))
