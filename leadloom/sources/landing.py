"""Raw payloads of many sources in one VARIANT column, and the mappers that make canonical listings of them.

Each source has a payload shape of its own, and shapes change. A VARIANT column holds them all, typed but without a schema, so
fields that no mapper knows stay in the landing table. A mapper is data: for each canonical field the JSON paths that may
hold it, best first, and the rules by which its source departs from the common ones. All sources are mapped in one pass over
the landing table, a CASE by source per field, so a new source costs neither a scan nor a union.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import classify, contact, parse
from leadloom.functions.text import clean_text, present, split_name
from leadloom.sources.html import NEXT_DATA

Paths = tuple[str, ...]


@dataclass(frozen=True)
class Mapper:
    """Paths of a source's fields, best first, and its rules. An empty path list leaves the field empty."""

    title: Paths = ("$.title",)
    text: Paths = ("$.description",)
    price: Paths = ("$.price_raw",)
    area: Paths = ("$.area_raw",)
    rooms: Paths = ()
    location: Paths = ("$.location_raw",)
    place: Paths = ("$.location_raw", "$.zone_query")
    town: Paths = ()
    parish: Paths = ()
    url: Paths = ("$.url",)
    external_id: Paths = ("$.external_id",)
    name: Paths = ("$.contact_name",)
    agency: Paths = ("$.agency_name",)
    owner: Paths = ()
    phone: Paths = ("$.contact_phone",)
    email: Paths = ("$.contact_email",)
    whatsapp: Paths = ()
    website: Paths = ()
    origin: Paths = ()
    goods_value: Paths = ()
    #: A field that only shows: the status of an auction.
    product: Paths = ()
    #: Rules: what else is searched if a field is empty.
    area_in_title: bool = False
    phone_in_title: bool = False
    whatsapp_in_title: bool = False
    channels_in_text: bool = False
    website_in_text: bool = False
    #: How a comma list of the location is read: "list" (town and parish, else the known place), "goods" (town and parish), "" (parish only).
    split_location: str = ""
    #: Any channel names the source as the contact's origin, not only a telephone.
    any_origin: bool = False
    residential: bool = False
    has_condition: bool = True
    has_property_type: bool = False
    #: Goods: no property, the price below this bound is the goods' value, the seller is an active owner.
    goods_below: float | None = None
    #: Fixed owner and lead type; the source's word overrides the texts.
    owner_type: str = ""
    lead_type: str = ""
    #: The title is cut from the text's head if there is none.
    title_from_text: int = 0


_PORTAL = Mapper(channels_in_text=True, website_in_text=True, any_origin=True, whatsapp=("$.contact_whatsapp",), website=("$.contact_website",), origin=("$.contact_source",), owner=("$.owner_type_raw",), split_location="list", has_property_type=True)
_GOODS = Mapper(channels_in_text=True, phone_in_title=True, whatsapp=("$.contact_whatsapp",), origin=("$.contact_source",), agency=(), split_location="goods", has_condition=False, goods_below=50_000, owner_type="fsbo", lead_type="active_owner")
GENERIC = Mapper(place=("$.location_raw",), has_condition=False)
_BANK = replace(GENERIC, owner_type="agency", lead_type="bank_reo")

#: Mappers by source code; sources that aren't here are mapped by GENERIC.
MAPPERS: dict[str, Mapper] = {
    "olx": replace(_PORTAL, area_in_title=True, phone_in_title=True, whatsapp_in_title=True, residential=True),
    "olx_marketplace": _GOODS,
    "standvirtual": replace(_GOODS, goods_below=500_000, goods_value=("$.product_value",)),
    "imovirtual": replace(_PORTAL, rooms=("$.typology_raw", "$.rooms_raw")),
    "idealista": replace(_PORTAL, area_in_title=True, rooms=("$.typology_raw",)),
    "sapo": replace(_PORTAL, area_in_title=True, rooms=("$.typology_raw", "$.rooms_raw"), origin=(), owner=(), split_location="", has_property_type=False),
    "custojusto": Mapper(price=("$.price_raw", "$.price"), area_in_title=True, phone_in_title=True, town=("$.municipality", "$.locationNames.county"), parish=("$.parish", "$.locationNames.parish"),
                         location=("$.location_raw", "$.locationNames.parish"), place=("$.location_raw", "$.locationNames.district", "$.zone_query"), name=("$.contact_name", "$.name"),
                         agency=(), owner=("$.owner_type",), external_id=("$.external_id", "$.listID"), split_location="given"),
    "linkedin": Mapper(title_from_text=200, text=("$.text",), price=("$.text",), area=("$.text",), rooms=("$.text",), location=("$.location",), place=("$.location",), name=("$.author_name",),
                       agency=("$.company",), email=("$.author_email",), external_id=("$.post_id",)),
    **dict.fromkeys(("cgd_imoveis", "millennium_imoveis", "novobanco_imoveis", "santander_imoveis"), _BANK),
    "leiloes": replace(GENERIC, owner_type="auction", lead_type="auction", product=("$.auction_status_raw",)),
    "facebook_marketplace": replace(GENERIC, owner_type="fsbo", lead_type="fsbo", website=("$.contact_messenger",)),
}
# Sources whose unmarked sellers are owners, or agencies.
OWNER_SOURCES, AGENCY_SOURCES = ("custojusto", "olx"), ("era", "remax", "century21")


def landed(rows: DataFrame, raw: str = "raw_data") -> DataFrame:
    """rows with payload, the JSON text as VARIANT; NULL where it can't be parsed."""
    return rows.withColumn("payload", F.try_parse_json(raw)).drop(raw)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over four tasks a core: parsing and mapping cost far more than reading, and a small file alone would be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def stored(rows: DataFrame, path: str) -> DataFrame:
    """rows as a table at path, read again.

    Landed payloads are stored before they are mapped, and mapped rows before their listings are taken: a filter on a derived column
    would be pushed below the mapping with copies of all that it rests on, down to the parsing of the payload.
    """
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def payload_items(landing: DataFrame) -> DataFrame:
    """A payload that is a list is one row per element; others stay."""
    is_list = F.schema_of_variant("payload").startswith("ARRAY")
    items = F.try_variant_get("payload", "$", "array<variant>")
    exploded = F.explode_outer(F.when(is_list, items).otherwise(F.array("payload")))
    return landing.select(*[c for c in landing.columns if c != "payload"], exploded.alias("payload"))


def payload_schemas(landing: DataFrame) -> DataFrame:
    """Per source its rows and the schema that holds all its payloads."""
    return landing.where("payload is not null").groupBy("source").agg(F.count("*").alias("n"), F.expr("schema_of_variant_agg(payload)").alias("schema"))


def payload_fields(landing: DataFrame) -> DataFrame:
    """Per source and top field, known to a mapper or not: how many payloads hold it."""
    fields = landing.lateralJoin(landing.sparkSession.tvf.variant_explode_outer(F.col("payload").outer())).where("key is not null")
    return fields.groupBy("source", F.col("key").alias("field")).agg(F.count("*").alias("n"))


def state_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """The state block of a page as payloads: each item of its list, or the advertisement of a detail page with its seller (kind: item, detail).

    A block that can't be parsed, or a page without one, gives no row.
    """
    props = F.try_parse_json(F.regexp_extract(html, NEXT_DATA, 1))
    at = lambda path, kind="variant": F.try_variant_get("state", f"$.props.pageProps.{path}", kind)
    detail = F.when(at("adData").isNotNull(), F.struct(F.lit("detail").alias("kind"), at("adData").alias("payload"), at("userData").alias("seller")))
    items = F.transform(F.coalesce(at("listItems", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.struct(F.lit("item").alias("kind"), x.alias("payload"), F.lit(None).cast("variant").alias("seller")))
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, props.alias("state")).select(*keep, F.explode(F.array_compact(F.concat(items, F.array(detail)))).alias("r"))
    return rows.select(*keep, "r.*")


def _take(paths: Paths) -> Column:
    """The first of the paths whose value isn't empty, as text."""
    found = [F.nullif(F.trim(F.try_variant_get("payload", p, "string")), F.lit("")) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


class _Rules:
    """The mappers' fields and flags as columns: one branch for all sources that agree."""

    def __init__(self, mappers: dict[str, Mapper], generic: Mapper):
        self.mappers, self.generic = mappers, generic

    def by_source(self, of: Callable[[Mapper], object], column: Callable[[object], Column]) -> Column:
        default, groups = of(self.generic), {}
        for name, mapper in self.mappers.items():
            groups.setdefault(of(mapper), []).append(name)
        out = None
        for value, names in groups.items():
            if value != default:
                test = F.col("source").isin(*names)
                out = F.when(test, column(value)) if out is None else out.when(test, column(value))
        return column(default) if out is None else out.otherwise(column(default))

    def field(self, name: str) -> Column:
        return self.by_source(lambda m: getattr(m, name), _take)

    def value(self, name: str) -> Column:
        return self.by_source(lambda m: getattr(m, name), F.lit)


_FIELDS = ("title", "text", "price", "area", "rooms", "location", "place", "town", "parish", "url", "external_id", "name", "agency", "owner", "phone", "email", "whatsapp", "website", "origin", "goods_value", "product")
_RULES = ("area_in_title", "phone_in_title", "whatsapp_in_title", "channels_in_text", "website_in_text", "split_location", "any_origin", "residential", "has_condition", "has_property_type", "goods_below", "owner_type", "lead_type", "title_from_text")

#: Columns of a canonical listing besides id, source and payload.
CANONICAL = (
    "title", "description", "price", "area_m2", "typology", "property_type", "condition", "zone", "municipality", "parish", "address", "contact_name", "first_name", "last_name", "birthday", "contact_phone", "phone_type",
    "contact_confidence", "contact_email", "contact_whatsapp", "contact_website", "contact_source", "agency_name", "owner_type", "is_owner", "lead_type", "product_title", "product_value", "tags", "url", "external_id",
)


def mapped(landing: DataFrame, zones: Sequence[tuple[str, str]] = (), towns: Sequence[tuple[str, str]] = (), mappers: dict[str, Mapper] = MAPPERS, generic: Mapper = GENERIC) -> DataFrame:
    """id, source, the canonical columns, refused (why a row is no listing, else NULL) and payload, of rows id, source, payload.

    zones are fragments of places with their zones, towns a zone's main town. A refused row keeps its columns.
    """
    rules = _Rules(mappers, generic)
    rows = landing.select("id", "source", "payload", *[rules.field(f).alias(f) for f in _FIELDS], *[rules.value(r).alias(f"is_{r}") for r in _RULES], _take(("$.birthday",)).alias("birthday"))
    flag = lambda r: F.col(f"is_{r}")
    rows = rows.withColumns({"text": clean_text(F.col("text")), "name": clean_text(F.col("name")), "agency": clean_text(F.col("agency"))})
    rows = rows.withColumn("title", clean_text(F.coalesce("title", F.when(flag("title_from_text") > 0, F.expr("left(text, is_title_from_text)")))))
    goods = flag("goods_below").isNotNull()
    zone = classify.zone(F.col("place"), zones)
    default_town = F.coalesce(*[F.when(F.col("zone") == z, t) for z, t in towns], F.lit(""))
    rows = rows.withColumns({"zone": zone, "area_m2": F.when(~goods, parse.listing_area(F.coalesce("area", F.when(flag("area_in_title"), F.col("title")))))})
    town, listed_parish = classify.municipality(F.col("location"), default_town)
    known_parish = classify.longest_fragment(F.col("location"), [f for f, _ in zones]) if zones else F.lit("")
    listed = flag("split_location").isin("list", "goods")
    rows = rows.withColumns({
        "municipality": F.when(listed, town).when(flag("split_location") == "given", F.coalesce("town", "zone")),
        "parish": F.when(flag("split_location") == "goods", listed_parish).when(listed, F.coalesce(F.nullif(listed_parish, F.lit("")), known_parish)).otherwise(F.coalesce("parish", known_parish)),
        "both": F.concat_ws(" ", "title", "text"),
        "contact_phone": F.coalesce(contact.phone(F.col("phone"))["canonical"], contact.first(contact.phones_in_text(F.col("text"))), F.when(flag("phone_in_title"), contact.first(contact.phones_in_text(F.col("title"))))),
        "contact_email": F.coalesce("email", F.when(flag("channels_in_text"), contact.listing_email(F.col("text")))),
        "contact_whatsapp": F.coalesce("whatsapp", F.when(flag("channels_in_text"), F.coalesce(contact.listing_whatsapp(F.col("text")), F.when(flag("whatsapp_in_title"), contact.listing_whatsapp(F.col("title")))))),
        "contact_website": F.left(F.coalesce("website", F.when(flag("website_in_text"), contact.website_in_text(F.col("text")))), F.lit(200)),
    })
    owner = classify.owner_type(F.concat_ws(" ", "both", "name", "agency"), F.col("agency"), F.col("source"), F.col("owner"), OWNER_SOURCES, AGENCY_SOURCES)
    rows = rows.withColumn("seller", F.coalesce(F.nullif(flag("owner_type"), F.lit("")), owner))
    number = contact.phone(F.col("contact_phone"))
    asking = parse.listing_price(F.col("price"))
    any_channel = F.coalesce("contact_phone", "contact_email", "contact_whatsapp", "contact_website").isNotNull()
    value = F.coalesce(F.col("goods_value").try_cast("double"), F.when(parse.listing_price(F.col("price")) < flag("goods_below"), parse.listing_price(F.col("price"))))
    first, last = split_name(F.col("name"))
    refused = (
        F.when(F.col("payload").isNull(), "unparsable")
        .when(~present(F.col("title")), "no title")
        .when(flag("residential") & ~classify.is_residential(F.col("both"), F.col("area_m2")), "not residential")
    )
    columns = {
        "title": F.col("title"),
        "description": F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("title")),
        "price": F.when(~goods, parse.listing_price(F.col("price"))),
        "area_m2": F.col("area_m2"),
        "typology": F.when(~goods, classify.typology(F.coalesce("rooms", "title"))),
        "property_type": F.when(flag("has_property_type"), classify.property_type(F.col("both"), F.col("url"))),
        "condition": F.when(flag("has_condition"), classify.condition(F.col("both"))).when(~goods, "desconhecido"),
        "zone": F.col("zone"),
        "municipality": F.col("municipality"),
        "parish": F.col("parish"),
        "address": clean_text(F.col("location")),
        "contact_name": F.col("name"),
        "first_name": first,
        "last_name": last,
        "birthday": F.col("birthday"),
        "contact_phone": F.col("contact_phone"),
        "phone_type": F.when(F.col("contact_phone").isNotNull(), number["kind"]).otherwise("unknown"),
        "contact_confidence": F.when(F.col("contact_phone").isNotNull(), number["confidence"]).otherwise(0),
        "contact_email": F.col("contact_email"),
        "contact_whatsapp": F.col("contact_whatsapp"),
        "contact_website": F.col("contact_website"),
        "contact_source": F.coalesce("origin", F.when(F.when(flag("any_origin"), any_channel).otherwise(F.col("contact_phone").isNotNull()), F.col("source"))),
        "agency_name": F.when(~goods, F.col("agency")),
        "owner_type": F.col("seller"),
        "is_owner": F.col("seller").isin("fsbo", "unknown"),
        "lead_type": F.coalesce(F.nullif(flag("lead_type"), F.lit("")), classify.lead_type(F.col("seller"), F.col("both"))),
        "product_title": F.when(goods, F.col("title")).otherwise(F.col("product")),
        "product_value": F.when(goods, value),
        "tags": F.array_join(classify.tags(F.col("both"), classify.AMENITIES), ","),
        "url": F.col("url"),
        "external_id": F.col("external_id"),
    }
    return rows.select("id", "source", *[c.alias(n) for n, c in columns.items()], refused.alias("refused"), "payload")


def listings(rows: DataFrame) -> DataFrame:
    """The rows, mapped and stored, that are listings."""
    return rows.where("refused is null").drop("refused")


def refused_counts(rows: DataFrame) -> DataFrame:
    """Per source its rows, listings, and refused rows by reason, in one pass."""
    why = ("unparsable", "no title", "not residential")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("refused").isNull()).alias("listings"), *[F.count_if(F.col("refused") == w).alias(w.replace(" ", "_")) for w in why])
