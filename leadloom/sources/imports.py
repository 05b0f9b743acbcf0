"""Files of leads to one clean file: folders of CSV files with headers of their own, rows by canonical names, first of each key, counters of the job.

The counters come from observations of the plan that writes, so the files are read once more only for their headers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import classify, contact, parse
from leadloom.functions.text import clean_text, present, split_name
from leadloom.operators.resolve import listing_key
from leadloom.sources.ingest import separator_of

# Headers and the fields that they name; labels of lead types and of sources.
HEADERS = {
    "nome": "contact_name", "telefone": "contact_phone", "tipo_telefone": "phone_type_label", "whatsapp": "whatsapp_url", "zona": "zone", "concelho": "municipality", "tipologia": "typology", "preco": "price_raw", "area_m2": "area_raw",
    "tipo_lead": "lead_type_label", "fonte": "source_label", "agencia": "agency_label", "titulo": "title", "url": "url", "data": "date_label", "dias_mercado": "days_on_market", "nome_completo": "contact_name",
    "primeiro_nome": "first_name", "apelido": "last_name", "email": "contact_email", "aniversario": "birthday", "aniversário": "birthday", "freguesia": "parish", "morada": "address", "tipo_imovel": "property_type",
    "tipo_imóvel": "property_type", "origem": "source_label", "valor": "price_raw", "contact_name": "contact_name", "contact_phone": "contact_phone", "contact_email": "contact_email", "zone": "zone",
    "municipality": "municipality", "parish": "parish", "address": "address", "typology": "typology", "price": "price", "area": "area_raw", "title": "title", "description": "description", "is_owner": "is_owner",
    "owner_type": "owner_type", "lead_type": "lead_type", "agency_name": "agency_name", "condition": "condition", "property_type": "property_type", "discovery_source": "discovery_source", "first_name": "first_name",
    "last_name": "last_name", "birthday": "birthday", "phone_type": "phone_type", "days_on_market": "days_on_market",
}
LEAD_TYPES = {
    "proprietário venda": "fsbo", "proprietario venda": "fsbo", "fsbo": "fsbo", "senhorio arrendamento": "frbo", "frbo": "frbo", "active owner": "active_owner", "proprietário activo": "active_owner", "proprietario activo": "active_owner",
    "agência": "agency_listing", "agencia": "agency_listing", "agency": "agency_listing", "promotor": "developer_listing", "developer": "developer_listing",
}
SOURCES = {"olx": "olx", "imovirtual": "imovirtual", "idealista": "idealista", "standvirtual": "standvirtual", "custojusto": "custojusto", "sapo": "sapo", "linkedin": "linkedin", "sapo casa": "sapo"}
NO_WORDS = ("não", "nao", "no", "")
YES_WORDS = ("true", "1", "yes", "sim")
FIELDS = tuple(dict.fromkeys(HEADERS.values()))


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """file and its first line, of all files of a folder or glob."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^﻿", "").alias("line"))
    return lines.where("at = 0").groupBy("file").agg(F.min_by("line", "n").alias("head"))


def mapped(rows: DataFrame) -> DataFrame:
    """Rows by the fields that their headers name, trimmed; of two headers for one field the last. Unknown headers are left out, fields without a header NULL."""
    named = {HEADERS[key]: c for c in rows.columns if (key := c.strip().lower().replace("﻿", "")) in HEADERS}
    return rows.select(*[F.trim(F.coalesce(F.col(f"`{named[f]}`").cast("string"), F.lit(""))).alias(f) if f in named else F.lit(None).cast("string").alias(f) for f in FIELDS], *[c for c in ("file", "row") if c in rows.columns])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all CSV files by canonical fields, with file and row (ascending within a file). Files with one header are one scan.

    The files' names and heads come to the driver, one line each.
    """
    groups: dict[str, list[str]] = {}
    for r in file_heads(spark, path).collect():
        groups.setdefault(r.head, []).append(r.file)
    out = None
    for head, files in sorted(groups.items()):
        rows = spark.read.csv(sorted(files), header=True, sep=separator_of([head]), multiLine=True, escape='"')
        part = mapped(rows.withColumns({"file": F.input_file_name(), "row": F.monotonically_increasing_id()}))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ", ".join(f"{f} string" for f in FIELDS) + ", file string, row long") if out is None else out


def coded(label: Column, codes: dict[str, str]) -> Column:
    """The code of a label without regard to case; NULL if it isn't known."""
    key = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(*[F.when(key.isin(*[k for k, v in codes.items() if v == code]), code) for code in dict.fromkeys(codes.values())])


def normalized(rows: DataFrame, zones: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Mapped rows as leads, with file, row, fingerprint, and refused (why a row is none, else NULL)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    first, last = split_name(text("contact_name"))
    number = contact.phone(F.col("contact_phone"))
    linked = contact.phone(F.nullif(F.regexp_extract(text("whatsapp_url"), r"351(\d{9})", 1), F.lit("")))
    rows = rows.withColumns({"own": number, "linked": linked, "zone_n": classify.zone(F.col("zone"), zones), "price_n": parse.listing_price(F.coalesce(full("price_raw"), F.col("price"))), "area_n": parse.listing_area(F.col("area_raw"))})
    agency = F.lower(F.trim(text("agency_label")))
    owner = F.when(F.col("is_owner").isNotNull(), F.lower("is_owner").isin(*YES_WORDS)).otherwise(agency.isin(*NO_WORDS))
    named_agency = F.coalesce(full("agency_label"), text("agency_name"))
    phone = F.when(F.col("own.valid"), F.col("own.canonical")).when(F.col("linked.valid"), F.col("linked.canonical"))
    source = F.lower(F.trim(text("source_label")))
    empty = ~F.greatest(*[present(F.col(f)) for f in FIELDS])
    rows = rows.select(
        text("title").alias("title"),
        F.coalesce(full("description"), text("title")).alias("description"),
        text("contact_name").alias("contact_name"),
        F.when(present(F.col("first_name")), F.col("first_name")).otherwise(F.nullif(first, F.lit(""))).alias("first_name"),
        F.when(present(F.col("first_name")), full("last_name")).otherwise(F.nullif(last, F.lit(""))).alias("last_name"),
        F.coalesce(phone, F.lit("")).alias("contact_phone"),
        F.when(F.col("own.valid"), F.coalesce(full("phone_type"), F.col("own.kind"))).when(F.col("linked.valid"), F.col("linked.kind")).otherwise("unknown").alias("phone_type"),
        full("contact_email").alias("contact_email"),
        full("birthday").alias("birthday"),
        F.col("price_n").alias("price"),
        F.col("area_n").alias("area_m2"),
        F.col("zone_n").alias("zone"),
        F.coalesce(full("municipality"), "zone_n").alias("municipality"),
        full("parish").alias("parish"),
        full("address").alias("address"),
        F.coalesce(full("typology"), classify.typology(F.col("title"))).alias("typology"),
        full("property_type").alias("property_type"),
        F.coalesce(full("lead_type"), coded(F.col("lead_type_label"), LEAD_TYPES), F.lit("unknown")).alias("lead_type"),
        F.coalesce(full("discovery_source"), coded(F.col("source_label"), SOURCES), F.nullif(source, F.lit("")), F.lit("import")).alias("discovery_source"),
        owner.alias("is_owner"),
        F.coalesce(full("owner_type"), F.when(owner, "fsbo").otherwise("agency")).alias("owner_type"),
        F.when(~owner & ~F.lower(named_agency).isin(*NO_WORDS), named_agency).alias("agency_name"),
        full("condition").alias("condition"),
        full("url").alias("url"),
        F.col("days_on_market").try_cast("int").alias("days_on_market"),
        F.lit("import").alias("contact_source"),
        F.when(phone.isNotNull(), 100).when(present(F.col("contact_email")), 70).when(present(F.col("contact_name")), 30).otherwise(0).alias("contact_confidence"),
        "file",
        "row",
        F.when(empty, "empty").alias("refused"),
    )
    return rows.withColumn("fingerprint", listing_key(clean_text(F.col("title")), F.col("typology"), F.col("zone"), F.col("price"), F.col("area_m2")))


@dataclass
class JobCounts:
    files: int = 0
    read: int = 0
    refused: dict[str, int] = field(default_factory=dict)
    repeated: int = 0
    written: int = 0


def export_job(spark: SparkSession, path: str, out: str, zones: Sequence[tuple[str, str]] = ()) -> JobCounts:
    """Reads a folder of CSV files, normalises, keeps the first row of each fingerprint (by file, then row) and writes one CSV table; what it counted on the way."""
    came, went = Observation(), Observation()
    rows = normalized(read_folder(spark, path), zones).observe(came, F.count("*").alias("read"), F.count_if(F.col("refused") == "empty").alias("empty"), F.approx_count_distinct("file", 0.01).alias("files"))
    kept = rows.where("refused is null").drop("refused")
    first = kept.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in kept.columns if c not in ("fingerprint", "file", "row")]), F.struct("file", "row")).alias("r"))
    first.select("fingerprint", "r.*").observe(went, F.count("*").alias("written")).write.mode("overwrite").option("escape", '"').csv(out, header=True)
    a, b = came.get, went.get
    return JobCounts(a["files"], a["read"], {"empty": a["empty"]}, a["read"] - a["empty"] - b["written"], b["written"])
