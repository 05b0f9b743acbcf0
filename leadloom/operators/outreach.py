"""Who to call and with what: contact lists, motives, company contacts, staged fills, record and signal filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import contact, parse
from leadloom.functions.text import fold, present
from leadloom.operators.kpi import count_if, has_phone, live

# Motives and their words, words of a move and of a new post, words of rented rooms, names of dealers, categories of goods, owners that aren't individuals.
MOTIVES = {
    "Heranca": ("heranca", "herdeiro", "herdeiros", "herdar"),
    "Divorcio": ("divorcio", "separacao", "separada", "separado"),
    "Emigracao": ("emigr", "mudar de pais", "partir para"),
    "Urgencia": ("urgente", "urgencia", "venda rapida", "30 dias"),
    "Obras": ("obra", "remodelar", "remodelacao", "restauro"),
    "Partilhas": ("partilha", "partilhas", "co-proprietario"),
    "Mudanca": ("mudanca de cidade", "transferi", "relocac"),
}
CITY_CHANGE = r"mudei[ -]para|mudei-me[ -]para|moving[ -]to|moved[ -]to|relocated[ -]to|relocation|relocating|agora[ -]em\b|now[ -]based[ -]in|saiu[ -]de\b|vou[ -]para\b|going[ -]to[ -]live|a[ -]viver[ -]em"
JOB_CHANGE = (
    r"nova[ -]oportunidade|new[ -]chapter|new[ -]role|new[ -]position|novo[ -]emprego|excited[ -]to[ -]join|thrilled[ -]to[ -]join|happy[ -]to[ -]announce|orgulhoso[ -]de[ -]anunciar"
    r"|comecei[ -](a[ -])?trabalhar|starting[ -]at|joined\b|nova[ -]fase|novo[ -]cap[ií]tulo|proud[ -]to[ -]announce"
)
ROOM = r"\bquarto\b|\bquartos\b|\bcama\b|\bcamas\b|\bvaga\s+em\b|\bquarto\s+partilhado\b"
GOODS = ("informática", "informatica", "electrónica", "electronica", "veículos", "veiculos", "emprego", "serviços", "servicos", "animais", "desporto", "moda", "lazer", "bebé", "bebe")
NOT_INDIVIDUAL = ("agency", "bank", "developer", "auction")


def motives(text: Column) -> Column:
    """The motives whose words a text holds, in order of the table."""
    t = fold(text)
    found = []
    for label, words in MOTIVES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        found.append(F.when(hit, label))
    return F.array_compact(F.array(*found))


def signal_type(snippet: Column) -> Column:
    """A move of city before a new post; NULL for neither."""
    t = F.coalesce(snippet, F.lit(""))
    return F.when(t.rlike(f"(?iu){CITY_CHANGE}"), "city_change").when(t.rlike(f"(?iu){JOB_CHANGE}"), "job_change")


def person(title: Column) -> tuple[Column, Column, Column]:
    """Name, role and company of a page title "Name - Role at Company | Site"."""
    plain = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*\|[^|]*$", ""))
    name = F.trim(F.substring_index(plain, " - ", 1))
    after = F.when(plain.contains(" - "), F.trim(F.regexp_extract(plain, r"^.*? - (.*)$", 1)))
    parts = F.split(after, r"(?i)\s+at\s+| @ ", 2)
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.when(plain.contains(" - ") & (F.length(name) > 2), name), none(F.try_element_at(parts, F.lit(1))), none(F.try_element_at(parts, F.lit(2)))


def first_url(sources: Column) -> Column:
    """The url of the first source that has one, else empty."""
    return F.coalesce(F.try_element_at(F.filter(sources, lambda s: present(s["url"])), F.lit(1))["url"], F.lit(""))


def goods_price(raw: Column, below: float, least: float = 0.0) -> Column:
    """An imported price of goods, NULL outside of [least, below)."""
    p = parse.import_price(raw)
    return F.when((p > 0) & (p >= least) & (p < below), p)


def in_zones(zone: Column, names: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Whether a zone is on the list or starts with one of the prefixes, without regard to case."""
    z = F.lower(F.trim(F.coalesce(zone, F.lit(""))))
    hit = z.isin(*[n.lower() for n in names])
    for p in prefixes:
        hit = hit | z.startswith(p.lower())
    return hit


def individual(super_seller: Column | None = None) -> Column:
    """A reachable seller who is no agency, bank, developer or auction house, nor sells like one."""
    kind = F.lower(F.coalesce("owner_type", F.lit("")))
    return has_phone() & ~kind.isin(*NOT_INDIVIDUAL) & ~F.coalesce(super_seller if super_seller is not None else F.lit(False), F.lit(False))


def rents_rooms(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(f"(?iu){ROOM}")


def good_records(rows: DataFrame, queried_zone: Column, refused_hosts: Sequence[str] = (), least_title: int = 5) -> DataFrame:
    """Rows with a title, of no goods category, not from a refused host, in the zone that was asked for. Columns: title, category, url, zone."""
    category = F.lower(F.coalesce("category", F.lit("")))
    goods = F.lit(False)
    for word in GOODS:
        goods = goods | category.contains(word)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/]+)", 1))
    foreign = F.lit(False)
    for h in refused_hosts:
        foreign = foreign | (host == h) | host.endswith(f".{h}")
    return rows.where((F.length(F.trim(F.coalesce("title", F.lit("")))) >= least_title) & ~goods & ~foreign & (fold(F.col("zone")) == fold(queried_zone)))


def flattened(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested listing records (JSON) as flat rows: place joined from its parts, owner type by the company flag; goods and short titles go."""
    schema = "title string, categoryName string, url string, listID long, price double, companyAd boolean, name string, locationNames struct<district:string,county:string,parish:string>"
    r = rows.select("id", F.from_json(payload, schema).alias("r")).select("id", "r.*")
    category = F.lower(F.coalesce("categoryName", F.lit("")))
    goods = F.lit(False)
    for word in GOODS:
        goods = goods | category.contains(word)
    full = lambda c: F.nullif(F.trim(F.col(f"locationNames.{c}")), F.lit(""))
    flat = r.where((F.length("title") >= 5) & ~goods)
    company = F.coalesce("companyAd", F.lit(False))
    return flat.select("id", "title", F.col("listID").cast("string").alias("external_id"), "price", F.concat_ws(", ", full("parish"), full("county"), full("district")).alias("location"), F.when(company, "agency").otherwise("fsbo").alias("owner_type"), F.when(company, F.col("name")).alias("agency_name"))


def filtered_signals(signals: DataFrame, kind: str | None = None, zone: str | None = None, source: str | None = None, score_min: int = 0) -> DataFrame:
    for column, value in (("signal_type", kind), ("zone", zone), ("source", source)):
        if value is not None:
            signals = signals.where(F.col(column) == value)
    return signals.where(F.col("signal_score") >= score_min)


def options(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of several columns in one pass: column, value, n."""
    pair = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pair).alias("p")).where("p.value is not null").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def activity(notes: DataFrame, leads: DataFrame) -> DataFrame:
    return notes.join(leads.select(F.col("id").alias("lead_id"), "zone", "score"), "lead_id").select("id", "lead_id", "note_type", "zone", "score")


def company_contacts(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads of an agency that lack a channel, with the agency's contacts (agency_name, phone, email, domain) where theirs are empty.

    The source and the confidence are set by the best channel gained.
    """
    c = companies.select("agency_name", F.col("phone").alias("new_phone"), F.col("email").alias("new_email"), F.col("domain").alias("new_site"))
    both = live(leads).where(present(F.col("agency_name"))).join(c, "agency_name")
    gains = {old: present(F.col(new)) & ~present(F.trim(F.coalesce(old, F.lit("")))) for old, new in (("contact_phone", "new_phone"), ("contact_email", "new_email"), ("contact_website", "new_site"))}
    any_gain = gains["contact_phone"] | gains["contact_email"] | gains["contact_website"]
    fill = [F.when(g, F.col(n)).otherwise(F.col(o)).alias(o) for (o, g), n in zip(gains.items(), ("new_phone", "new_email", "new_site"), strict=True)]
    confidence = F.when(gains["contact_phone"], 100).when(gains["contact_email"], 70).otherwise(40)
    return both.where(any_gain).select("id", *fill, F.substring(F.concat(F.lit("website:"), "new_site"), 1, 50).alias("contact_source"), confidence.alias("contact_confidence"))


def contacts_from_text(leads: DataFrame, text: Column) -> DataFrame:
    """Rows that lack a channel, with what their text holds for it, where the contact's source is the text."""
    number, mail, site = contact.best_phone(contact.phones_in_text(text)), contact.first(contact.emails_in_text(text)), contact.website_in_text(text)
    found = leads.where(~has_phone() | ~present(F.col("contact_email")) | ~present(F.col("contact_website"))).withColumns({"p": number, "m": mail, "w": site})
    fill = lambda old, new: F.when(present(F.col(old)), F.col(old)).otherwise(F.col(new)).alias(old)
    gained = (~has_phone() & F.col("p").isNotNull()) | (~present(F.col("contact_email")) & F.col("m").isNotNull()) | (~present(F.col("contact_website")) & F.col("w").isNotNull())
    return found.where(F.coalesce(gained, F.lit(False))).select("id", fill("contact_phone", "p"), fill("contact_email", "m"), fill("contact_website", "w"), F.lit("text").alias("contact_source"))


def backfilled(leads: DataFrame, unknown: str = "listagem") -> DataFrame:
    """Leads without a contact's source, chat number or website, with what their texts hold for them: id, the fields as they are then, and what changed.

    A lead without a source gets its portal's name and the confidence of the best channel that it has or gains, in the order telephone or chat
    (100), e-mail (70), website (40), name (30); a telephone and an e-mail are looked for only as far as no better channel is there.
    """
    rows = leads.where(F.col("contact_source").isNull() | F.col("contact_whatsapp").isNull() | F.col("contact_website").isNull())
    chat = F.coalesce(contact.listing_whatsapp(F.col("description")), contact.listing_whatsapp(F.col("title")))
    number = F.coalesce(contact.first(contact.phones_in_text(F.col("description"))), contact.first(contact.phones_in_text(F.col("title"))))
    rows = rows.withColumns({
        "new_chat": F.when(F.col("contact_whatsapp").isNull(), chat),
        "new_site": F.when(F.col("contact_website").isNull(), contact.website_in_text(F.col("description"))),
        "bare": F.col("contact_source").isNull(),
    })
    rows = rows.withColumns({"chat": F.coalesce("contact_whatsapp", "new_chat"), "site": F.coalesce("contact_website", "new_site")})
    rows = rows.withColumn("new_phone", F.when(F.col("bare") & ~has_phone() & ~present(F.col("chat")), number))
    reached = has_phone() | present(F.col("chat")) | F.col("new_phone").isNotNull()
    rows = rows.withColumn("new_email", F.when(F.col("bare") & ~reached & ~present(F.col("contact_email")), contact.listing_email(F.col("description"))))
    mailed = present(F.col("contact_email")) | F.col("new_email").isNotNull()
    best = F.when(reached, 100).when(mailed, 70).when(present(F.col("site")), 40).when(present(F.col("contact_name")), 30)
    rows = rows.withColumn("gained", F.when(F.col("bare"), best))
    return rows.select(
        "id", F.coalesce("new_phone", "contact_phone").alias("contact_phone"), F.coalesce("new_email", "contact_email").alias("contact_email"), F.col("chat").alias("contact_whatsapp"), F.col("site").alias("contact_website"),
        F.coalesce("contact_source", F.when(F.col("gained").isNotNull(), F.coalesce(F.nullif("discovery_source", F.lit("")), F.lit(unknown)))).alias("contact_source"), F.coalesce("gained", "contact_confidence").alias("contact_confidence"),
        F.col("gained").isNotNull().alias("new_source"), F.col("new_chat").isNotNull().alias("new_whatsapp"), F.col("new_site").isNotNull().alias("new_website"),
    )


def backfill_counts(rows: DataFrame) -> DataFrame:
    """One row: how many leads were looked at, gained a source, a chat number, a website, and were left as they were."""
    nothing = ~(F.col("new_source") | F.col("new_whatsapp") | F.col("new_website"))
    return rows.agg(F.count("*").alias("checked"), count_if(F.col("new_source"), "sources"), count_if(F.col("new_whatsapp"), "whatsapps"), count_if(F.col("new_website"), "websites"), count_if(nothing, "skipped"))


def recomputed(leads: DataFrame) -> DataFrame:
    """Confidence and quality of every row set anew from its fields, as one ladder each."""
    confidence = contact.contact_confidence(F.col("contact_phone"), F.col("contact_whatsapp"), F.col("contact_email"), F.col("contact_website"), F.col("contact_name"))
    quality = contact.lead_quality(has_phone() | present(F.col("contact_whatsapp")), present(F.col("contact_email")) | present(F.col("contact_website")), F.col("lead_type"))
    return leads.select("id", confidence.alias("contact_confidence"), quality.alias("lead_quality"))


def tiers(leads: DataFrame) -> DataFrame:
    """Rows by confidence tier, by the contact's source and by type, in one row."""
    n, s = F.coalesce("contact_confidence", F.lit(0)), F.coalesce("contact_source", F.lit(""))
    site, crossed = s.startswith("website:"), s.startswith("cross_portal:")
    return leads.agg(
        count_if(n >= 70, "high"), count_if(n == 30, "named"), count_if(n == 0, "none"), count_if(present(s) & ~site & ~crossed, "direct"), count_if(site, "website"), count_if(crossed, "crossed"),
        count_if(F.col("lead_type") == "fsbo", "fsbo"), count_if(F.col("lead_type") == "frbo", "frbo"), count_if(F.col("lead_type") == "agency_listing", "agency"),
    )


def unscored(leads: DataFrame) -> DataFrame:
    return leads.where(~F.col("archived") & F.col("score").isNull())


def hot_leads(leads: DataFrame, threshold: int = 60) -> DataFrame:
    return live(leads).where(F.col("score") >= threshold)


def confidence_shares(leads: DataFrame) -> DataFrame:
    """Rows by label and confidence, and their share of the label."""
    counts = live(leads).groupBy("score_label", F.coalesce("contact_confidence", F.lit(0)).alias("confidence")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("score_label")), 1))


def active_owners(leads: DataFrame) -> DataFrame:
    """Active owners by source: rows, reachable ones, mean score."""
    return live(leads).where(F.col("lead_type") == "active_owner").groupBy("discovery_source").agg(F.count("*").alias("n"), count_if(has_phone(), "with_phone"), F.round(F.avg("score"), 1).alias("avg_score"))


def system_counts(leads: DataFrame, raw: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of the tables in one row."""
    own = leads.agg(F.count("*").alias("leads"), count_if(F.col("is_demo"), "demo"), count_if(F.col("archived"), "archived"), count_if(has_phone(), "with_phone"))
    return own.join(raw.agg(F.count("*").alias("raw"))).join(notes.agg(F.count("*").alias("notes")))


def list_summary(rows: DataFrame) -> DataFrame:
    """The summary of a contact list: labels, owners and agencies, zones and sources."""
    label = F.col("score_label")
    agency = F.col("owner_type") == "agency"
    return rows.agg(F.count("*").alias("total"), count_if(label == "HOT", "hot"), count_if(label == "WARM", "warm"), count_if(label == "COLD", "cold"), count_if(~agency, "owners"), count_if(agency, "agencies"), F.count_distinct("zone").alias("zones"), F.count_distinct("discovery_source").alias("sources"))


def ranked(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows and their rank numbers; the window sees limit rows only."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_score_with_phone(leads: DataFrame, limit: int = 20) -> DataFrame:
    return leads.where(has_phone() & F.col("score").isNotNull()).orderBy(F.desc("score"), "id").limit(limit)


def hot_opportunities(leads: DataFrame, limit: int = 10) -> DataFrame:
    return live(leads).where(F.col("score_label") == "HOT").orderBy(F.desc("score"), F.desc("last_seen_at"), "id").limit(limit)


def best_signals(signals: DataFrame, limit: int = 50) -> DataFrame:
    return signals.orderBy(F.desc("signal_score"), F.desc("created_at"), "id").limit(limit)


def sweep_page(leads: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """The rows that were seen longest ago."""
    return live(leads).orderBy("last_seen_at", "id").offset(offset).limit(limit)


def drop_payload(drops: DataFrame, old: str = "old_price", new: str = "new_price") -> DataFrame:
    """Per cent of a price drop, to one decimal, and a line that says so."""
    pct = F.round(F.abs((F.col(new) - F.col(old)) / F.col(old) * 100), 1)
    return drops.withColumn("drop_pct", pct).withColumn("subject", F.concat(F.lit("-"), F.format_string("%.1f", pct), F.lit("%")))
