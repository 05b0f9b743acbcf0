"""What stored pages and nested records hold: embedded JSON, telephones, ids, links."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import COUNTRY, best_phone, phones_in_text, valid_phones
from leadloom.functions.text import present

LD_JSON = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"
NEXT_DATA = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
LD_SCHEMA = "name string, description string, sku string, offers string"


def embedded(pages: DataFrame, html: str = "html") -> DataFrame:
    """price, currency, place, description and sku from the first ld+json block of each page; lists and graphs give their first node."""
    block = F.regexp_extract(html, LD_JSON, 1)
    node = F.coalesce(F.get_json_object(block, "$.@graph[0]"), F.get_json_object(block, "$[0]"), block)
    offer = F.coalesce(F.get_json_object(node, "$.offers[0]"), F.get_json_object(node, "$.offers"))
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.get_json_object(offer, "$.price").try_cast("double").alias("price"),
        F.get_json_object(offer, "$.priceCurrency").alias("currency"),
        F.get_json_object(offer, "$.areaServed.name").alias("place"),
        F.substring(F.get_json_object(node, "$.description"), 1, 4000).alias("description"),
        F.get_json_object(node, "$.sku").alias("sku"),
    )


def next_items(pages: DataFrame, schema: str, path: str = "$.props.pageProps.listItems", html: str = "html") -> DataFrame:
    """The items of a page's state block, one row each."""
    items = F.from_json(F.get_json_object(F.regexp_extract(html, NEXT_DATA, 1), path), f"array<struct<{schema}>>")
    return pages.select(*[c for c in pages.columns if c != html], F.explode(items).alias("item")).select("*", "item.*").drop("item")


def gap_filled(rows: DataFrame, found: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Empty columns filled from found; full ones stay."""
    joined = rows.alias("r").join(found.alias("f"), key, "left")
    return joined.select(key, *[F.when(present(F.col(f"r.{c}").cast("string")), F.col(f"r.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in columns])


def listing_id(url: Column) -> Column:
    """The id in a url: after -ID, in digits at the end, else its last path part."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"-ID([A-Za-z0-9]+)\.html", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"(\d{5,})(?:\.html)?/?$", 1), F.lit("")), F.substring(F.regexp_extract(url, r"([^/?#]*)/?(?:[?#].*)?$", 1), 1, 100))


def page_phones(html: Column, relays: bool = True) -> Column:
    """Valid numbers in order of trust: message links, marked elements, data attributes, hidden inputs and meta tags, JSON keys, scripts, links, all text.

    Without relays, numbers of the portals' own ranges that only pass a call on are left out.
    """
    h = F.coalesce(html, F.lit(""))
    take = lambda p: F.regexp_extract_all(h, F.lit(p), 1)
    marked = r"""(?i)<[^>]*\bitemprop=["'](?:telephone|phone)["'][^>]*"""
    passes = [
        F.transform(take(r"(?i)wa\.me/\+?(\d{9,12})"), lambda x: F.right(x, F.lit(9))),
        take(marked + r"""\bcontent=["']([^"']+)"""),
        take(marked + r""">\s*([^<]+)<"""),
        take(r"""(?i)data-(?:phone|tel|telephone|mobile|contact|seller-phone|number)=["']([^"']+)"""),
        take(r"""(?i)<input[^>]*name=["'][^"']*(?:phone|telef)[^"']*["'][^>]*value=["']([^"']+)"""),
        take(r"""(?i)<meta[^>]*\b(?:property|name)=["'][^"']*(?:phone|telef)[^"']*["'][^>]*\bcontent=["']([^"']+)"""),
        take(r'(?i)"(?:phone|telephone|phoneNumber|mobile)"\s*:\s*"([^"]+)"'),
        take(r"""(?i)(?:sellerPhone|phone(?:Number)?|telephone)["']?\s*[:=]\s*["']([^"']+)"""),
        take(r"(?i)href=[\"'](?:tel|callto):([^\"']+)"),
    ]
    found = F.array_distinct(F.concat(valid_phones(F.concat(*passes)), phones_in_text(F.regexp_replace(F.regexp_replace(h, r"(?is)<script.*?</script>", " "), "<[^>]*>", " "))))
    return found if relays else without_relays(found)


def without_relays(phones: Column) -> Column:
    return F.filter(phones, lambda x: ~x.startswith(f"{COUNTRY}6"))


def best_real_phone(phones: Column) -> Column:
    """Of a page's numbers (page_phones) that of the best kind that isn't a relay; NULL if there is none."""
    return best_phone(without_relays(phones))


def sitemap_urls(spark, path: str) -> DataFrame:
    """The url of every entry of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("url")).where(present(F.col("url")))


def kept_urls(urls: DataFrame, paths: Sequence[str], slugs: Sequence[str], limit: int = 5000) -> DataFrame:
    """Distinct urls that hold one of the paths and one of the slugs."""
    any_of = lambda words: F.lower("url").rlike("|".join(re.escape(w.lower()) for w in words))
    return urls.where(any_of(paths) & any_of(slugs)).select("url").distinct().orderBy("url").limit(limit)
