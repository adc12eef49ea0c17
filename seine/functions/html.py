"""Column functions over HTML: what a page says, by patterns that stay in the JVM.

Visible text is all text outside scripts, styles and comments; no attempt is made to find the main article.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import clean, text_of

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def title(c: Column) -> Column:
    return clean(unescape(F.regexp_extract(text_of(c), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta(c: Column, name: str) -> Column:
    """content of the meta tag with this name or property."""
    return clean(unescape(F.regexp_extract(text_of(c), rf"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)))


def description(c: Column) -> Column:
    own = meta(c, "description")
    return F.when(own != "", own).otherwise(meta(c, "og:description"))


def visible_text(c: Column) -> Column:
    bare = F.regexp_replace(text_of(c), r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return clean(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def links(c: Column) -> Column:
    """Distinct targets of anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1)))


def contact_links(c: Column, words: tuple[str, ...]) -> Column:
    return F.filter(links(c), lambda u: F.lower(u).rlike("|".join(words)))


def company_name(c: Column) -> Column:
    """og:site_name, else the head of the title before a bar, dash or colon."""
    site = meta(c, "og:site_name")
    head = clean(F.regexp_extract(title(c), r"^(.*?)(?:\s[-–|]\s|[|–:]|$)", 1))
    return F.when(site != "", site).when(F.length(head).between(2, 80), head).otherwise("")


def social_links(c: Column, networks: tuple[str, ...] = ("linkedin", "twitter", "facebook", "youtube", "instagram")) -> Column:
    """Map of each network to the first link to it."""

    def first(network: str) -> Column:
        return F.get(F.filter(links(c), lambda u: u.contains(f"{network}.com")), F.lit(0))

    entries = F.array(*[F.struct(F.lit(n).alias("key"), first(n).alias("value")) for n in networks])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def json_ld(c: Column) -> Column:
    """Bodies of JSON-LD scripts."""
    return F.regexp_extract_all(text_of(c), F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def json_ld_organisation(body: Column) -> Column:
    """struct(name, email, telephone, country) of one JSON-LD body; invalid JSON gives nulls."""
    v = F.try_parse_json(body)
    return F.struct(*[F.try_variant_get(v, f"$.{p}", "string").alias(n) for n, p in (("name", "name"), ("email", "email"), ("telephone", "telephone"), ("country", "address.addressCountry"))])
