"""Facts of pages: contacts, seats and presence from JSON-LD, meta tags, microdata and business cards, and from the text.

JSON-LD is taken to any depth where it nests places; an item counts if its type is an organisation's or it has a contact.
Microdata is asked if there is no address for mail yet, cards if there is still none. Lists keep the order of the page.

Defined results: broken JSON says nothing; a page without such data has empty facts; null pages too.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.functions import nodes as N
from seine.functions import text, urls
from seine.functions.text import bound, clean
from seine.operators.gazetteer import Gazetteer

# Types of items that tell of an organisation, and the parts of a written address.
ORGANISATIONS = ("organization", "corporation", "company", "localbusiness", "professionalservice", "contactpoint")
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
#: Words of links that lead to contacts and places.
CONTACT_WORDS = (
    "contact", "about", "team", "company", "corporate", "office", "location", "locations", "global-presence", "presence", "offices", "reach-us", "get-in-touch",
    "اتصل", "تواصل", "المواقع", "مكاتب", "عن الشركة",
)
_NONE = "array<string>"


def _strings(value) -> list[str]:
    """What is said by a value: a text itself, lists item by item to any depth, an object by its plain values in one."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    if isinstance(value, dict):
        return [" ".join(str(v) for v in value.values() if isinstance(v, (str, int, float)))]
    return []


@F.arrow_udf(T.ArrayType(T.StringType()))
def said(values: pa.Array) -> pa.Array:
    """array<string> of JSON values -> the strings they say, in order."""
    return pa.array([None if row is None else [s for v in row for s in _strings(json.loads(v))] for row in values.to_pylist()], pa.list_(pa.string()))


def _empty() -> Column:
    return F.array().cast(_NONE)


def _kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _get(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$['{key}']", "variant")


def _word(item: Column, key: str) -> Column:
    """The value of a key if it is a text; else empty."""
    return bound(_get(item, key), lambda v: F.when(_kind(v, "STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.lit("")))


def _plain(item: Column, key: str) -> Column:
    """The value of a key as text, unless it is a list or object; else empty."""
    return F.coalesce(F.try_variant_get(item, f"$['{key}']", "string"), F.lit(""))


def _listed(v: Column) -> Column:
    """A list's elements, or the value alone; none for no value."""
    return F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), lambda x: x.isNotNull())


def _addresses(word: Column) -> Column:
    """The addresses for mail in a text, or the text if it has a sign of one."""
    return bound(word, lambda w: bound(text.emails(w), lambda e: F.when(F.size(e) > 0, e).when(w.contains("@"), F.array(w)).otherwise(_empty())))


def items(bodies: Column) -> Column:
    """array<variant>: the objects of JSON-LD scripts; a graph's members stand for it."""

    def of_one(v: Column) -> Column:
        graph = F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>"))
        return F.when(_kind(v, "OBJECT") & _get(v, "@graph").isNotNull(), graph).otherwise(_listed(v))

    every = F.flatten(F.transform(F.transform(bodies, F.try_parse_json), lambda v: bound(v, of_one)))
    return F.filter(F.filter(every, lambda i: _kind(i, "OBJECT")), lambda i: bound(i, _relevant))


def _relevant(item: Column) -> Column:
    kind = bound(_get(item, "@type"), lambda t: F.lower(F.coalesce(F.when(_kind(t, "ARRAY"), F.try_variant_get(t, "$[0]", "string")).otherwise(F.try_variant_get(t, "$", "string")), F.lit(""))))
    return kind.rlike("|".join(ORGANISATIONS)) | F.coalesce(*[_get(item, k) for k in ("email", "telephone", "contactPoint")]).isNotNull()


def _contact(item: Column) -> Column:
    """What one item tells; `spoken` are JSON values to look for places in, in order, without the address."""
    points = F.filter(_listed(_get(item, "contactPoint")), lambda p: _kind(p, "OBJECT"))
    address = _get(item, "address")
    parts = F.filter(F.array(*[_plain(address, p) for p in ADDRESS]), lambda p: p != "")
    country = F.when(_plain(address, "addressCountry") != "", _plain(address, "addressCountry")).otherwise(_plain(address, "country"))
    phone = F.when(_word(item, "telephone") != "", _word(item, "telephone")).otherwise(_word(item, "phone"))
    name = F.when(_word(item, "name") != "", _word(item, "name")).otherwise(_word(item, "legalName"))
    places = F.concat(F.array(*[_get(item, k) for k in ("areaServed", "location", "serviceArea")]), F.transform(points, lambda p: _get(p, "areaServed")))
    spelled = lambda array: F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x != "")
    return bound(
        points,
        lambda ps: F.struct(
            F.concat(_addresses(_word(item, "email")), F.flatten(F.transform(ps, lambda p: _addresses(_word(p, "email"))))).alias("emails"),
            spelled(F.concat(F.array(phone), F.transform(ps, lambda p: _word(p, "telephone")))).alias("phones"),
            clean(name).alias("name"),
            F.when(_kind(address, "OBJECT"), F.array_join(parts, ", ")).otherwise(F.lit("")).alias("parts"),
            F.when(_kind(address, "OBJECT"), country).otherwise(F.lit("")).alias("country"),
            _word(item, "address").alias("line"),
            F.filter(F.transform(_listed(_get(item, "sameAs")), lambda u: F.when(_kind(u, "STRING"), F.try_variant_get(u, "$", "string"))), lambda u: F.lower(u).contains("linkedin.com")).alias("linkedin"),
            F.filter(F.transform(places, lambda v: F.to_json(v)), lambda j: j.isNotNull()).alias("spoken"),
        ),
    )


def _first(array: Column) -> Column:
    return F.coalesce(F.get(F.filter(array, lambda x: x != ""), F.lit(0)), F.lit(""))


def structured(pages: DataFrame, g: Gazetteer, nodes: str = "nodes") -> DataFrame:
    """pages with `structured`: struct<emails, phones, linkedin_url, hq_country, company_name, address, presence>."""
    of = F.col(nodes)
    raw = text.fenced(pages, {"ld_items": F.transform(items(N.scripts(of, "application/ld+json")), lambda i: bound(i, _contact)), "ld_metas": N.metas(of), "ld_props": N.properties(of, "email", "telephone", "address", "areaServed"), "ld_cards": N.cards(of)})
    ld = F.col("ld_items")
    first_address = F.array_position(F.transform(ld, lambda i: i["parts"] != ""), F.lit(True)) - 1
    # an item's written address, an address in parts if it is the first such, and then the places it names
    own = lambda i, k: F.when(i["line"] != "", F.array(F.to_json(F.array(i["line"])))).when((i["parts"] != "") & (k == first_address), F.array(F.to_json(F.array(i["parts"])))).otherwise(_empty())
    spoken = F.flatten(F.transform(ld, lambda i, k: F.concat(own(i, k), i["spoken"])))
    metas = lambda *words: F.transform(F.filter("ld_metas", lambda m: m["key"].rlike("|".join(words))), lambda m: m["content"])
    props = lambda *names: F.transform(F.filter("ld_props", lambda p: p["name"].isin(*names)), lambda p: p["text"])
    found = text.fenced(raw, {
        "ld_presence": g.in_each(said(spoken)),
        "ld_seats": g.in_each(F.transform(ld, lambda i: F.when(i["country"] != "", i["country"]).otherwise(i["line"]))),
        "ld_meta_places": g.in_each(metas("location", "country", "region", "address")),
        "ld_prop_places": g.in_each(props("address", "areaServed")),
        "ld_card_places": g.in_each("ld_cards"),
        "ld_mail": F.concat(F.flatten(F.transform(ld, lambda i: i["emails"])), F.flatten(F.transform(metas("email"), text.emails))),
        "ld_phone": F.concat(F.flatten(F.transform(ld, lambda i: i["phones"])), F.flatten(F.transform(metas("phone"), text.phones))),
    })
    heads = lambda places: F.transform(places, lambda p: F.coalesce(F.get(p, F.lit(0)), F.lit("")))
    # a country in parts that is no known spelling is taken as it is, lower-cased
    seats = F.zip_with(heads(F.col("ld_seats")), ld, lambda s, i: F.when(s != "", s).otherwise(F.lower(i["country"])))
    no_mail = F.size("ld_mail") == 0
    prop_mail = F.when(no_mail, F.flatten(F.transform(props("email"), text.emails))).otherwise(_empty())
    cards = no_mail & (F.size(prop_mail) == 0)
    when = lambda asked, array: F.when(asked, array).otherwise(_empty())
    linkedin = F.concat(F.flatten(F.transform(ld, lambda i: i["linkedin"])), F.filter(metas("linkedin"), lambda c: c.contains("linkedin.com")))
    unique = lambda array: F.array_distinct(F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x != ""))
    facts = F.struct(
        unique(F.concat("ld_mail", prop_mail, when(cards, F.flatten(F.transform("ld_cards", text.emails))))).alias("emails"),
        unique(F.concat("ld_phone", when(no_mail, F.flatten(F.transform(props("telephone"), text.phones))), when(cards, F.flatten(F.transform("ld_cards", text.phones))))).alias("phones"),
        urls.normal_url(_first(linkedin)).alias("linkedin_url"),
        _first(F.concat(seats, heads(F.col("ld_meta_places")), when(no_mail, heads(F.col("ld_prop_places"))), when(cards, heads(F.col("ld_card_places"))))).alias("hq_country"),
        _first(F.transform(ld, lambda i: i["name"])).alias("company_name"),
        _first(F.transform(ld, lambda i: i["parts"])).alias("address"),
        F.array_distinct(F.concat(F.flatten("ld_presence"), F.flatten("ld_meta_places"), when(no_mail, F.flatten("ld_prop_places")), when(cards, F.flatten("ld_card_places")))).alias("presence"),
    )
    return found.select(*pages.columns, facts.alias("structured"))


def crawled(pages: DataFrame, g: Gazetteer, url: str = "url", nodes: str = "nodes") -> DataFrame:
    """pages with `crawl`: struct<title, description, text, emails, phones, contact_links, linkedin_url, company_name, country,
    hq_country, presence> of what the page itself says."""
    of = F.col(nodes)
    read = text.fenced(pages, {"cr_title": N.title(of), "cr_description": N.meta(of, "description", "og:description"), "cr_main": N.main_text(of), "cr_site": N.meta(of, "og:site_name"), "cr_links": N.anchors(of)})
    told = text.fenced(read, {"cr_text": clean(F.concat_ws(" ", "cr_title", "cr_description", "cr_main")), "cr_full": F.transform("cr_links", lambda a: urls.join_url(F.col(url), a["href"]))})
    placed = text.fenced(told, {"cr_country": g.first(F.col("cr_text")), "cr_hq": g.headquarters(F.col("cr_text")), "cr_presence": g.presence(F.col("cr_text"))})
    root = urls.host(F.col(url))
    leads = F.transform(
        F.filter(F.arrays_zip(F.col("cr_links").alias("a"), F.col("cr_full").alias("full")), lambda x: ~x["a"]["href"].rlike("^(?:mailto:|tel:|javascript:)") & (urls.host(x["full"]) == root) & F.lower(F.concat_ws(" ", x["a"]["text"], x["full"])).rlike("|".join(CONTACT_WORDS))),
        lambda x: x["full"],
    )
    head = clean(F.element_at(F.split(F.col("cr_title"), r"\s*[-|–:]\s*"), 1))
    name = F.when(F.col("cr_site") != "", F.col("cr_site")).when(F.length(head).between(2, 80), head).otherwise("")
    crawl = F.struct(
        F.col("cr_title").alias("title"), F.col("cr_description").alias("description"), F.col("cr_text").alias("text"),
        text.emails(F.col("cr_text")).alias("emails"), text.phones(F.col("cr_text")).alias("phones"), F.array_distinct(leads).alias("contact_links"),
        F.coalesce(F.get(F.filter("cr_full", lambda u: F.lower(u).contains("linkedin.com")), F.lit(0)), F.lit("")).alias("linkedin_url"),
        name.alias("company_name"), F.col("cr_country").alias("country"), F.col("cr_hq").alias("hq_country"), F.col("cr_presence").alias("presence"),
    )
    return placed.select(*pages.columns, crawl.alias("crawl"))


def read(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `nodes` in place of their HTML."""
    return text.fenced(pages, {"nodes": N.nodes(F.col(html))}).drop(html)
