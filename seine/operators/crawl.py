"""Pages onto records: a site's page with the pages it leads to, paths that are tried where no contact was found, and what
all that changes of a record.

The web is a table of pages, one for each address (the first by number). A record's page is the one at its website's
address; up to SUBPAGES of its contact links are followed; what they say is folded in their order: lists are united, blanks
are filled by the first that has something. Paths are tried in their order until one shows a contact, MOST_PROBES pages at
most. All of it are joins on addresses: a record meets 1 + SUBPAGES + len(PATHS) pages at most.

Defined results: a record without website, or whose page is missing, stays as it is; null and repeated addresses of pages
are dropped; null fields of records count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import text, urls
from seine.functions.text import clean
from seine.operators import pages
from seine.operators.gazetteer import Gazetteer
from seine.session import stored

# Paths where contacts are looked for, in the order in which they are tried.
PATHS = (
    "/contact", "/contact-us", "/contact-us/", "/contactus", "/about", "/about-us",
    "/about/contact", "/company/contact", "/get-in-touch", "/reach-us", "/info", "/support",
)
SUBPAGES, MOST_PROBES = 3, 2
# Words by which a page's kind is told, in this order.
MEDIA = ("press release", "newsroom", "breaking news", "magazine")
BLOG = ("blog post", "how to guide", "tutorial")
_EMPTY = "array<string>"


def web(source: DataFrame, g: Gazetteer, number: str = "page_id", url: str = "url", html: str = "html", records: DataFrame | None = None) -> DataFrame:
    """(address, crawl, structured) of the first page of each address. Pages are chosen before any is read.

    records: reads those pages only that applied() or enriched() meet for these records, and stores what they say: pages at
    their websites' addresses, at the paths that are tried there, and at what the websites' pages lead to.
    """
    named = source.select(F.col(number).alias("number"), F.col(url).alias("url"), F.col(html).alias("html"))
    placed = named.select("number", "url", urls.normal_url(F.col("url")).alias("address")).filter("address <> ''")
    first = placed.groupBy("address").agg(F.min_by(F.struct("number", "url"), F.struct("number", "url")).alias("p")).select("address", "p.number", "p.url")

    def told(chosen: DataFrame) -> DataFrame:
        rows = named.join(chosen.select("number", "url"), ["number", "url"], "left_semi").dropDuplicates(["number", "url"])
        addressed = rows.select(urls.normal_url(F.col("url")).alias("address"), "url", "html")
        return pages.crawled(pages.structured(pages.read(addressed), g), g).select("address", "crawl", "structured")

    if records is None:
        return told(first)
    first = stored(first, "web-first")
    sites = records.select("website", urls.normal_url(F.col("website")).alias("address"))
    homes = sites.select("address").distinct()
    tried = sites.select(F.explode(_tried(PATHS)).alias("path")).select(urls.normal_url(F.col("path")).alias("address"))
    asked = stored(homes.unionByName(tried).distinct(), "web-asked")
    met = stored(told(first.join(asked, "address", "left_semi")), "web-met")
    links = _followed(met.join(homes, "address", "left_semi"), SUBPAGES).select("address").distinct().join(asked, "address", "left_anti")
    return met.unionByName(stored(told(first.join(links, "address", "left_semi")), "web-led-to"))


def _tried(paths: tuple[str, ...]) -> Column:
    return F.array(*[F.concat(urls.root_url(F.col("website")), F.lit(p)) for p in paths])


def _followed(known: DataFrame, most: int) -> DataFrame:
    """(of, n, address): the contact links that are followed from each page."""
    return known.select(F.col("address").alias("of"), F.posexplode(F.slice("crawl.contact_links", 1, most)).alias("n", "link")).select("of", "n", urls.normal_url(F.col("link")).alias("address"))


def united(*arrays: Column) -> Column:
    """The filled strings of arrays in order, each once."""
    every = F.concat(*[F.coalesce(a, F.array().cast(_EMPTY)) for a in arrays])
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def _in_order(order: str, value: Column) -> Column:
    """Lists of a group one after the other."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]))


def _first(order: str, value: Column) -> Column:
    """The first filled value of a group, in order; empty if none."""
    return F.coalesce(F.min_by(value, F.when(value != "", F.col(order))), F.lit(""))


def with_subpages(known: DataFrame, most: int = SUBPAGES) -> DataFrame:
    """The web with each page's contact links folded in."""
    met = _followed(known, most).join(known.select("address", F.col("crawl").alias("sub")), "address")
    filled = [F.struct(F.col("n"), F.col("sub.text").alias("text"))]
    folded = met.groupBy("of").agg(
        _in_order("n", F.col("sub.emails")).alias("s_emails"), _in_order("n", F.col("sub.phones")).alias("s_phones"), _in_order("n", F.col("sub.presence")).alias("s_presence"),
        _first("n", F.col("sub.company_name")).alias("s_name"), _first("n", F.col("sub.country")).alias("s_country"), _first("n", F.col("sub.hq_country")).alias("s_hq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(filled[0])), lambda x: x["text"]), " ").alias("s_text"), F.count("*").alias("n_subpages"),
    )
    c = F.col("crawl")
    fill = lambda own, sub: F.when(c[own] != "", c[own]).otherwise(F.coalesce(F.col(sub), F.lit("")))
    joined = known.join(folded, F.col("address") == F.col("of"), "left")
    whole = c.withField("emails", united(c["emails"], F.col("s_emails"))).withField("phones", united(c["phones"], F.col("s_phones"))).withField("presence", united(c["presence"], F.col("s_presence")))
    whole = whole.withField("company_name", fill("company_name", "s_name")).withField("country", fill("country", "s_country")).withField("hq_country", fill("hq_country", "s_hq"))
    whole = whole.withField("text", clean(F.concat_ws(" ", c["text"], "s_text")))
    return joined.select("address", whole.alias("crawl"), "structured", F.coalesce("n_subpages", F.lit(0)).alias("n_subpages"))


def probed(asked: DataFrame, known: DataFrame, most: int = MOST_PROBES, paths: tuple[str, ...] = PATHS) -> DataFrame:
    """(seq, p_emails, p_phones, p_linkedin, n_probes) for records (seq, website): pages at the paths of their sites, in order,
    until one shows a contact, `most` at the most."""
    tried = asked.select("seq", F.posexplode(_tried(paths)).alias("n", "path"))
    at = tried.select("seq", "n", urls.normal_url(F.col("path")).alias("address"))
    shown = known.select("address", united(F.col("structured.emails"), F.col("crawl.emails")).alias("e"), united(F.col("structured.phones"), F.col("crawl.phones")).alias("p"), F.col("structured.linkedin_url").alias("l"))
    before = Window.partitionBy("seq").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    met = at.join(shown, "address").withColumn("done", F.coalesce(F.max((F.size("e") > 0) | (F.size("p") > 0)).over(before), F.lit(False))).withColumn("nth", F.count("*").over(before))
    kept = met.filter(~F.col("done") & (F.col("nth") < most))
    return kept.groupBy("seq").agg(_in_order("n", F.col("e")).alias("p_emails"), _in_order("n", F.col("p")).alias("p_phones"), _first("n", F.col("l")).alias("p_linkedin"), F.count("*").alias("n_probes"))


def page_type(title: Column, hay: Column, directory: Column) -> Column:
    low = F.lower(hay)
    return F.when(directory, "directory").when(low.rlike("|".join(MEDIA)), "media").when(low.rlike("|".join(BLOG)), "blog").otherwise("company")


def applied(records: DataFrame, known: DataFrame, directory_title) -> DataFrame:
    """Records with what the crawl of their website says in place of what they had; those without a page stay.

    directory_title: whether a name is a directory's, as a function of a column. Adds `presence` and `crawled`.
    """
    whole = with_subpages(known)
    at = records.withColumn("seine_address", urls.normal_url(F.col("website")))
    met = at.filter("seine_address <> ''").select("seq", "website", "seine_address").join(whole.withColumnRenamed("address", "seine_address"), "seine_address")
    poor = met.filter((F.size("crawl.emails") == 0) & (F.size("structured.emails") == 0)).select("seq", "website")
    found = met.drop("website", "seine_address").join(probed(poor, known), "seq", "left")
    joined = at.drop("seine_address").join(found, "seq", "left")
    c, s = F.col("crawl"), F.col("structured")
    emails, phones = united(s["emails"], F.col("p_emails"), c["emails"]), united(s["phones"], F.col("p_phones"), c["phones"])
    seat = text.first_filled(s["hq_country"], c["hq_country"])
    name = text.first_filled(c["company_name"], F.col("company_name"), s["company_name"])
    head = lambda array: F.coalesce(F.get(array, F.lit(0)), F.lit(""))
    about = text.first_filled(c["description"], F.col("description"))
    hay = F.concat_ws(" ", "website", about, F.substring(c["text"], 1, 500))
    new = {
        "company_name": name, "description": about, "email": head(emails), "phone": head(phones), "contact_page": head(c["contact_links"]),
        "linkedin_url": text.first_filled(s["linkedin_url"], F.col("p_linkedin"), c["linkedin_url"]), "hq_country": seat, "country": seat,
        "page_type": page_type(name, hay, directory_title(name)),
    }
    there = c.isNotNull()
    columns = {k: F.when(there, v).otherwise(F.col(k)) for k, v in new.items() if k in records.columns}
    kept = joined.withColumn("presence", F.when(there, c["presence"]).otherwise(F.array().cast(_EMPTY))).withColumn("crawled", there)
    named = text.fenced(kept, {f"seine_{k}": v for k, v in columns.items()})
    out = [F.col(f"seine_{k}").alias(k) if k in columns else F.col(f"`{k}`") for k in records.columns]
    if "is_directory_or_media" in records.columns:
        out = [F.when(F.col("crawled"), F.col("seine_page_type").isin("directory", "media", "blog")).otherwise(F.col("is_directory_or_media")).alias("is_directory_or_media") if x == "is_directory_or_media" else y for x, y in zip(records.columns, out, strict=True)]
    return named.select(*out, "presence", "crawled")


def enriched(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose blanks the crawl of their website fills, the page's own word before its structured data; what they have
    stays. Adds `presence` and `crawled`."""
    whole = with_subpages(known).withColumnRenamed("address", "seine_address")
    joined = records.withColumn("seine_address", F.nullif(urls.normal_url(F.col("website")), F.lit(""))).join(whole, "seine_address", "left")
    c, s = F.col("crawl"), F.col("structured")
    head = lambda array: F.coalesce(F.get(array, F.lit(0)), F.lit(""))
    offers = {
        "email": (head(c["emails"]), head(s["emails"])), "phone": (head(c["phones"]), head(s["phones"])), "contact_page": (head(c["contact_links"]),),
        "company_name": (c["company_name"], s["company_name"]), "hq_country": (c["hq_country"], s["hq_country"]), "country": (c["country"],), "linkedin_url": (s["linkedin_url"],),
    }
    out = [text.first_filled(F.col(k), *offers[k]).alias(k) if k in offers else F.col(f"`{k}`") for k in records.columns]
    return joined.select(*out, F.coalesce(c["presence"], F.array().cast(_EMPTY)).alias("presence"), c.isNotNull().alias("crawled"))


def from_cache(records: DataFrame, cache: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Records with a cached scrape of their domain (domain, JSON `value`) in place of their fields: name and description stay
    where the cache has none, the others are taken as they are, blank if it lacks them. Adds `from_cache`."""
    kind = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"
    held = cache.select(F.col("domain").alias("seine_domain"), F.from_json("value", kind).alias("seine_held")).filter("seine_domain <> ''").dropDuplicates(["seine_domain"])
    joined = records.join(held, F.col("domain") == F.col("seine_domain"), "left")
    h = F.col("seine_held")

    def taken(k: str) -> Column:
        return F.coalesce(h[k], F.col(k) if k in ("company_name", "description") else F.lit(""))

    out = [F.when(h.isNotNull(), taken(k)).otherwise(F.col(k)).alias(k) if k in fields else F.col(f"`{k}`") for k in records.columns]
    return joined.select(*out, h.isNotNull().alias("from_cache"))
