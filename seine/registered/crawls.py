"""Queries over pages: structured data, main texts and crawls of sites, with data planted by the pages' numbers.

Pages of one host become a site: the first by number is its home, the next ones lie at paths that it links to or that are
tried; some say their contact in JSON-LD, some in the text, some in microdata, some not at all.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seine.functions import html, nodes, urls
from seine.operators import crawl, filters, gazetteer, pages
from seine.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_PATHS = ("", "/about-us", "/news", "/contact", "/team", "/info", "/reach-us")
_COUNTRIES = ("Norway", "Egypt", "Qatar", "Brazil")
_LINKS = '<a href="/about-us">A</a><a href="http://elsewhere.org/contact">B</a><a href="/team/">C</a><a href="mailto:x@y.z">contact</a><a href="/contact">D</a><a href="/offices">E</a>'


def _sites(spark, d):
    """The pages as sites; of their own texts every word becomes "word", so that places in them are those planted."""
    source = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), "html")
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1
    said = F.regexp_replace(F.replace(html.visible_text(F.col("html")), F.lit("@"), F.lit(" ")), r"[\p{L}\p{M}]+", "word")
    rows = source.withColumn("place", place).select("page_id", "host", "place", said.alias("text"))
    number, country = F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, _COUNTRIES)), (F.col("page_id") % 4 + 1).cast("int"))
    ld = F.format_string('<script type="application/ld+json">{"@graph": [{"@type": "Organization", "email": "ld%s@site.org", "address": {"addressCountry": "%s"}}]}</script>', number, country)
    micro = F.format_string('<div itemscope><b>Write: <i itemprop="email">micro%s@site.org<br></b></div><p itemprop="areaServed">%s', number, country)
    card = F.format_string('<div class="x vcard">Desk <p>card%s@site.org<p>%s</div>', number, country)
    kind = F.col("page_id") % 5
    planted = F.when(kind == 0, ld).when(kind == 1, micro).when(kind == 2, card).otherwise("")
    head = F.concat(F.lit("<html><head><title>"), "host", F.lit(' - page</title><meta property="og:site_name" content="Site '), "host", F.lit('"></head><body><article>'), "text", F.lit("</article>"))
    path = F.when(F.col("place") < len(_PATHS), F.get(F.array(*map(F.lit, _PATHS)), F.col("place"))).otherwise(F.concat(F.lit("/p"), "place"))
    return rows.select("page_id", "host", "place", F.concat(F.lit("http://www."), "host", path).alias("url"), F.concat(head, F.when(F.col("place") == 0, _LINKS).otherwise(""), planted).alias("html"))


def _country(i: str) -> str:
    return f"['norway', 'egypt', 'qatar', 'brazil'][{i} % 4 + 1]"


_SITES_SQL = """SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS place FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www[0-9]*[.])?', ''), '[/?#:].*$', '') AS host FROM pages)"""
_MAIL = "CASE page_id % 5 WHEN 0 THEN 'ld' || page_id || '@site.org' WHEN 1 THEN 'micro' || page_id || '@site.org' WHEN 2 THEN 'card' || page_id || '@site.org' ELSE '' END"


def _structured(spark, d):
    g = gazetteer.Gazetteer(spark)
    found = pages.structured(pages.read(_sites(spark, d)), g)
    return found.select("page_id", F.array_join("structured.emails", ",").alias("emails"), F.col("structured.hq_country").alias("hq_country"), F.array_join("structured.presence", ",").alias("presence"))


_add(
    "page_structured", _structured,
    f"SELECT page_id, {_MAIL} AS emails, CASE WHEN page_id % 5 < 3 THEN {_country('page_id')} ELSE '' END AS hq_country, CASE WHEN page_id % 5 < 3 THEN {_country('page_id')} ELSE '' END AS presence FROM pages",
)


def _main(spark, d):
    """The articles of the given pages, without what stands aside."""
    read = pages.read(table(spark, d, "pages").select("page_id", F.concat("html", F.lit("<aside>an aside</aside><article>The last <nav>menu</nav><p>piece</article>")).alias("html")))
    return read.select("page_id", nodes.main_text(F.col("nodes")).alias("main"))


_add(
    "page_main_text", _main,
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) || ' The last piece' AS main FROM pages""",
)
_add(
    "page_nodes", lambda spark, d: pages.read(table(spark, d, "pages").select("page_id", "html")).select("page_id", F.explode("nodes").alias("n")).filter("n.tag in ('article', 'p', 'li', 'a')").groupBy("page_id", "n.tag").agg(F.count("*").alias("n"), F.min("n.depth").alias("least_depth")),
    r"""SELECT page_id, tag, count(*) AS n, min(CASE tag WHEN 'article' THEN 3 WHEN 'li' THEN 5 WHEN 'a' THEN 6 ELSE 4 END)::INTEGER AS least_depth FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<(article|p|li|a)[ >]', 1)) AS tag FROM pages) GROUP BY page_id, tag""",
)


def _records(sites):
    """A record for each host."""
    blank = [F.lit("").alias(c) for c in ("description", "email", "phone", "contact_page", "linkedin_url", "hq_country", "country", "page_type")]
    return sites.groupBy("host").agg(F.min("page_id").alias("seq")).select("seq", "host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("website"), F.lit("Old").alias("company_name"), *blank)


def _crawled(spark, d):
    sites = _sites(spark, d)
    own = _records(sites)
    found = crawl.applied(own, crawl.web(sites, gazetteer.Gazetteer(spark), records=own), filters.directory_title)
    return found.select("seq", "company_name", "email", "contact_page", "hq_country", "page_type", "crawled")


#: A home's own facts; else, without an address for mail, those of the tried pages, two at most, until one has a contact. The
#: text of followed pages (cards and microdata are text too) comes after structured data.
_CRAWL_SQL = f"""WITH s AS MATERIALIZED ({_SITES_SQL}), m AS (SELECT *, {_MAIL} AS mail, page_id % 5 AS kind FROM s),
  home AS (SELECT * FROM m WHERE place = 0),
  tried AS (SELECT host, mail, row_number() OVER (PARTITION BY host ORDER BY n) AS nth FROM m JOIN (SELECT unnest([3, 1, 6, 5]) AS place, unnest([1, 6, 10, 11]) AS n) USING (place)),
  p AS (SELECT host, arg_min(mail, nth) AS mail FROM tried WHERE nth <= 2 AND mail <> '' GROUP BY host)
  SELECT home.page_id AS seq, 'Site ' || home.host AS company_name, CASE WHEN home.mail <> '' THEN home.mail ELSE coalesce(p.mail, '') END AS email, 'https://' || home.host || '/about-us' AS contact_page,
    CASE WHEN home.kind < 3 THEN {_country('home.page_id')} ELSE '' END AS hq_country, 'company' AS page_type, true AS crawled
  FROM home LEFT JOIN p USING (host)"""
_add("crawl_applied", _crawled, _CRAWL_SQL)


def _enriched(spark, d):
    """Every second record has an address for mail already, and keeps it."""
    sites = _sites(spark, d)
    own = _records(sites).withColumn("email", F.when(F.col("seq") % 2 == 0, "own@mail.org").otherwise("")).withColumn("company_name", F.when(F.col("seq") % 3 == 0, "").otherwise("Old"))
    found = crawl.enriched(own, crawl.web(sites, gazetteer.Gazetteer(spark), records=own))
    return found.select("seq", "company_name", "email", "hq_country")


_add(
    "crawl_enriched", _enriched,
    f"""WITH s AS MATERIALIZED ({_SITES_SQL}), home AS (SELECT *, {_MAIL} AS mail FROM s WHERE place = 0)
  SELECT page_id AS seq, CASE WHEN page_id % 3 = 0 THEN 'Site ' || host ELSE 'Old' END AS company_name, CASE WHEN page_id % 2 = 0 THEN 'own@mail.org' ELSE mail END AS email,
    CASE WHEN page_id % 5 < 3 THEN {_country('page_id')} ELSE '' END AS hq_country FROM home""",
)


def _from_cache(spark, d):
    """Records of suppliers with a cached scrape for every third of their domains."""
    from seine.sources import fixtures

    records = fixtures.records(spark, d)
    cache = records.filter("domain <> '' and seq % 3 = 0").groupBy("domain").agg(F.min("seq").alias("n")).select("domain", F.to_json(F.struct(F.concat(F.lit("Cached "), "n").alias("company_name"), F.lit("c@c.org").alias("email"))).alias("value"))
    found = crawl.from_cache(records, cache, ("company_name", "description", "email", "phone", "hq_country"))
    return found.select("seq", "company_name", "description", "email", "phone", "from_cache")


def _cache_sql() -> str:
    from seine.sources import fixtures

    return f"""WITH r AS (SELECT * FROM {fixtures.RECORDS}), c AS (SELECT domain, min(seq) AS n FROM r WHERE domain <> '' AND seq % 3 = 0 GROUP BY domain)
  SELECT seq, CASE WHEN n IS NULL THEN company_name ELSE 'Cached ' || n END AS company_name, description, CASE WHEN n IS NULL THEN email ELSE 'c@c.org' END AS email, CASE WHEN n IS NULL THEN phone ELSE '' END AS phone, n IS NOT NULL AS from_cache FROM r LEFT JOIN c USING (domain)"""


_add("scrape_cache_applied", _from_cache, _cache_sql())
