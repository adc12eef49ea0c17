"""Crawls folded onto records, on a small web written out by hand."""

from pyspark.sql import functions as F

from seine.operators import crawl, filters, gazetteer

RECORD = "seq long, company_name string, website string, description string, email string, phone string, contact_page string, linkedin_url string, hq_country string, country string, page_type string, is_directory_or_media boolean"


def record(seq, website, name="Old", **more):
    row = {"seq": seq, "company_name": name, "website": website, "is_directory_or_media": True, "page_type": "unknown"} | more
    return tuple(row.get(c.split()[0], "") for c in RECORD.split(", "))


WEB = [
    (1, "https://www.a.org/", "<title>Alpha - wells</title><a href='/contact'>c</a><a href='/about'>a</a><a href='/team'>t</a><a href='/offices'>o</a><p>We drill. one@a.org"),
    (2, "http://a.org/contact?x=1", "<title>Contact us</title>two@a.org one@a.org +20 2 555 1000 Our offices: Qatar"),
    (3, "https://a.org/about", "<p>Headquartered in Norway. Offices in Egypt and Qatar"),
    (4, "https://a.org/offices", "four@a.org is beyond the third link"),
    (5, "https://a.org/", "a second page of one address: never@a.org"),
    (6, "https://b.org", "<p>Nothing here. <b>Press release"),
    (7, "https://b.org/contactus", "<p>still nothing"),
    (8, "https://b.org/about", "<p>about@b.org"),
    (9, "https://b.org/info", "<p>info@b.org"),
    (10, "https://c.org", "<title>List of companies</title>"),
    (11, "https://c.org/contact", "x"), (12, "https://c.org/about", "y"), (13, "https://c.org/support", "late@c.org"),
    (14, None, "no address"),
]


def setup(spark):
    web = crawl.web(spark.createDataFrame(WEB, "page_id long, url string, html string"), gazetteer.Gazetteer(spark))
    rows = [record(1, "http://www.a.org"), record(2, "https://b.org/", email="old@b.org"), record(3, "c.org"), record(4, ""), record(5, "https://none.org", email="keep@none.org"), record(6, "https://a.org", name="", email="mine@a.org", country="iraq")]
    return web, spark.createDataFrame(rows, RECORD)


def test_applied(spark):
    web, records = setup(spark)
    got = {r.seq: r for r in crawl.applied(records, web, filters.directory_title).collect()}
    a = got[1]
    assert (a.company_name, a.email, a.phone, a.contact_page, a.hq_country, a.country, a.presence, a.page_type, a.is_directory_or_media) == (
        "Alpha", "one@a.org", "+20 2 555 1000", "https://a.org/contact", "egypt", "egypt", ["qatar", "egypt"], "company", False,
    )
    assert (got[2].email, got[2].page_type, got[2].is_directory_or_media) == ("about@b.org", "media", True)
    assert (got[3].email, got[3].company_name, got[3].page_type) == ("", "List of companies", "directory")  # two pages were tried, and had none
    assert [(got[k].email, got[k].company_name, got[k].crawled, got[k].page_type) for k in (4, 5)] == [("", "Old", False, "unknown"), ("keep@none.org", "Old", False, "unknown")]
    assert records.columns == crawl.applied(records, web, filters.directory_title).columns[:-2] and len(got) == 6


def test_subpages_and_probes(spark):
    web, records = setup(spark)
    home = {r.address: r for r in crawl.with_subpages(web).collect()}["https://a.org"]
    assert home.crawl.emails == ["one@a.org", "two@a.org"] and home.n_subpages == 2 and home.crawl.text.endswith("Offices in Egypt and Qatar")
    asked = records.select("seq", "website").filter("seq in (2, 3)")
    got = {r.seq: r for r in crawl.probed(asked, web).collect()}
    assert (got[2].p_emails, got[2].n_probes, got[3].p_emails, got[3].n_probes) == (["about@b.org"], 2, [], 2)
    assert {r.seq: (r.p_emails, r.n_probes) for r in crawl.probed(asked, web, most=3).collect()} == {2: (["about@b.org"], 2), 3: (["late@c.org"], 3)}


def test_enriched_fills_blanks(spark):
    web, records = setup(spark)
    got = {r.seq: r for r in crawl.enriched(records, web).collect()}
    assert (got[6].company_name, got[6].email, got[6].country, got[6].hq_country, got[6].presence) == ("Alpha", "mine@a.org", "iraq", "egypt", ["qatar", "egypt"])
    assert (got[2].email, got[4].crawled, got[1].company_name) == ("old@b.org", False, "Old")


def test_from_cache(spark):
    _, records = setup(spark)
    with_domain = records.withColumn("domain", F.regexp_extract("website", r"([a-z]+\.org)", 1))
    cache = spark.createDataFrame([("a.org", '{"company_name": "Cached", "email": null}'), ("a.org", '{"company_name": "Cached", "email": null}'), ("b.org", "broken"), ("", '{"company_name": "No"}')], "domain string, value string")
    got = {r.seq: r for r in crawl.from_cache(with_domain, cache, ("company_name", "email", "description")).collect()}
    assert len(got) == 6 and (got[1].company_name, got[1].email, got[1].from_cache) == ("Cached", "", True) and (got[4].company_name, got[4].from_cache) == ("Old", False)


def test_web_of_records_reads_what_they_meet(spark):
    """Pages that no record meets are not read; what the records get is the same."""
    far = [(20, "https://a.org/p7", "<p>no record leads here: far@a.org"), (21, "https://d.org/", "<p>nor here")]
    source = spark.createDataFrame(WEB + far, "page_id long, url string, html string")
    _, records = setup(spark)
    g = gazetteer.Gazetteer(spark)
    met, every = crawl.web(source, g, records=records), crawl.web(source, g)
    paths = {"a.org": ("", "/contact", "/about", "/team"), "b.org": ("", "/contactus", "/about", "/info"), "c.org": ("", "/contact", "/about", "/support")}
    there = {r.address for r in every.select("address").collect()}
    assert {r.address for r in met.select("address").collect()} == {f"https://{h}{p}" for h, ps in paths.items() for p in ps} & there
    assert {"https://a.org/p7", "https://d.org"} <= there
    for fold in (lambda known: crawl.applied(records, known, filters.directory_title), lambda known: crawl.enriched(records, known)):
        assert sorted(map(str, fold(met).collect())) == sorted(map(str, fold(every).collect()))
    assert "ArrowEvalPython" not in met._jdf.queryExecution().optimizedPlan().toString()
