"""Nodes, structured data and facts of pages written out by hand: nested, unclosed and broken ones among them."""

import json

from pyspark.sql import functions as F

from seine.functions import nodes as N
from seine.operators import gazetteer, pages

PAGES = {
    "ld": '<script type="application/ld+json">' + json.dumps({"@graph": [{"@type": "WebSite", "name": "No"}, {"@type": ["Corporation", "x"], "name": " Acme  Oil ", "email": "mailto:Info@acme.com", "telephone": " +1 555 ", "address": {"streetAddress": "1 Way", "addressLocality": "Oslo", "addressCountry": "Norway"}, "sameAs": ["https://x.com/a", "http://www.linkedin.com/company/acme/"], "areaServed": [["Egypt", ["Qatar", {"name": "Texas", "n": 3, "deep": {"a": "Iraq"}}]], "GCC"], "contactPoint": [{"email": "sales@acme.com", "telephone": "+2", "areaServed": "France"}, "x"]}, {"@type": "Organization", "name": "Second", "address": "Cairo road, Kuwait"}]}) + "</script><p itemprop=email>prop@p.com",
    "ld_list": '<script type="application/ld+json">[1, {"email": "plain@here"}, {"contactPoint": {"telephone": "7"}, "address": {"country": "Atlantis"}}]</script><script type="application/ld+json">{broken</script>',
    "meta": '<meta name="contact-email" content="a@b.com, c@d.com"><meta property="og:phone" content="+20 2 555 1000"><meta name="geo.region" content="Peru and Chile"><meta name=linkedin content="https://www.linkedin.com/company/m/?x=1">',
    "props": '<div itemprop="address"><span>Main st</span><b>Doha, Qatar</b></div><span itemprop="telephone" content="+49 30 1234567"></span><i itemprop="email">Prop@P.com</i><div class="vcard">card@c.com Italy</div>',
    "card": '<div class="big h-card">Ann <p>ann@card.com<p>+33 1 23 45 67 89 <b>Belgium</div><div class="h-cardx">no@no.com Spain</div>',
    "empty": None,
}


def frame(spark, rows):
    return pages.read(spark.createDataFrame([(k, f"https://www.{k}.org/home/", h) for k, h in rows.items()], "k string, url string, html string"))


def test_structured(spark):
    got = {r.k: r.structured for r in pages.structured(frame(spark, PAGES), gazetteer.Gazetteer(spark)).collect()}
    gulf = ["bahrain", "kuwait", "oman", "qatar", "saudi arabia", "united arab emirates"]
    r = got["ld"]
    assert (r.emails, r.phones, r.linkedin_url, r.hq_country, r.company_name, r.address) == (["info@acme.com", "sales@acme.com"], ["+1 555", "+2"], "https://linkedin.com/company/acme", "norway", "Acme Oil", "1 Way, Oslo, Norway")
    assert r.presence == ["norway", "egypt", "qatar", "usa", *[g for g in gulf if g != "qatar"], "france"]
    r = got["ld_list"]
    assert (r.emails, r.phones, r.hq_country, r.company_name, r.presence) == (["plain@here"], ["7"], "atlantis", "", [])
    r = got["meta"]
    assert (r.emails, r.phones, r.linkedin_url, r.hq_country, r.presence) == (["a@b.com", "c@d.com"], ["+20 2 555 1000"], "https://linkedin.com/company/m", "chile", ["chile", "peru"])
    r = got["props"]
    assert (r.emails, r.phones, r.hq_country, r.presence) == (["prop@p.com"], ["+49 30 1234567"], "qatar", ["qatar"])
    r = got["card"]
    assert (r.emails, r.phones, r.hq_country, r.presence) == (["ann@card.com"], ["+33 1 23 45 67 89"], "belgium", ["belgium"])
    assert tuple(got["empty"]) == ([], [], "", "", "", "", [])


def test_crawled(spark):
    html = (
        "<html><head><title>Delta - Wells &amp; more</title><meta name=Description content=' We  drill '></head><body><nav>Menu <a href='/about'>x</a></nav>"
        "<article><p>Headquartered in Oslo, Norway.<p>Our offices: Egypt <script>var a='Peru';</script><aside>ad Spain</aside> mail me@delta.org</article>"
        "<footer><a href='contact us.html'>Say hello</a><a href='https://other.org/contact'>o</a><a href='mailto:x@y.z'>contact</a><a href='https://www.LinkedIn.com/in/d'>in</a></footer>"
    )
    r = pages.crawled(frame(spark, {"d": html, "plain": "<p>Just text<ul><li>one<li>two", "none": None}), gazetteer.Gazetteer(spark)).orderBy("k").collect()
    c = r[0].crawl
    assert (c.title, c.description, c.company_name, c.country, c.hq_country, c.presence) == ("Delta - Wells & more", "We drill", "Delta", "egypt", "egypt", ["egypt"])
    assert c.text == "Delta - Wells & more We drill Headquartered in Oslo, Norway. Our offices: Egypt mail me@delta.org"
    assert c.emails == ["me@delta.org"] and c.contact_links == ["https://d.org/about", "https://www.d.org/home/contact us.html"] and c.linkedin_url == "https://www.LinkedIn.com/in/d"
    assert r[2].crawl.text == "Just text one two" and r[2].crawl.company_name == "" and r[1].crawl.text == ""


def test_nodes():
    ns = N.read("<div a=1 a=2 b>x<p>one<p>two<br>three</div><li>i<li>j</ul><table><tr><td>1<td>2<tr><td>3</table><img/><b/>y</b>&amp;z<script>a<b</script>")
    tree = [(n["tag"], n["depth"], n["text"]) for n in ns]
    assert tree == [
        ("#page", 0, None), ("div", 1, None), ("#text", 2, "x"), ("p", 2, None), ("#text", 3, "one"), ("p", 2, None), ("#text", 3, "two"), ("br", 3, None), ("#text", 3, "three"),
        ("li", 1, None), ("#text", 2, "i"), ("li", 1, None), ("#text", 2, "j"), ("table", 2, None), ("tr", 3, None), ("td", 4, None), ("#text", 5, "1"), ("td", 4, None), ("#text", 5, "2"),
        ("tr", 3, None), ("td", 4, None), ("#text", 5, "3"), ("img", 2, None), ("b", 2, None), ("#text", 2, "y"), ("#text", 2, "&z"), ("script", 2, None), ("#script", 3, "a<b"),
    ]
    assert ns[1]["attrs"] == [("a", "1"), ("b", "")] and ns[1]["last"] == 8 and ns[0]["last"] == len(ns) - 1


def test_functions_of_nodes(spark):
    page = spark.createDataFrame([("<title>T</title><title>U</title><a href=' /x '>go <b>on</b></a><a>none</a><META NAME='K' content='v'><main>m<nav>n</nav></main>",)], "html string")
    ns = N.nodes(F.col("html"))
    r = page.select(ns.alias("n")).select(N.title(F.col("n")).alias("t"), N.anchors(F.col("n")).alias("a"), N.meta(F.col("n"), "none", "k").alias("m"), N.main_text(F.col("n")).alias("main"), N.joined(F.col("n")).alias("all")).first()
    assert (r.t, [tuple(a) for a in r.a], r.m, r.main, r.all) == ("T", [("/x", "go on")], "v", "m", "T U go on none m n")


def test_references_without_a_semicolon_are_text():
    page = '<p title="?a&copy=1&amp;b">x&amp y&amp; &#65 &#65; &lt</p><script>a && b &amp; c</script><!-- & <script> --><p>d&amp'
    read = N.read(page)
    assert [n["text"] for n in read if n["text"]] == ["x&amp y& &#65 A &lt", "a && b &amp; c", "d&amp"]
    assert dict(read[1]["attrs"]) == {"title": "?a&copy=1&b"}


def test_few_pages_are_held_as_objects(monkeypatch):
    import gc

    import pyarrow as pa

    most, plain = [0], N.read

    def watched(html):
        read = plain(html)
        most[0] = max(most[0], sum(isinstance(o, dict) and "parent" in o for o in gc.get_objects()))
        return read

    monkeypatch.setattr(N, "read", watched)
    pages_ = [f"<p>{i}</p>" for i in range(5 * N.AT_ONCE + 3)]
    assert N.nodes.func(pa.array([*pages_, None])).to_pylist()[-2][2]["text"] == str(len(pages_) - 1)
    assert most[0] <= 2 * 3 * (N.AT_ONCE + 1)  # a group, and the one before until it is let go
