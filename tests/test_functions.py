"""Column functions on hand-written cases."""

import re
import time

import pytest
from pyspark.sql import functions as F

from seine.functions import dates, html, names, text, urls


def value(spark, cell, column):
    return spark.createDataFrame([(cell,)], "c string").select(column(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(("url", "host", "domain", "normal"), [
    ("http://www2.A.co.uk:80/x/?q#f", "a.co.uk", "a.co.uk", "https://a.co.uk/x"), ("b.example.com", "b.example.com", "example.com", "https://b.example.com"), (None, "", "", ""), ("", "", "", ""),
])
def test_urls(spark, url, host, domain, normal):
    assert (value(spark, url, urls.host), value(spark, url, urls.domain), value(spark, url, urls.normal_url)) == (host, domain, normal)


def test_arabic_folds(spark):
    assert value(spark, "أَإآ ىة ؤئ", text.normal) == "ااا يه وي"


@pytest.mark.parametrize(("cell", "found"), [("A@B.org a@b.org x@example.com", ["a@b.org"]), (None, []), ("none", [])])
def test_emails(spark, cell, found):
    assert value(spark, cell, text.emails) == found


@pytest.mark.parametrize(("cell", "found"), [("call +20 2 555 1234 now", ["+20 2 555 1234"]), ("12345", []), ("1234567890123456789012", [])])
def test_phones(spark, cell, found):
    assert value(spark, cell, text.phones) == found


def test_deadlines_by_pattern_then_place(spark):
    got = value(spark, "on 05/13/2025 or 13/05/2025, 2025-01-02, Mar 3, 2026; 2025-01-02; 2025-99-99", dates.deadlines)
    assert [(x.raw, x.normalized) for x in got] == [("2025-01-02", "2025-01-02"), ("2025-99-99", ""), ("05/13/2025", "2025-05-13"), ("13/05/2025", "2025-05-13"), ("Mar 3, 2026", "2026-03-03")]


@pytest.mark.parametrize(("name", "clean", "key"), [("Acme & Sons Technologies Ltd.", "acme and sons", "acme and sons"), ("Inc", "", ""), (None, "", ""), ("The Nile-Group", "the nile", "the nile")])
def test_names(spark, name, clean, key):
    assert (value(spark, name, names.clean_name), value(spark, name, names.name_key)) == (clean, key)


@pytest.mark.parametrize(("a", "b", "same"), [("acme oil", "acme oil", True), ("abc", "alpha beta corp", True), ("nile drilling", "delta software", False), ("acme oil tools", "oil acme tools", True), ("", "x", False)])
def test_similar(a, b, same):
    short = lambda s: "".join(w[0] for w in s.split()) if len(s.split()) > 1 else ""
    assert names.similar(a, b, short(a), short(b)) is same


def test_html(spark):
    page = "<html><head><title>Acme | Home</title><meta name='description' content='We &amp; you'><script>x()</script></head><body><!-- no --><a href='/contact'>c</a> Hi<br>there &lt;</body></html>"
    assert value(spark, page, html.title) == "Acme | Home"
    assert value(spark, page, html.company_name) == "Acme"
    assert value(spark, page, html.description) == "We & you"
    assert value(spark, page, html.visible_text) == "Acme | Home c Hi there <"
    assert value(spark, page, lambda c: html.contact_links(c, text.CONTACT_WORDS)) == ["/contact"]
    assert value(spark, '<script type="application/ld+json">{bad</script>', lambda c: html.json_ld_organisation(F.get(html.json_ld(c), F.lit(0)))).name is None


def test_short_forms_read_heads_only(spark):
    """What is cut off is not read: 80 texts of 400,000 characters take no longer than a few; before, a minute on one core."""
    odd = ["", "  ", "-- a__b  c --", "É" * 99 + "x", "İstanbul K", "a " * 40, "a " * 41, "x" * 80, "x" * 81, " y z\n" * 50, "--" + "ab-" * 19 + "é-c--", "ab-" * 20 + "é---"]
    frame = spark.createDataFrame([(t,) for t in odd], "t string")
    for r in frame.select("t", text.slug(F.col("t")).alias("s"), text.truncate(F.col("t"), 80).alias("c")).collect():
        low = re.sub(r"[\s_-]+", "-", re.sub(r"[^a-z0-9_\s-]", "", r.t.lower(), flags=re.A), flags=re.A).strip("-")[:60].rstrip("-")
        whole = " ".join(r.t.split())
        assert (r.s, r.c) == (low or "report", whole if len(whole) <= 80 else whole[:77].rstrip() + "..."), r.t
    began = time.time()
    long = spark.range(0, 80, 1, 1).select(F.repeat(F.lit("some words. "), 33_000 + F.col("id").cast("int") * 0).alias("t"))
    assert len(long.select(text.slug(F.col("t")).alias("s")).distinct().collect()) == 1
    assert time.time() - began < 10
