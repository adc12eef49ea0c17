"""Reasons of rejection written out by hand; known records against all pairs."""

import random

from pyspark.sql import functions as F

from seine.functions import names
from seine.operators import rejection
from tests.test_resolution import some_names

ROW = "seq long, company_name string, domain string, website string, hq_country string, country string, description string, notes string, confidence_score double, is_directory_or_media boolean, presence_countries array<string>, linkedin_url string, job_title string, has_usa_presence boolean"


def row(seq, **more):
    full = {"seq": seq, "confidence_score": 60.0, "is_directory_or_media": False, "has_usa_presence": False, "presence_countries": None} | more
    return tuple(full.get(c.split()[0], "") for c in ROW.split(", "))


def reasons(spark, want, *rows):
    return {r.seq: r.reason for r in rejection.rejected(spark.createDataFrame(rows, ROW), want).collect()}


def test_rules(spark):
    want = rejection.Wanted(include=["Egypt"], exclude=["USA", "France"], exclude_presence=["usa"], strict=True)
    got = reasons(
        spark, want, row(1, country="egypt"), row(2, confidence_score=34.6), row(3, confidence_score=3.0, notes="x llm_rank:8/10"), row(4, is_directory_or_media=True, notes="llm_rank:6/10"),
        row(5, is_directory_or_media=True, notes="llm_rank:7/10"), row(6, company_name=" List of firms"), row(7, hq_country="USA "), row(8, domain="ibm.com"), row(9, website="https://x.org/us/en/home"),
        row(10, website="https://x.org/us/en/home", country="egypt"), row(11, description="We are based in France."), row(12, presence_countries=["Usa"]), row(13, country="egypt", has_usa_presence=True), row(14, presence_countries=["Norway"]),
        row(15), row(16, hq_country=None, country=None, notes=None, company_name=None),
    )
    out = "geography_violation"
    assert got == {1: None, 2: "low_confidence(35<35)", 3: None, 4: "directory_or_media", 5: None, 6: "directory_or_media", 7: out, 8: out, 9: out, 10: None, 11: out, 12: out, 13: out, 14: out, 15: None, 16: None}


def test_people(spark):
    want = rejection.Wanted(task_type="people_search")
    got = reasons(spark, want, row(1, linkedin_url="https://linkedin.com/company/x"), row(2, linkedin_url="https://linkedin.com/in/x"), row(3, website="https://linkedin.com/in/x", job_title="boss"), row(4, website="https://x.org"))
    assert got == {1: "linkedin_company_page", 2: "no_person_info", 3: None, 4: "not_linkedin_profile"}


def test_known(spark):
    rng = random.Random(3)
    asked, held = some_names(rng, 120), some_names(random.Random(3), 60)
    index = spark.createDataFrame([(n, "d.org" if i == 0 else "") for i, n in enumerate(held)] + [("Some Firm", "linkedin.com")], "company_name string, domain string")
    records = spark.createDataFrame([(i, n, "") for i, n in enumerate(asked)] + [(900, "unheard of zzz", "D.org"), (901, held[0], "www.linkedin.com"), (902, "", "")], "seq long, company_name string, domain string")
    both = lambda df: {r.c: r.s for r in df.select(names.clean_name(F.col("company_name")).alias("c"), names.acronym(F.col("company_name")).alias("s")).collect()}
    own, there = both(records), both(index)
    cleaned = {r.seq: r.c for r in records.select("seq", names.clean_name(F.col("company_name")).alias("c")).collect()}
    want = {i for i in range(len(asked)) if any(names.similar(cleaned[i], c, own[cleaned[i]], s) for c, s in there.items())} | {900}
    assert {r.seq for r in rejection.known(records, index).collect()} == want and len(want) < 121
