"""Resolution, budgets, sinks and streams on small hand-written tables."""

import pytest
from pyspark.sql import functions as F

from seine.functions import geo
from seine.operators import reports, resolve, sinks
from seine.sources import fixtures

SF = "/root/testdata/sf0.001"
RECORD = "seq long, company_name string, website string, domain string, description string, email string, phone string, linkedin_url string, contact_page string, country string, hq_country string, page_type string, is_directory_or_media boolean, confidence_score double"


def record(seq, name="", domain="", description="", **more):
    row = {"seq": seq, "company_name": name, "domain": domain, "description": description, "page_type": "company", "is_directory_or_media": False, "confidence_score": 0.0} | more
    return tuple(row.get(c.split()[0], "") for c in RECORD.split(", "))


def test_merge_takes_each_field_from_the_best(spark):
    rows = [record(1, "Acme", "a.com", "short"), record(2, "ACME Oil", "a.com", "a longer text", email="x@a.com"), record(3, "Bolt"), record(4, "Bolt")]
    got = {r.seq: r for r in resolve.by_domain(spark.createDataFrame(rows, RECORD)).collect()}
    assert set(got) == {1, 3, 4} and got[1].company_name == "ACME Oil" and got[1].description == "a longer text" and got[1].n_merged == 2
    assert {r.seq for r in resolve.by_name(spark.createDataFrame(rows, RECORD)).collect()} == {1, 2, 3}


def test_pairs(spark):
    rows = [record(1, "Nile Oil Tools Ltd"), record(2, "Nile oil-tools"), record(3, "Nile Tools Oil"), record(4, "Delta"), record(5, "")]
    assert {(r.seq_a, r.seq_b) for r in resolve.pairs(spark.createDataFrame(rows, RECORD)).collect()} == {(1, 3)}


def test_running_budget(spark):
    calls = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "b"), (4, "u", "b")], "n int, run string, provider string")
    got = {r.n: r.allowed for r in reports.running_budget(calls, ["run"], "provider", ["n"], 3, 1).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_changes(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "y", "y", None], ["y", "z"]))
    assert {(r.k, r.status) for r in reports.changes(a, b, "k").collect()} == {("x", "removed"), ("y", "kept"), ("z", "added")}


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_sinks(spark, tmp_path, fmt):
    df = fixtures.records(spark, SF)
    path = sinks.write(df, f"{tmp_path}/out", fmt)
    back = spark.read.option("header", True).format(fmt).load(path)
    assert back.count() == df.count() and set(back.columns) == set(sinks.shaped(df, "company").columns)
    assert sinks.write(df.limit(0), f"{tmp_path}/none", fmt) is None


def test_countries(spark):
    cells = ["From Cairo, and the U.S.A!", "romeo parisian", "عن مصر", None]
    got = [r.v for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(geo.countries_in(F.col("c")).alias("v")).collect()]
    assert got == [["egypt", "usa"], [], ["egypt"], []]


def test_stream_budget_has_the_last_day(spark):
    from seine.registered import plans

    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {(r.start, r.event_type): (r.n, r.remaining) for r in plans.QUERIES["stream_budget"](spark, SF).collect()}
    want = {(r.day, r.event_type): (r.n, max(0, 100 - r.n)) for r in events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
