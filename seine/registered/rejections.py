"""Queries over reasons of rejection, junk and places that records speak of, with planted notes, presences and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import domains
from seine.operators import filters, gazetteer, rejection
from seine.session import table
from seine.sources import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R = fixtures.RECORDS


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda values: "[" + ", ".join(map(_q, values)) + "]"

_WANT = rejection.Wanted(least_score=35, include=["Norway", "Egypt"], exclude=["USA"], exclude_presence=["Qatar"], strict=True)
_NOTED = """*, CASE WHEN seq % 9 = 0 THEN concat('kept; llm_rank:', seq % 11, '/10') ELSE '' END AS notes, CASE WHEN seq % 13 = 0 THEN 'Qatar' WHEN seq % 13 = 1 THEN ' Norway ' END AS spoken,
  CASE WHEN seq % 17 = 0 THEN 'slb.com' ELSE domain END AS site, CASE WHEN seq % 19 = 0 THEN 'Top 10 drilling firms' WHEN seq % 19 = 1 THEN 'Wells, a US-based company' ELSE company_name END AS called"""


def _noted(spark, d):
    rows = fixtures.records(spark, d).selectExpr("*", *[f"{x}" for x in ("CASE WHEN seq % 9 = 0 THEN concat('kept; llm_rank:', seq % 11, '/10') ELSE '' END AS notes", "CASE WHEN seq % 13 = 0 THEN array('Qatar') WHEN seq % 13 = 1 THEN array(' Norway ') END AS presence_countries")])
    called = F.when(F.col("seq") % 19 == 0, "Top 10 drilling firms").when(F.col("seq") % 19 == 1, "Wells, a US-based company").otherwise(F.col("company_name"))
    return rows.withColumn("company_name", called).withColumn("domain", F.when(F.col("seq") % 17 == 0, "slb.com").otherwise(F.col("domain")))


_PHRASES = " OR ".join(f"contains(told, {_q(p)})" for p in rejection.SEATS["usa"])
_add(
    "reject_reasons", lambda spark, d: rejection.rejected(_noted(spark, d), _WANT).select("seq", "reason"),
    f"""WITH n AS (SELECT {_NOTED} FROM {R}), t AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(notes, 'llm_rank:(\\d+)/10', 1), '') AS INTEGER), 0) AS k, lower(trim(called)) || ' ' || lower(trim(description)) AS told, lower(trim(coalesce(spoken, ''))) AS p,
    hq_country = '' AND country = '' AS unknown FROM n)
  SELECT seq, CASE WHEN confidence_score < 35 AND k < 8 THEN 'low_confidence(' || confidence_score::INTEGER || '<35)' WHEN is_directory_or_media AND k < 7 THEN 'directory_or_media'
    WHEN regexp_matches(lower(trim(called)), '{'|'.join(domains.DIRECTORY_TITLES)}') AND k < 8 THEN 'directory_or_media'
    WHEN hq_country = 'usa' OR country = 'usa' OR site IN ({', '.join(map(_q, domains.KNOWN_USA_DOMAINS))}) OR (unknown AND ({_PHRASES})) OR p = 'qatar'
      OR ((NOT unknown OR p <> '') AND NOT (hq_country IN ('norway', 'egypt') OR country IN ('norway', 'egypt') OR p IN ('norway', 'egypt'))) THEN 'geography_violation' END AS reason FROM t""",
)
_add("rejected_as_known", lambda spark, d: rejection.rejected(fixtures.named(spark, d).select("seq", "company_name", *[F.lit("").alias(c) for c in ("domain", "hq_country", "country", "description")], F.lit(50.0).alias("confidence_score"), F.lit(False).alias("is_directory_or_media")), rejection.Wanted(), fixtures.named(spark, d).filter("seq % 7 = 3").select("company_name", F.lit("").alias("domain"))).select("seq", "reason"))
_TERMS = (*filters.JUNK_TERMS, *filters.ACADEMIC, "plain", "words")
_JUNK = "|".join(filters.JUNK_TERMS)
_PAPER = "|".join(filters.ACADEMIC)
_SAID = f"lower(coalesce(text, '') || ' ' || {_list(_TERMS)}[doc_id % {len(_TERMS)} + 1])"


def _junk(spark, d):
    said = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("doc_id") % len(_TERMS) + 1).cast("int"))))
    return table(spark, d, "documents").select("doc_id", filters.junk_record(said).alias("junk"), filters.junk_record(said, papers=True).alias("junk_paper"))


_add("junk_records", _junk, f"SELECT doc_id, regexp_matches({_SAID}, '{_JUNK}') AS junk, regexp_matches({_SAID}, '{_JUNK}') OR NOT regexp_matches({_SAID}, '{_PAPER}') AS junk_paper FROM documents")


def _speaks(spark, d):
    """Whether a record's row speaks of a wanted, or of an excluded, country, by any spelling."""
    g = gazetteer.Gazetteer(spark)
    rows = fixtures.records(spark, d).select("seq", g.countries(F.concat_ws(" ", "company_name", "description", "country", "hq_country")).alias("c"))
    any_of = lambda *names: F.arrays_overlap("c", F.array(*map(F.lit, names)))
    return rows.select("seq", any_of("norway", "egypt").alias("wanted"), any_of("usa").alias("excluded"))


_add("ui_country_match", _speaks, f"SELECT seq, regexp_matches(lower(concat_ws(' ', description, country, hq_country)), 'norway|egypt') AS wanted, regexp_matches(concat_ws(' ', country, hq_country), 'usa') AS excluded FROM {R}")
