"""Queries over what search results and pages hold: people, papers, packs, evidence, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import html, text
from seine.operators import extract
from seine.session import table
from seine.sources import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_RESULT = """CASE doc_id % 2 WHEN 0 THEN 'Ann Lee - Drilling Lead - Delta | LinkedIn' ELSE '' END AS title, concat('https://linkedin.com/in/bob-van-', CASE doc_id % 3 WHEN 0 THEN 'dyk-12a' ELSE 'poe' END) AS url,
  concat('Works at Nile Oil', CAST(doc_id % 7 AS VARCHAR(2)), '. Location: Cairo, Egypt') AS snippet"""


def _results(spark, d):
    return spark.sql(f"SELECT doc_id, {_RESULT} FROM {{documents}}", documents=table(spark, d, "documents"))


_add(
    "person_from_result", lambda spark, d: _results(spark, d).select("doc_id", extract.person(F.col("title"), F.col("url"), F.col("snippet")).alias("p")).select("doc_id", "p.*"),
    """SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'Ann Lee' ELSE CASE doc_id % 3 WHEN 0 THEN 'Bob Van Dyk' ELSE 'Bob Van Poe' END END AS name, CASE doc_id % 2 WHEN 0 THEN 'Drilling Lead' ELSE '' END AS job_title,
      CASE doc_id % 2 WHEN 0 THEN 'Delta' ELSE 'Nile Oil' || (doc_id % 7) END AS employer, 'Cairo, Egypt' AS location FROM documents""",
)
_add("page_types", lambda spark, d: table(spark, d, "pages").select("page_id", extract.page_type(F.col("url"), html.title(F.col("html")), html.visible_text(F.col("html"))).alias("page_type")))
_PACKED = "concat(CASE doc_id % 3 WHEN 0 THEN 'Offshore drilling platform, oil and gas' WHEN 1 THEN 'cloud API analytics' ELSE 'nothing' END, '')"
_add(
    "domain_pack_rank", lambda spark, d: extract.pack_scores(table(spark, d, "documents").select("doc_id", F.expr(_PACKED).alias("t")), "doc_id", F.col("t")),
    """SELECT doc_id, unnest(['oil_gas', 'software']) AS pack, unnest([4, 1])::INTEGER AS points, unnest([1, 2])::INTEGER AS place FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 'software', 3, 1 FROM documents WHERE doc_id % 3 = 1""",
)
_WORDS = ["information", "the", "que", "und", "les"]
_add(
    "keyword_evidence", lambda spark, d: table(spark, d, "documents").select("doc_id", extract.evidence(F.col("text"), _WORDS).alias("e")).select("doc_id", F.array_join("e.terms", ",").alias("terms"), "e.confidence"),
    f"""SELECT doc_id, array_to_string(f, ',') AS terms, CASE WHEN len(f) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0, 0.4 + 0.1 * len(f)), 4)::DOUBLE END AS confidence
      FROM (SELECT doc_id, list_filter({_WORDS}, lambda k: contains(lower(coalesce(text, '')), k)) AS f FROM documents)""",
)
_add("directory_anchors", lambda spark, d: extract.anchors(table(spark, d, "pages"), "page_id", "url", "html"))
_PAPER = """concat('A study of wells ', CAST(1990 + doc_id % 30 AS VARCHAR(4))) AS title, CASE doc_id % 3 WHEN 0 THEN 'doi 10.1234/ab.cd).' WHEN 1 THEN 'see arxiv.org/abs/2101.12345' ELSE '' END AS body, concat('https://x.org/', CAST(doc_id AS VARCHAR(20))) AS url"""
_add(
    "paper_records", lambda spark, d: spark.sql(f"SELECT doc_id, {_PAPER} FROM {{documents}}", documents=table(spark, d, "documents")).select("doc_id", extract.paper(F.col("title"), F.col("body"), F.col("url")).alias("p")).select("doc_id", "p.*"),
    f"""SELECT doc_id, title, CASE doc_id % 3 WHEN 0 THEN '10.1234/ab.cd' ELSE '' END AS doi, right(title, 4) AS year, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1234/ab.cd' WHEN 1 THEN 'https://arxiv.org/abs/2101.12345' ELSE url END AS reference
      FROM (SELECT doc_id, {_PAPER} FROM documents)""",
)
_add("paper_focus", lambda spark, d: table(spark, d, "documents").select("doc_id", extract.focus(F.lit(""), F.col("text")).alias("focus")).select("doc_id", "focus", extract.takeaway("wells", F.col("focus"), F.lit(True), F.col("focus") == "software").alias("takeaway")))
_add(
    "company_summary", lambda spark, d: fixtures.records(spark, d).select("seq", extract.summary("company").alias("summary")),
    f"""SELECT seq, concat_ws(chr(10), 'Name: ' || nullif(company_name, ''), 'About: ' || nullif(description, ''), 'Seat: ' || nullif(hq_country, ''), 'Site: ' || nullif(website, '')) AS summary FROM {fixtures.RECORDS}""",
)
_add("masked_keys", lambda spark, d: table(spark, d, "documents").select("doc_id", text.mask(F.concat(F.lit("key"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "abcdef").otherwise(""))).alias("masked")), "SELECT doc_id, CASE WHEN length(k) <= 8 THEN '***' ELSE left(k, 4) || '***' || right(k, 2) END AS masked FROM (SELECT doc_id, 'key' || doc_id || CASE WHEN doc_id % 2 = 0 THEN 'abcdef' ELSE '' END AS k FROM documents)")
