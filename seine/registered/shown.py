"""Queries over what is shown and handed out of records, and which companies are."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import frames, summaries
from seine.registered.requests import _choose, _pick
from seine.session import table
from seine.sources import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R = fixtures.RECORDS


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_MORE = {
    "title": ("Untitled page", "nan", ""), "source_url": ("https://src.org/p", " ", "none"), "authors": ("Ann Lee", "", "null"), "publication_year": ("2020", ""), "summary": ("", " short  text ", "nan"),
    "linkedin_profile": ("https://linkedin.com/in/a", ""), "employer_name": ("Acme", ""), "job_title": ("", "Engineer"), "city": ("Oslo", "", "  "), "doi": ("", "10.1/x"),
}


def _rows(spark, d):
    return fixtures.records(spark, d).select("*", *[_choose(v, F.col("seq")).alias(k) for k, v in _MORE.items()])


_ROWS = f"(SELECT *, {', '.join(f'{_pick(v, chr(115) + chr(101) + chr(113))} AS {k}' for k, v in _MORE.items())} FROM {R})"


def _of(*names: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN lower(trim({n})) NOT IN ('', 'nan', 'none', 'null') THEN trim(regexp_replace({n}, '\\s+', ' ', 'g')) END" for n in names) + ", '')"


_NAME, _LINK, _SUMMARY, _PROFILE = _of("company_name", "title"), _of("website", "source_url"), _of("summary", "description"), _of("linkedin_profile", "linkedin_url")
_add("shown_papers", lambda spark, d: frames.shown(_rows(spark, d), "paper"), f"SELECT seq, {_NAME} AS title, {_LINK} AS link, {_of('authors')} AS authors, {_of('publication_year')} AS year, {_SUMMARY}[1:320] AS summary FROM {_ROWS}")
_add("shown_people", lambda spark, d: frames.shown(_rows(spark, d), "person"), f"SELECT seq, {_NAME} AS name, {_of('linkedin_profile', 'linkedin_url', 'website')} AS link, {_of('employer_name')} AS employer, {_of('job_title')} AS job_title, {_of('city', 'country')} AS location, {_SUMMARY}[1:260] AS summary FROM {_ROWS}")
_add("shown_companies", lambda spark, d: frames.shown(_rows(spark, d), "company"), f"SELECT seq, {_NAME} AS name, {_LINK} AS link, {_of('email')} AS email, {_of('phone')} AS phone, {_PROFILE} AS linkedin, {_SUMMARY}[1:240] AS summary FROM {_ROWS}")
_add("handed_out", lambda spark, d: frames.handed_out(_rows(spark, d), True), f"SELECT seq, {_NAME} AS name, CASE WHEN {_PROFILE} <> '' THEN {_PROFILE} ELSE {_LINK} END AS link, {_of('email')} AS email, {_of('phone')} AS phone, {_PROFILE} AS linkedin, {_SUMMARY} AS summary FROM {_ROWS}")
_add("paper_summary_rows", lambda spark, d: frames.paper_summaries(_rows(spark, d)), f"SELECT seq, CASE WHEN {_NAME} = '' THEN 'Untitled' ELSE {_NAME} END AS title, {_LINK} AS link, {_of('authors')} AS authors, {_of('publication_year')} AS year, {_of('doi')} AS doi, {_SUMMARY} AS summary FROM {_ROWS}")
_add("markdown_rows", lambda spark, d: frames.markdown(_rows(spark, d), ["company_name", "email", "country"]), f"SELECT seq, '| ' || {_of('company_name')} || ' | ' || {_of('email')} || ' | ' || {_of('country')} || ' |' AS line FROM {_ROWS}")

_ASKED = frames.Asked(category="software_company", include=["Norway"], exclude=["Egypt"], exclude_presence=["Qatar"], strict=True)
_SITES = ("", "https://www.wikipedia.org/wiki/x", "https://a.org/news/1", "https://a.org/home", "https://x.com")


def _valid(spark, d):
    rows = _rows(spark, d).withColumn("website", F.when(F.col("seq") % 3 == 0, _choose(_SITES, F.col("seq"))).otherwise(F.col("website"))).withColumn("location", _choose(("Doha", "", "Stavanger", "the best list"), F.col("seq")))
    return rows.select("seq", frames.valid_company(rows.columns, _ASKED, frames.text(rows.columns)).alias("valid"))


_any = lambda c, pieces: "(" + " OR ".join(f"contains({c}, '{p}')" for p in pieces) + ")"
_add(
    "ui_valid_companies", _valid,
    f"""WITH r AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN {_pick(_SITES, 'seq')} ELSE website END AS website), {_pick(('Doha', '', 'Stavanger', 'the best list'), 'seq')} AS location FROM {_ROWS}),
  t AS (SELECT *, lower(trim(regexp_replace({" || ' ' || ".join(_of(n) for n in ('company_name', 'description', 'summary', 'website', 'linkedin_url', 'hq_country', 'country', 'location', 'city', 'title'))}, '\\s+', ' ', 'g'))) AS h,
    regexp_replace(regexp_replace(lower(website), '^https?://(www[.])?', ''), '[/?#:].*$', '') AS host, regexp_extract(lower(website), '^https?://[^/]*(/.*)$', 1) AS path FROM r)
  SELECT seq, ({_of('company_name')} <> '' OR website <> '') AND NOT {_any('host', frames.BAD_HOSTS)} AND NOT {_any('path', frames.BAD_PATHS)} AND NOT {_any('h', frames.BAD_TEXTS)}
    AND NOT (len(string_split({_of('company_name')}, ' ')) > 10 AND {_any('h', frames.OF_LISTS)}) AND {_any('h', frames.DIGITAL)} AND (website <> '' OR {_any('h', frames.COMPANYISH)})
    AND regexp_matches(h, '{frames.patterns(['Norway'])}') AND NOT regexp_matches(h, '{frames.patterns(['Qatar'])}') AND NOT regexp_matches(h, '{frames.patterns(['Egypt'])}') AS valid FROM t""",
)
_CODES, _KINDS = ("entity_discovery", "people_search", "other", ""), ("general", "software_company", "new_kind_of", "")
_add(
    "ui_labels", lambda spark, d: table(spark, d, "documents").select("doc_id", frames.task_label(_choose(_CODES, F.col("doc_id"))).alias("task"), frames.category_label(_choose(_KINDS, F.col("doc_id"))).alias("category")),
    f"SELECT doc_id, {_pick(('Companies', 'LinkedIn Profiles', 'Results', 'Results'), 'doc_id')} AS task, {_pick(('General results', 'Digital / software companies', 'New Kind Of', 'General results'), 'doc_id')} AS category FROM documents",
)
_FILES = (" a.PDF ", "b.docx", "c", "", "d.csv.json")
_add(
    "ui_file_names", lambda spark, d: table(spark, d, "documents").select("doc_id", frames.file_name(_choose(_FILES, F.col("doc_id")), F.lit(".docx")).alias("file")),
    f"SELECT doc_id, {_pick(('a.docx', 'b.docx', 'c.docx', 'results.docx', 'd.csv.docx'), 'doc_id')} AS file FROM documents",
)


def _hints(spark, d):
    """Regions as packs whose hints are their nations; each customer has two packs."""
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("pack"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("kind"), F.col("n_nationkey").alias("place"), F.substring("n_name", 1, 1).alias("value"))
    n = F.col("c_custkey")
    chosen = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.struct((n % 5).alias("pack"), F.lit(0).alias("rank")), F.struct(((n + 2) % 5).alias("pack"), F.lit(1).alias("rank")))).alias("c")).select("c_custkey", "c.pack", "c.rank")
    return frames.merged_hints(nations, chosen, "c_custkey")


_add(
    "pack_hints", _hints,
    """WITH c AS (SELECT c_custkey, unnest([c_custkey % 5, (c_custkey + 2) % 5]) AS pack, unnest([0, 1]) AS rank FROM customer),
  m AS (SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, n_name[1] AS value, min(rank * 1000 + n_nationkey) AS o FROM c JOIN nation ON n_regionkey = pack GROUP BY ALL)
  SELECT c_custkey, kind, (row_number() OVER (PARTITION BY c_custkey, kind ORDER BY o) - 1)::INTEGER AS n, value FROM m""",
)

_TALK = ("We drill wells. We log them! And more. ", "", "One sentence only", "Is it so? It is.  Yes.")


def _summarised(spark, d):
    rows = fixtures.records(spark, d).withColumn("description", F.concat(_choose(_TALK, F.col("seq")), "description")).withColumn("notes", _choose(("", "noted", "  "), F.col("seq")))
    return summaries.summarised(rows, "company").select("seq", "summary_text", "notes")


_TOLD = f"""trim(regexp_replace(concat_ws(' ', nullif({_of("company_name")}, ''), nullif({_of("description")}, ''), nullif({_of("hq_country", "country")}, ''), nullif({_of("website")}, '')), '\\s+', ' ', 'g'))"""
_add(
    "summarised", _summarised,
    f"""WITH r AS (SELECT seq, company_name, {_pick(_TALK, 'seq')} || description AS description, hq_country, country, website, {_pick(('', 'noted', '  '), 'seq')} AS notes FROM {R}),
  s AS (SELECT seq, notes, array_to_string(list_filter(string_split(regexp_replace({_TOLD}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:2], ' ') AS summary_text FROM r)
  SELECT seq, summary_text, CASE WHEN trim(notes) <> '' THEN notes ELSE summary_text END AS notes FROM s""",
)
