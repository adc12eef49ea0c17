"""Queries over unions, votes, plans and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import geo
from seine.operators import filters, sinks, unions
from seine.registered.records import _KEY, _merge_sql
from seine.session import table
from seine.sources import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R = fixtures.RECORDS


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _records(f):
    return lambda spark, d: f(fixtures.records(spark, d))


# --- lists and texts --------------------------------------------------------------------------------------------------

_add(
    "union_terms", _records(lambda r: r.select("seq", F.array_join(unions.ordered_union(F.array("country", "source_provider"), F.array("hq_country", F.lit(" exa "))), ",").alias("terms"))),
    f"SELECT seq, concat_ws(',', nullif(country, ''), source_provider, CASE WHEN hq_country NOT IN ('', country) THEN hq_country END, CASE WHEN source_provider <> 'exa' THEN 'exa' END) AS terms FROM {R}",
)
_SPOKEN = "concat(coalesce(text, ''), CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN ' Find wells. Find wells.  Rank them.' WHEN 1 THEN ' Find wells. Rank them. Find wells.' ELSE '' END)"
_add(
    "repeated_sentences", lambda spark, d: table(spark, d, "documents").select("doc_id", unions.without_repeats(F.expr(_SPOKEN)).alias("prompt")),
    f"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ' ') AS prompt FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace({_SPOKEN}, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents)""",
)
_vote = lambda words: "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"
_SERVICE, _SOFTWARE = (_vote(unions.CATEGORY_ALIASES[k]) for k in ("service_company", "software_company"))
_add(
    "category_vote", lambda spark, d: table(spark, d, "documents").select("doc_id", unions.voted(F.col("text"), unions.CATEGORY_ALIASES).alias("category")),
    f"""SELECT doc_id, CASE WHEN {_SERVICE} = 0 AND {_SOFTWARE} = 0 THEN 'general' WHEN {_SERVICE} >= {_SOFTWARE} THEN 'service_company' ELSE 'software_company' END AS category
      FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""",
)
_add(
    "severity_counts", lambda spark, d: table(spark, d, "documents").select("doc_id", *unions.occurrences(F.col("text"))),
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{w}')) AS {w}" for w in unions.SEVERITIES) + " FROM documents",
)


def _presence():
    return F.filter(F.array("country", "hq_country"), lambda c: c != "")


_add(
    "cluster_by_list", _records(lambda r: unions.list_clusters(r, _presence())),
    f"SELECT cluster, count(*) AS n FROM (SELECT unnest(CASE WHEN country = '' AND hq_country = '' THEN ['Unknown'] ELSE list_filter([country, hq_country], lambda c: c <> '') END) AS cluster FROM {R}) GROUP BY 1",
)
_add(
    "locations", _records(lambda r: r.select("seq", F.trim("company_name").alias("company_name"), "country", "hq_country", F.array_join(_presence(), ", ").alias("presence_countries"))),
    f"SELECT seq, trim(company_name) AS company_name, country, hq_country, concat_ws(', ', nullif(country, ''), nullif(hq_country, '')) AS presence_countries FROM {R}",
)
_add(
    "country_evidence", _records(lambda r: r.select("seq", F.explode(geo.countries_in(F.col("description"))).alias("country")).withColumn("confidence", F.lit(0.8))),
    f"SELECT seq, country, 0.8::DOUBLE AS confidence FROM (SELECT seq, unnest(list_filter(['norway', 'egypt'], lambda c: contains(lower(description), c))) AS country FROM {R})",
)

# --- people, plans and budgets ----------------------------------------------------------------------------------------

_FIRST = f"(SELECT * FROM {R} QUALIFY (linkedin_url = '' AND website = '') OR row_number() OVER (PARTITION BY coalesce(nullif(linkedin_url, ''), website) ORDER BY seq) = 1)"
_PAIR = f"nullif({_KEY} || '|' || source_provider, '|')"
_add("er_people", _records(lambda r: unions.people(r, F.col("source_provider"))), _merge_sql(_PAIR).replace(R, _FIRST))
_add(
    "dedup_profiles", _records(lambda r: unions.new_profiles(r.select("seq", "company_name", "linkedin_url"), r.filter("seq % 13 = 5 or seq % 29 = 12"), "linkedin_url", "company_name", ["seq"]).select("seq")),
    f"""WITH r AS (SELECT seq, lower(linkedin_url) AS u, {_KEY} AS k FROM {R}), k AS (SELECT * FROM r WHERE seq % 13 = 5 OR seq % 29 = 12), f AS (SELECT * FROM r WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY u ORDER BY seq) = 1)
      SELECT seq FROM f WHERE u NOT IN (SELECT u FROM k WHERE u <> '') AND k NOT IN (SELECT k FROM k WHERE k <> '')""",
)
_PLANNED = "SELECT source_provider AS provider, company_name AS text FROM {r} WHERE seq % 3 = 0"
_EXTRA = "SELECT source_provider AS provider, seq, concat(' ', company_name) AS text FROM {r}"
_add(
    "plan_extra_queries", _records(lambda r: unions.new_queries(r.filter("seq % 3 = 0").selectExpr("source_provider AS provider", "company_name AS text"), r.selectExpr("source_provider AS provider", "seq", "concat(' ', company_name) AS text"), 3)),
    f"""WITH p AS ({_PLANNED.format(r=R)}), e AS (SELECT *, lower(trim(text)) AS k FROM ({_EXTRA.format(r=R)})),
      f AS (SELECT * FROM e WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.provider = e.provider AND lower(trim(p.text)) = e.k) QUALIFY row_number() OVER (PARTITION BY provider, k ORDER BY seq) = 1)
      SELECT provider, seq, text FROM f QUALIFY row_number() OVER (PARTITION BY provider ORDER BY seq) <= 3""",
)
_add(
    "critic_query_plan", _records(lambda r: unions.plan_issues(r.select(F.col("source_provider").alias("plan"), F.col("description").alias("text")), "plan", ["norway", "egypt"], ["wireline"])),
    f"""SELECT *, concat_ws(',', CASE WHEN geo_hits = 0 THEN 'missing_geo_in_queries' END, CASE WHEN domain_hits = 0 THEN 'missing_domain_keywords' END) AS issues FROM (
      SELECT source_provider AS plan, count(*) AS n, count(*) FILTER (contains(lower(description), 'norway') OR contains(lower(description), 'egypt')) AS geo_hits, count(*) FILTER (contains(lower(description), 'wireline')) AS domain_hits FROM {R} GROUP BY 1)""",
)
_add(
    "remaining_calls", lambda spark, d: unions.remaining(table(spark, d, "events").select("event_type"), table(spark, d, "events").filter("value > 50"), "event_type", {"click": 1200, "view": 30}),
    """SELECT event_type, greatest(0, CASE event_type WHEN 'click' THEN 1200 WHEN 'view' THEN 30 ELSE 0 END - count(*) FILTER (value > 50))::BIGINT AS remaining FROM events GROUP BY event_type""",
)
_add(
    "issue_summary", _records(lambda r: r.select("source_provider", filters.reject_reason(35.0, ["usa"]).alias("reason")).groupBy("source_provider").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("issues"))),
    f"""SELECT source_provider, coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason), '') AS issues FROM (SELECT source_provider, CASE WHEN company_name = '' AND website = '' THEN 'missing_identity' WHEN is_directory_or_media THEN 'directory_or_media'
      WHEN page_type IN ('directory', 'media', 'blog') THEN 'page_type' WHEN hq_country = 'usa' OR country = 'usa' THEN 'excluded_country' WHEN confidence_score < 35 THEN 'low_score' END AS reason FROM {R}) GROUP BY 1""",
)
_add(
    "final_limit", _records(lambda r: r.filter(filters.reject_reason(35.0, ["usa"]).isNull()).orderBy("seq").limit(20).select("seq")),
    f"SELECT seq FROM {R} WHERE (company_name <> '' OR website <> '') AND NOT is_directory_or_media AND page_type NOT IN ('directory', 'media', 'blog') AND hq_country <> 'usa' AND country <> 'usa' AND confidence_score >= 35 ORDER BY seq LIMIT 20",
)
_add("export_paper", _records(lambda r: sinks.shaped(r, "paper")), f"SELECT company_name AS title, description, confidence_score FROM {R}")
