"""Queries over records: filters, resolution, scores, reports, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import domains, geo, html, text, urls
from seine.operators import filters, numbering, reports, resolve, score
from seine.registered.texts import _CLEAN_NAME, _HOST, _VISIBLE
from seine.registered.texts import ORACLES as ORACLES_OF_TEXTS
from seine.session import table
from seine.sources import fixtures, seeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R = fixtures.RECORDS
SOFTWARE = score.Wanted(category="software_company", sector="oil and gas", include_countries=["norway"])
WELLS = score.Wanted(domain_keywords=["wireline"], include_countries=["egypt"])


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _records(f):
    return lambda spark, d: f(fixtures.records(spark, d))


def flagship(spark, d):
    """Pages to ranked records: extract, filter, one record for each domain, score, the best 25."""
    read = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url", "html")
    # titles of lists go before the first page of a domain is chosen; texts are made of the chosen pages alone
    named = text.fenced(read, {"domain": urls.domain(F.col("url")), "company_name": html.title(F.col("html"))})
    kept = named.filter((F.col("domain") != "") & ~filters.excluded_domain(F.col("domain")) & ~filters.directory_title(F.col("company_name")))
    chosen = kept.groupBy("domain").agg(F.min("seq").alias("seq"), F.min_by("company_name", "seq").alias("company_name"))
    first = chosen.join(read, "seq").select("seq", "domain", urls.normal_url(F.col("url")).alias("website"), "company_name", html.visible_text(F.col("html")).alias("description"))
    found = first.select("*", F.array_join(text.emails(F.col("description")), ",").alias("email"), F.lit("").alias("phone"), F.lit("company").alias("page_type"), F.lit(False).alias("is_directory_or_media"), F.lit("").alias("contact_page"), F.lit("").alias("linkedin_url"))
    told = text.fenced(found, {"hay": filters.blob("company_name", "description", "website", "contact_page", "linkedin_url")})
    scored = told.withColumn("score", score.score(score.Wanted(category="software_company"), F.col("hay")))
    return scored.select("seq", "domain", "website", "company_name", "email", "score").orderBy(F.desc("score"), "seq").limit(25)


_add("rec_ranked_pages", flagship)
_add(
    "dedup_seen_domain", lambda spark, d: filters.keep_first(table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host")), ["host"], ["page_id"]),
    f"SELECT min(page_id) AS page_id, h AS host FROM (SELECT page_id, {_HOST.format(u='url')} AS h FROM pages) GROUP BY h",
)
_add("rank_per_provider", _records(lambda r: numbering.numbered(r.select("seq", "source_provider"), ["source_provider"], ["seq"], "rank")), f"SELECT seq, source_provider, row_number() OVER (PARTITION BY source_provider ORDER BY seq)::INTEGER AS rank FROM {R}")
_add("cap_per_provider", _records(lambda r: filters.capped(r.select("seq", "source_provider"), ["source_provider"], ["seq"], 7)), f"SELECT seq, source_provider FROM {R} QUALIFY row_number() OVER (PARTITION BY source_provider ORDER BY seq) <= 7")
_add("batch_index", _records(lambda r: numbering.numbered(r.select("seq", "source_provider"), ["source_provider"], ["seq"], "rank").select("seq", F.floor((F.col("rank") - 1) / 10).alias("batch"))), f"SELECT seq, ((row_number() OVER (PARTITION BY source_provider ORDER BY seq) - 1) // 10)::BIGINT AS batch FROM {R}")
_add("anti_known_companies", lambda spark, d: resolve.anti_known(fixtures.records(spark, d), fixtures.records(spark, d).filter("seq % 10 = 3"), "domain").select("seq", "domain"), f"SELECT seq, domain FROM {R} r WHERE domain = '' OR domain NOT IN (SELECT domain FROM {R} k WHERE seq % 10 = 3 AND domain <> '')")
_QUALITY = """((company_name <> '')::INT * 8 + (website <> '')::INT * 10 + (domain <> '')::INT * 8 + (email <> '')::INT * 6 + (phone <> '')::INT * 5 + (linkedin_url <> '')::INT * 4 + (contact_page <> '')::INT * 3
  + (hq_country <> '')::INT * 4 + (country <> '')::INT * 2 + least(length(description) // 40, 12) + CASE WHEN page_type = 'company' THEN 5 WHEN page_type IN ('directory', 'media', 'blog') THEN -8 ELSE 0 END + floor(floor(confidence_score) / 5)::INT)::INTEGER"""
_add("er_quality", _records(lambda r: r.select("seq", score.quality().alias("quality"))), f"SELECT seq, {_QUALITY} AS quality FROM {R}")


def _merge_sql(key: str) -> str:
    best = lambda c: f"coalesce(arg_max(nullif({c}, ''), ROW(q, -seq)) FILTER ({c} <> ''), '') AS {c}"
    least = lambda c: f"coalesce(arg_min({c}, ROW(length({c}), seq)) FILTER ({c} <> ''), '') AS {c}"
    return f"""SELECT min(seq) AS seq, {", ".join(best(c) for c in resolve.FIELDS)}, {least("website")}, {least("domain")},
      arg_max(description, ROW(length(description), -seq)) AS description, CASE WHEN bool_or(page_type = 'company') THEN 'company' ELSE arg_max(page_type, ROW(q, -seq)) END AS page_type,
      bool_and(is_directory_or_media) AS is_directory_or_media, max(confidence_score) AS confidence_score, count(*) AS n_merged
      FROM (SELECT *, {_QUALITY} AS q, {key} AS k FROM {R}) GROUP BY CASE WHEN k <> '' THEN k ELSE chr(1) || seq END"""


_add("er_merge_by_domain", _records(resolve.by_domain), _merge_sql("domain"))
_KEY = "array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(company_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in resolve.names.KEY_NOISE) + ")), ' ')"
_add("er_merge_by_name", _records(resolve.by_name), _merge_sql(_KEY))
_add("er_fuzzy_pairs", _records(resolve.pairs))
_add("er_dedup_final", _records(resolve.dedup))
_add("er_similar_names", lambda spark, d: resolve.pairs(fixtures.named(spark, d)))
_add("er_accepted_names", lambda spark, d: resolve.accepted(fixtures.named(spark, d)))
_add("er_company_key", _records(lambda r: r.select("seq", F.when(F.col("domain") != "", F.col("domain")).otherwise(resolve.names.clean_name(F.col("company_name"))).alias("key"))), f"SELECT seq, CASE WHEN domain <> '' THEN domain ELSE {_CLEAN_NAME} END AS key FROM {R}")

# --- scores and verdicts --------------------------------------------------------------------------------------------

_HAY = "lower(concat_ws(' ', company_name, description, website, contact_page, linkedin_url))"
_n = lambda terms: "(" + " + ".join(f"contains(h, '{t}')::INT" for t in terms) + ")"
_BASE = f"(company_name <> '')::INT * 8 + (website <> '')::INT * 10 + (email <> '')::INT * 8 + (phone <> '')::INT * 5 + (page_type IN ('company', 'document'))::INT * 8 - is_directory_or_media::INT * 25 - ({_n(score.BAD_NEWS)} > 0)::INT * 35"
_SOFT, _OIL, _NORTH = _n(score.SOFTWARE), _n(score.OIL_GAS), _n(score.NORWAY)
_add(
    "score_software", _records(lambda r: r.select("seq", score.score(SOFTWARE).alias("score"))),
    f"""SELECT seq, greatest(0, least(100, {_BASE} + least({_SOFT} * 4, 20) - ({_SOFT} = 0)::INT * 25 - ({_SOFT} < 2 AND {_n(score.SERVICES)} > 0)::INT * 35 + least({_OIL} * 2, 12)
      + CASE WHEN {_NORTH} > 0 THEN 18 ELSE -30 END + CASE WHEN {_SOFT} >= 2 AND {_OIL} >= 1 THEN 18 ELSE -28 END - ({_n(score.ENTERPRISE)} > 0 AND ({_OIL} = 0 OR {_NORTH} = 0))::INT * 30
      + CASE WHEN contains(h, 'norway') THEN 10 ELSE -18 END))::DOUBLE AS score FROM (SELECT *, {_HAY} AS h FROM {R})""",
)
_add(
    "score_wells", _records(lambda r: r.select("seq", score.score(WELLS).alias("score"))),
    f"""SELECT seq, greatest(0, least(100, {_BASE} + CASE WHEN {_OIL} > 0 THEN least({_OIL} * 2, 12) ELSE 0 END + CASE WHEN {_n(score.WIRELINE)} > 0 THEN 18 ELSE -35 END - (NOT contains(h, 'egypt'))::INT * 45
      + ({_n(score.EVENT)} > 0)::INT * 15 + CASE WHEN contains(h, 'egypt') THEN 10 ELSE -18 END))::DOUBLE AS score FROM (SELECT *, {_HAY} AS h FROM {R})""",
)
_add("score_reviewed", _records(lambda r: r.select("seq", score.ranked(F.col("confidence_score"), F.when(F.col("seq") % 3 > 0, F.col("seq") % 11), F.col("seq") % 5 != 0).alias("score"))), f"""SELECT seq, greatest(0, m - CASE WHEN seq % 5 = 0 THEN 15 ELSE 0 END)::DOUBLE AS score FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN s WHEN seq % 11 >= 8 THEN least(100, s + 15) WHEN seq % 11 >= 5 THEN s WHEN seq % 11 >= 3 THEN s - 20 ELSE s - 45 END AS m
  FROM (SELECT seq, confidence_score AS s FROM {R}))""")
_add("reject_reason", _records(lambda r: r.select("seq", filters.reject_reason(35.0, ["usa"], True).alias("reason"))), f"""SELECT seq, CASE WHEN company_name = '' AND website = '' THEN 'missing_identity' WHEN is_directory_or_media THEN 'directory_or_media' WHEN page_type IN ('directory', 'media', 'blog') THEN 'page_type'
  WHEN hq_country = 'usa' OR country = 'usa' THEN 'excluded_country' WHEN email = '' AND phone = '' THEN 'missing_contact' WHEN confidence_score < 35 THEN 'low_score' END AS reason FROM {R}""")
_add("verify_split", _records(lambda r: r.select("seq", filters.validated("company").alias("v"), "confidence_score").select("seq", (F.col("v.accepted") & (F.greatest(F.lit(0.0), F.col("confidence_score") + F.col("v.score_delta")) >= 30)).alias("accepted"))), f"SELECT seq, (company_name <> '' OR website <> '') AND greatest(0, confidence_score - CASE WHEN email = '' AND phone = '' THEN 5 ELSE 0 END) >= 30 AS accepted FROM {R}")
_add("junk_filter", lambda spark, d: table(spark, d, "documents").filter(~filters.junk(F.lower("text"))).select("doc_id"), f"SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), '{'|'.join(filters.JUNK_TERMS)}')")
_add("ui_refine_fallback", _records(lambda r: filters.refine(r.select("seq", "confidence_score"), F.col("confidence_score") > 1000).select("seq")), f"SELECT seq FROM {R}")
_LISTED = "CASE CAST(page_id % 5 AS INTEGER) WHEN 0 THEN ': List of companies' WHEN 1 THEN ' - Top 10 firms' WHEN 2 THEN ' newsletter jobsite' ELSE '' END"
_add("directory_titles", lambda spark, d: table(spark, d, "pages").select("page_id", F.concat(html.title(F.col("html")), F.expr(_LISTED)).alias("t")).filter(filters.directory_title(F.col("t"))).select("page_id"), f"SELECT page_id FROM (SELECT page_id, title || {_LISTED} AS t FROM ({ORACLES_OF_TEXTS['html_title']}) q) WHERE regexp_matches(lower(trim(t)), '{'|'.join(domains.DIRECTORY_TITLES)}')")
_add("top_records", _records(lambda r: r.orderBy(F.desc("confidence_score"), "seq").limit(10).select("seq", "confidence_score")), f"SELECT seq, confidence_score FROM {R} ORDER BY confidence_score DESC, seq LIMIT 10")
_add("top_seeds", _records(lambda r: r.filter("website <> ''").orderBy(F.desc("confidence_score"), "seq").limit(3).select("seq", "website")), f"SELECT seq, website FROM {R} WHERE website <> '' ORDER BY confidence_score DESC, seq LIMIT 3")

# --- reports --------------------------------------------------------------------------------------------------------

_add("cluster_by_field", _records(lambda r: reports.cluster_counts(r, F.col("hq_country"))), f"SELECT CASE WHEN hq_country = '' THEN 'Unknown' ELSE hq_country END AS cluster, count(*) AS n FROM {R} GROUP BY 1")
_TOPICS = ["cloud", "wireline", "drilling", "news"]
_add("cluster_by_keyword", _records(lambda r: reports.keyword_clusters(r, filters.blob("company_name", "description"), _TOPICS)), f"""SELECT cluster, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN f ELSE ['Unclustered'] END) AS cluster
  FROM (SELECT list_filter({_TOPICS}, lambda k: contains(lower(company_name || ' ' || description), k)) AS f FROM {R})) GROUP BY 1""")
_add("geo_footprint", _records(lambda r: reports.cluster_counts(r, text.first_filled(F.col("hq_country"), F.col("country")))), f"SELECT coalesce(nullif(hq_country, ''), nullif(country, ''), 'Unknown') AS cluster, count(*) AS n FROM {R} GROUP BY 1")
_add("gap_report", _records(reports.gaps), f"""WITH r AS (SELECT * FROM {R}) SELECT * FROM (SELECT 'country' AS measure, country AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'page_type', page_type, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'provider', source_provider, count(*) FROM r GROUP BY 2) WHERE value <> ''
  UNION ALL SELECT 'gap', 'no_contact', count(*) FILTER (email = '' AND phone = '') FROM r UNION ALL SELECT 'gap', 'no_website', count(*) FILTER (website = '') FROM r UNION ALL SELECT 'gap', 'low_score', count(*) FILTER (confidence_score < 40) FROM r""")
_add("critic_results", _records(lambda r: reports.critic(r, 60.0)), f"SELECT * FROM (SELECT 'low_scores' AS issue, round(count(*) FILTER (confidence_score < 60) / count(*), 4) AS share FROM {R} UNION ALL SELECT 'weak_geography', round(count(*) FILTER (country = '' AND hq_country = '') / count(*), 4) FROM {R}) WHERE share > 0.5")
_OLD, _NEW = "o_orderdate < timestamp '1996-01-01 00:00:00'", "o_orderdate >= timestamp '1995-01-01 00:00:00'"
_add("snapshot_diff", lambda spark, d: reports.changes(table(spark, d, "orders").filter(_OLD), table(spark, d, "orders").filter(_NEW), "o_custkey"), f"""SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS status
  FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_OLD}) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_NEW}) b ON a.k = b.k""")
_add("snapshot_counts", lambda spark, d: QUERIES["snapshot_diff"](spark, d).groupBy("status").agg(F.count("*").alias("n")), f"SELECT status, count(*) AS n FROM ({ORACLES['snapshot_diff']}) GROUP BY status")


def _eval(spark, d):
    n = table(spark, d, "benchmark").count()
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case"), F.array_distinct(text.keywords(F.col("text"))).alias("terms")).filter(F.size("terms") > 0)
    docs = table(spark, d, "documents").select((F.col("doc_id") % F.lit(max(1, n))).alias("case"), F.lower("text").alias("text"))
    return reports.evaluate(cases, docs)


_EVAL = """SELECT "case", count(*) AS n_terms, count(*) FILTER (hit) AS n_hit, round(count(*) FILTER (hit) / count(*), 4) AS recall, count(*) FILTER (hit) = count(*) AS passed FROM (
  SELECT c."case", term, coalesce(bool_or(contains(d.t, term)), false) AS hit FROM (SELECT DISTINCT item_id AS "case", unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark) c
  LEFT JOIN (SELECT doc_id % (SELECT greatest(1, count(*)) FROM benchmark) AS "case", lower(text) AS t FROM documents) d ON c."case" = d."case" GROUP BY ALL) GROUP BY "case\""""
_add("eval_case", _eval, _EVAL)
_add("eval_suite", lambda spark, d: reports.suite(_eval(spark, d)), f"SELECT count(*) AS n_cases, count(*) FILTER (passed) AS n_passed, round(avg(recall), 4) AS mean_recall FROM ({_EVAL})")
_add("compare_table", _records(lambda r: r.select("seq", "company_name", "website", F.concat_ws(", ", F.nullif("country", F.lit("")), F.nullif("hq_country", F.lit(""))).alias("countries"))), f"SELECT seq, company_name, website, concat_ws(', ', nullif(country, ''), nullif(hq_country, '')) AS countries FROM {R}")
_add("contacts", _records(lambda r: r.filter("email <> '' or phone <> '' or linkedin_url <> ''").select("seq", text.first_filled(F.col("website"), F.col("contact_page")).alias("site"), "email", "phone")), f"SELECT seq, coalesce(nullif(website, ''), nullif(contact_page, ''), '') AS site, email, phone FROM {R} WHERE email <> '' OR phone <> '' OR linkedin_url <> ''")
_add("outreach_brief", _records(lambda r: r.select("seq", F.concat_ws("\n", F.concat(F.lit("Target: "), F.col("company_name")), F.when(F.col("country") != "", F.concat(F.lit("Country: "), F.col("country"))), F.when(F.col("description") != "", F.concat(F.lit("About: "), F.substring("description", 1, 400)))).alias("brief"))), f"SELECT seq, concat_ws(chr(10), 'Target: ' || company_name, CASE WHEN country <> '' THEN 'Country: ' || country END, CASE WHEN description <> '' THEN 'About: ' || left(description, 400) END) AS brief FROM {R}")
_add("export_company", _records(lambda r: r.select("company_name", "website", "email", "phone", "country", F.bround("confidence_score", 0).alias("score"))), f"SELECT company_name, website, email, phone, country, confidence_score AS score FROM {R}")

# --- budgets, caches, vectors -----------------------------------------------------------------------------------------

_add("budget_running", lambda spark, d: reports.running_budget(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id"], "event_type", ["ts", "event_id"], 30, 8).select("event_id", "allowed"), """SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 30)
  AND (count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 8) AS allowed FROM events""")
_add("budget_summary", lambda spark, d: reports.budget_summary(table(spark, d, "events"), "event_type", 2100), "SELECT event_type, count(*) AS used, 2100::BIGINT AS most, greatest(0, 2100 - count(*))::BIGINT AS remaining FROM events GROUP BY event_type")
_NOW = "timestamp '2024-01-25 00:00:00'"
_add("cache_ttl_latest", lambda spark, d: reports.latest(table(spark, d, "events").filter(f"ts <= {_NOW}"), ["user_id", "event_type"], "ts", F.expr(_NOW), 7 * 86_400).select("user_id", "event_type", "event_id"), f"SELECT user_id, event_type, event_id FROM events WHERE ts <= {_NOW} AND floor(epoch(ts)) >= epoch({_NOW}) - 604800 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
_add("cache_purge", lambda spark, d: table(spark, d, "events").agg(F.count_if(F.unix_timestamp("ts") < F.unix_timestamp(F.expr(_NOW)) - 7 * 86_400).alias("purged")), f"SELECT count(*) FILTER (floor(epoch(ts)) < epoch({_NOW}) - 604800) AS purged FROM events")
_add("provider_weights", lambda spark, d: reports.weights(table(spark, d, "nation").select("n_name", (F.col("n_nationkey") + 1).alias("p")), "n_name", "p"), "SELECT n_name, round((n_nationkey + 1) / sum(n_nationkey + 1) OVER (), 4) AS weight FROM nation")
_add("similar_topk", lambda spark, d: reports.top_similar(table(spark, d, "embeddings"), table(spark, d, "embeddings").filter("vec_id % 50 = 0"), 5), """SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INTEGER AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 5""")


# --- seeds and places ---------------------------------------------------------------------------------------------------

_DOMAINS = f"SELECT DISTINCT CASE WHEN domain <> '' THEN 'example.com' END AS k FROM {R} WHERE domain <> ''"
_add("seed_index", _records(lambda r: seeds.summary(seeds.keys(r.select("company_name", "domain", "website")))), f"""SELECT 'domain' AS kind, count(*) AS n FROM ({_DOMAINS}) UNION ALL SELECT 'company', count(DISTINCT c) FROM (SELECT {_CLEAN_NAME} AS c FROM {R}) WHERE c <> ''""")
_add("seed_unknown", _records(lambda r: seeds.unknown(r, seeds.keys(r.filter("seq % 9 = 4").select("company_name")), "company", "company_name").select("seq")), f"SELECT seq FROM (SELECT seq, {_CLEAN_NAME} AS c FROM {R}) WHERE c = '' OR c NOT IN (SELECT c FROM (SELECT seq, {_CLEAN_NAME} AS c FROM {R}) WHERE seq % 9 = 4 AND c <> '')")
_add("geo_violations", _records(lambda r: r.select("seq", filters.outside_geography(["norway", "egypt"], ["usa"], [], True, F.col("description"), lambda c: geo.countries_in(c)).alias("outside"))), f"""SELECT seq, hq_country = 'usa' OR country = 'usa' OR NOT (hq_country IN ('norway', 'egypt') OR country IN ('norway', 'egypt') OR contains(lower(description), 'norway') OR contains(lower(description), 'egypt')) AS outside FROM {R}""")
_add("url_geo_signal", lambda spark, d: table(spark, d, "pages").select("page_id", filters.american_path(F.lower("url")).alias("american")), "SELECT page_id, regexp_matches(lower(url), '[.]com/') AND regexp_matches(lower(url), '/(?:us|usa|en-us|united-states)(?:/|$)') AND NOT regexp_matches(lower(url), '/(?:global|international|worldwide)(?:/|$)') AS american FROM pages")
