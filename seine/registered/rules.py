"""Queries over labels, keys, evidence, gates, plans in order, caches and pages' links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seine.functions import geo, html, labels, text, urls
from seine.operators import evidence, extract, filters, resolve, unions
from seine.registered.plans import _GEO
from seine.session import table
from seine.sources import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R = fixtures.RECORDS


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _over(name: str, columns):
    return lambda spark, d: table(spark, d, name).select(*columns())


def _records(f):
    return lambda spark, d: f(fixtures.records(spark, d))


def _case(code: str, names: dict[str, str], other: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


def _titled(code: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(replace({code}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


# --- labels and keys --------------------------------------------------------------------------------------------------

# codes of all kinds, known, unknown, empty and null, made of events
_CODE = "CASE event_id % 11 WHEN 0 THEN 'document_research' WHEN 1 THEN 'people_search' WHEN 2 THEN 'entity_discovery' WHEN 3 THEN 'software_company' WHEN 4 THEN 'general' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'reseller' WHEN 8 THEN 'agent_or_distributor' ELSE event_type || '_company' END"
_ENTITY = "CASE event_id % 7 WHEN 0 THEN 'paper' WHEN 1 THEN 'person' WHEN 2 THEN 'tender' WHEN 3 THEN 'product' WHEN 4 THEN '' ELSE 'company' END"
_CATEGORY = _case("trim(c)", labels.CATEGORIES, f"CASE WHEN c = '' THEN 'General' ELSE {_titled('c')} END")
_EVENTS = f"(SELECT event_id, event_type, coalesce({_CODE}, '') AS c, {_ENTITY} AS e FROM events)"
_code, _entity = (lambda: F.expr(_CODE)), (lambda: F.expr(_ENTITY))
_add("label_task_type", _over("events", lambda: ["event_id", labels.task_type(_code()).alias("label")]), f"SELECT event_id, {_case('c', labels.TASK_TYPES, chr(39) + '🔍 Entities' + chr(39))} AS label FROM {_EVENTS}")
_add("label_category", _over("events", lambda: ["event_id", labels.category(_code()).alias("label")]), f"SELECT event_id, {_CATEGORY} AS label FROM {_EVENTS}")
_add("label_intent", _over("events", lambda: ["event_id", labels.intent(_code()).alias("label")]), f"SELECT event_id, CASE WHEN c = '' THEN 'General' ELSE {_case('trim(c)', labels.INTENTS, _titled('c'))} END AS label FROM {_EVENTS}")
_add(
    "label_display_category", _over("events", lambda: ["event_id", labels.shown_category(_code(), _entity(), F.col("event_type")).alias("label")]),
    f"""SELECT event_id, CASE WHEN t = 'document_research' OR e = 'paper' THEN 'Research / academic sources' WHEN t = 'people_search' OR e = 'person' THEN 'People / LinkedIn profiles'
      WHEN e = 'tender' THEN 'Tenders / procurement' WHEN e = 'product' THEN 'Products / platforms' ELSE {_CATEGORY} END AS label FROM (SELECT event_id, c AS t, e, event_type AS c FROM {_EVENTS})""",
)
_add("entity_of_task", _over("events", lambda: ["event_id", labels.entity_of_task(_code()).alias("entity")]), f"SELECT event_id, CASE c WHEN 'document_research' THEN 'paper' WHEN 'people_search' THEN 'person' ELSE 'company' END AS entity FROM {_EVENTS}")
_LEVEL = "CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'HR Manager' WHEN 2 THEN 'chief executive' WHEN 3 THEN '' WHEN 4 THEN lower(p_type) ELSE 'Sales' END"
_add("label_level", _over("part", lambda: ["p_partkey", labels.level(F.expr(_LEVEL)).alias("label")]), f"SELECT p_partkey, CASE {' '.join(f'WHEN contains(lower(l), {chr(39)}{k}{chr(39)}) THEN {chr(39)}{v}{chr(39)}' for k, v in labels.LEVELS.items())} WHEN l = '' THEN 'professional' ELSE l END AS label FROM (SELECT p_partkey, {_LEVEL} AS l FROM part)")
_FILE = "CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN concat(p_name, '.XLSX') WHEN 1 THEN concat(' ', p_name, '.csv.pdf ') WHEN 2 THEN '' WHEN 3 THEN p_name ELSE concat(p_name, '.txt') END"
_KIND = "CASE CAST(p_size % 4 AS INTEGER) WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'docx' ELSE NULL END"
_add("file_names", _over("part", lambda: ["p_partkey", labels.file_name(F.expr(_FILE), F.expr(_KIND)).alias("file")]), f"""SELECT p_partkey, regexp_replace(trim(CASE WHEN f = '' THEN 'results' ELSE f END), '(?i)\\.(xlsx|csv|pdf|json)$', '') || '.' || CASE WHEN k IN ('csv', 'json') THEN k ELSE 'xlsx' END AS file
  FROM (SELECT p_partkey, {_FILE} AS f, {_KIND} AS k FROM part)""")
_add("title_list", _over("part", lambda: ["p_partkey", F.array_join(labels.titles(F.split(F.concat_ws(",", F.lower("p_type"), F.lit(" "), F.col("p_name")), ",")), "|").alias("titles")]), f"SELECT p_partkey, {_titled('lower(p_type)')} || '|' || {_titled('p_name')} AS titles FROM part")
_add("snapshot_key", _records(lambda r: r.select("seq", labels.snapshot_key(F.col("company_name"), F.col("website")).alias("key"))), f"SELECT seq, lower(trim(company_name)) || '|' || lower(trim(website)) AS key FROM {R}")
_add("cache_key", _over("documents", lambda: ["doc_id", labels.cache_key(F.col("lang"), F.upper("source"), F.col("doc_id")).alias("key"), labels.prompt_key(F.col("text")).alias("prompt")]), f"SELECT doc_id, concat_ws('::', '{labels.CACHE_VERSION}', lower(trim(coalesce(lang, ''))), lower(trim(coalesce(source, ''))), doc_id) AS key, md5(coalesce(text, '')) AS prompt FROM documents")
_add("reviewed_rank", _records(lambda r: r.select("seq", labels.reviewed_rank(F.expr("concat(description, CASE WHEN seq % 3 = 0 THEN '' ELSE concat(' | llm_rank:', seq % 11, '/10') END)")).alias("rank"))), f"SELECT seq, CASE WHEN seq % 3 <> 0 THEN seq % 11 END::INTEGER AS rank FROM {R}")
_ANSWER = "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN props WHEN 1 THEN concat('```json\\n', props, '\\n```') WHEN 2 THEN concat('Answer: ', props, ' as asked') WHEN 3 THEN concat('rows [', value, '] only') ELSE concat(event_type, ' {broken') END"
_add("json_in_answer", _over("events", lambda: ["event_id", labels.json_in(F.expr(_ANSWER)).alias("json")]), "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props WHEN event_id % 5 = 3 THEN '[' || value || ']' END AS json FROM events")
_add("record_json", _records(lambda r: r.select("seq", F.to_json(F.struct("seq", "company_name", "domain", "is_directory_or_media")).alias("json"))), f"SELECT seq, to_json({{'seq': seq, 'company_name': company_name, 'domain': domain, 'is_directory_or_media': is_directory_or_media}}) AS json FROM {R}")


# --- evidence ---------------------------------------------------------------------------------------------------------

_WORDS = ["the", "License", "report", "que", "Kilometer"]


def _items():
    found = text.bound(geo.countries_in(F.col("text")), lambda c: evidence.of_text(F.col("text"), c, F.col("source"), F.col("lang")))
    return F.array_compact(F.array(found, evidence.of_keywords(F.col("text"), _WORDS, F.col("source"))))


_FOUND = f"list_filter({_WORDS}, lambda w: contains(t, lower(w)))"
_QUOTE = "regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g')"
_BODY = f"(SELECT doc_id, text, source, lang, lower(coalesce(text, '')) AS t, {_QUOTE} AS quote FROM documents)"
_part = lambda label, quote: f"CASE WHEN {quote} = '' THEN {label} ELSE {label} || ': ' || left({quote}, 140) END"
_SUMMARY = f"concat_ws(' | ', {_part('lang', 'quote')}, CASE WHEN len({_FOUND}) > 0 THEN {_part(chr(39) + 'keywords' + chr(39), 'trim(left(text, 500))')} END)"
_add("evidence_summary", _over("documents", lambda: ["doc_id", evidence.summary(_items()).alias("summary")]), f"SELECT doc_id, {_SUMMARY} AS summary FROM {_BODY}")
_add("evidence_terms", _over("documents", lambda: ["doc_id", F.array_join(evidence.united(_items(), "matched_terms"), ",").alias("terms"), F.array_join(evidence.united(_items(), "matched_countries"), ",").alias("countries")]), f"SELECT doc_id, array_to_string({_FOUND}, ',') AS terms, array_to_string({_GEO}, ',') AS countries FROM {_BODY}")
_add("evidence_attached", _over("documents", lambda: ["doc_id", evidence.noted(F.expr("CASE WHEN doc_id % 2 = 0 THEN ' seen ' ELSE '' END"), _items()).alias("notes")]), f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'seen | ' ELSE '' END || 'evidence:' || {_SUMMARY} AS notes FROM {_BODY}")
_add("verdict_counts", _records(lambda r: r.select(filters.validated("company")["accepted"].alias("accepted")).groupBy("accepted").agg(F.count("*").alias("n"))), f"SELECT company_name <> '' OR website <> '' AS accepted, count(*) AS n FROM {R} GROUP BY 1")

# --- places, gates and kinds ------------------------------------------------------------------------------------------

_SPOKEN = "(^|[^\\pL\\pN])(?:" + "|".join(geo.SPELLINGS["usa"]).replace(".", "[.]") + ")($|[^\\pL\\pN])"
_add("contains_country", _over("documents", lambda: ["doc_id", geo.contains_country(F.col("text"), "United States").alias("american")]), f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{_SPOKEN}') AS american FROM documents")
_add("all_countries", lambda spark, d: geo.all_countries(spark), "SELECT unnest([" + ", ".join(f"'{c}'" for c in geo.SPELLINGS) + "]) AS country")
_LINK = "CASE WHEN linkedin_url = '' THEN website WHEN seq % 12 = 0 THEN replace(linkedin_url, '/company/', '/in/') ELSE linkedin_url END"
_add("linkedin_gate", _records(lambda r: r.withColumn("url", F.expr(_LINK)).select("seq", urls.kept_by_gate(F.col("url"), True).alias("people"), urls.kept_by_gate(F.col("url"), False).alias("others"))), f"SELECT seq, contains(u, 'linkedin.com/in/') AS people, NOT contains(u, 'linkedin.com') AS others FROM (SELECT seq, lower({_LINK}) AS u FROM {R})")
_hint = lambda words: f"regexp_matches(t, '{'|'.join(words)}')"
_add("result_kinds", _over("documents", lambda: ["doc_id", text.contains_any(F.lower(text.text_of(F.col("text"))), list(text.ACADEMIC_HINTS)).alias("academic"), text.contains_any(F.lower(text.text_of(F.col("text"))), list(text.EVENT_HINTS)).alias("event")]), f"SELECT doc_id, {_hint(text.ACADEMIC_HINTS)} AS academic, {_hint(text.EVENT_HINTS)} AS event FROM {_BODY}")
_add("summarisable", lambda spark, d: table(spark, d, "documents").filter(F.length(F.trim("text")) > 50).orderBy("doc_id").limit(20).select("doc_id"), "SELECT doc_id FROM documents WHERE length(trim(text)) > 50 ORDER BY doc_id LIMIT 20")
_TOKEN = r"[\pL\pN_][\pL\pN_\-]+"
_NO = ", ".join(f"'{w}'" for w in text.NO_TOPIC)
_add("topic_terms", _over("documents", lambda: ["doc_id", F.array_join(text.topic_terms(F.col("text")), " ").alias("terms")]), f"""SELECT doc_id, coalesce((SELECT string_agg(w, ' ' ORDER BY first) FROM (SELECT w, min(i) AS first FROM (SELECT unnest(l) AS w, unnest(range(len(l))) AS i) WHERE w NOT IN ({_NO}) GROUP BY w ORDER BY first LIMIT 12)), '') AS terms
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS l FROM documents)""")
_HINT = "(^|[^a-z0-9_])(company|services|solutions|engineering|technology|systems|group|ltd|llc|inc|corp)($|[^a-z0-9_])"
_add("company_lines", _over("documents", lambda: ["doc_id", F.array_join(text.company_lines(F.col("text")), "|").alias("lines")]), f"""SELECT doc_id, coalesce((SELECT string_agg(s, '|' ORDER BY i) FROM (SELECT arg_min(s, i) AS s, min(i) AS i FROM (SELECT trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS s, unnest(range(len(l))) AS i)
  WHERE s <> '' AND length(s) <= 120 AND regexp_matches(lower(s), '{_HINT}') GROUP BY lower(s))), '') AS lines FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r') AS l FROM documents)""")
_STAND = "concat(' - ', p_name, '|', upper(p_name), '|  Event |x|', p_type)"
_add("exhibitor_names", _over("part", lambda: ["p_partkey", F.array_join(text.exhibitor_names(F.split(F.expr(_STAND), "[|]")), "|").alias("names")]), "SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN p_name ELSE p_name || '|' || p_type END AS names FROM part")
_INTENTS = {k: "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")" for k, words in unions.INTENT_ALIASES.items()}
_BEST = "list_sort([" + ", ".join(f"{{'n': -{v}, 'k': '{k}'}}" for k, v in _INTENTS.items()) + "])[1]"
_add("intent_vote", _over("documents", lambda: ["doc_id", unions.voted(F.col("text"), unions.INTENT_ALIASES).alias("intent")]), f"SELECT doc_id, CASE WHEN b.n < 0 THEN b.k ELSE 'general' END AS intent FROM (SELECT doc_id, {_BEST} AS b FROM {_BODY})")

# --- plans and budgets in order -----------------------------------------------------------------------------------------


def _trimmed(spark, d):
    said = table(spark, d, "conversations").withColumn("key", F.lower(F.trim(text.text_of(F.col("text"))))).filter("key <> ''")
    first = filters.keep_first(said, ["conv_id", "key"], ["turn"])
    return filters.capped(first, ["conv_id"], ["turn"], 3).select("conv_id", "turn")


_add("trim_queries", _trimmed, """SELECT conv_id, turn FROM (SELECT conv_id, lower(trim(coalesce(text, ''))) AS key, min(turn) AS turn FROM conversations GROUP BY ALL HAVING key <> '') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")
_BY = lambda: Window.partitionBy("conv_id").orderBy("role", "turn")
_add("priority_counter", _over("conversations", lambda: ["conv_id", "turn", (F.row_number().over(_BY()) + 9).alias("priority")]), "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) + 9)::INTEGER AS priority FROM conversations")
_USED = lambda: Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
_add("page_budget", _over("events", lambda: ["event_id", (F.sum(F.floor("value")).over(_USED()) <= 900).alias("allowed")]), "SELECT event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 900 AS allowed FROM events")
_add("accept_until_target", lambda spark, d: filters.keep_first(table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host")).filter("host <> ''"), ["host"], ["page_id"]).orderBy("page_id").limit(25).select("page_id"),
     "SELECT page_id FROM (SELECT min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www[0-9]*[.])?', ''), '[/?#:].*$', '') AS h FROM pages) WHERE h <> '' GROUP BY h) ORDER BY page_id LIMIT 25")


def _united(r):
    stages = [r.filter(F.col("source_provider") == p).select("seq", F.lit(n).alias("stage")) for n, p in enumerate(("exa", "ddg", "tavily", "serpapi"), 1)]
    return stages[0].unionByName(stages[1]).unionByName(stages[2]).unionByName(stages[3])


_add("provider_union", _records(_united), f"SELECT seq, list_position(['exa', 'ddg', 'tavily', 'serpapi'], source_provider)::INTEGER AS stage FROM {R}")
_add("distinct_in_order", _over("documents", lambda: ["doc_id", F.array_join(unions.ordered_union(F.split(text.text_of(F.col("text")), "[.\n]")), "|").alias("parts")]), """SELECT doc_id, coalesce((SELECT string_agg(s, '|' ORDER BY i) FROM (SELECT s, min(i) AS i FROM (SELECT trim(unnest(l)) AS s, unnest(range(len(l))) AS i) WHERE s <> '' GROUP BY s)), '') AS parts
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.\\n]') AS l FROM documents)""")


# --- caches, verdicts and reports ---------------------------------------------------------------------------------------


def _upsert(spark, d):
    newest = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("n", F.row_number().over(newest)).filter("n = 1")
    return rows.select(F.col("event_type").alias("namespace"), labels.cache_key(F.col("user_id")).alias("key"), F.to_json(F.struct("event_id")).alias("value"))


_add("cache_upsert", _upsert, f"SELECT event_type AS namespace, '{labels.CACHE_VERSION}::' || user_id AS key, to_json({{'event_id': event_id}}) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
_FRESH = "ts >= timestamp '2024-01-28 00:00:00'"
_add("cache_hits", lambda spark, d: table(spark, d, "customer").join(table(spark, d, "events").filter(_FRESH).select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"), f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE {_FRESH})")
_VERDICT = "array<struct<index:int,score:int,keep:boolean>>"


def _verdicts(spark, d):
    """Verdicts of one order as a JSON list, tied to its lines by their numbers."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    said = lines.filter("q % 4 > 0").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("index"), (F.col("q") % 11).alias("score"), (F.col("q") % 2 == 0).alias("keep")))).alias("answer"))
    told = said.select("l_orderkey", F.explode(F.from_json("answer", _VERDICT)).alias("v")).select("l_orderkey", F.col("v.index").alias("l_linenumber"), "v.score", "v.keep")
    return lines.join(told, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "score", "keep")


_add("llm_verdicts", _verdicts, "SELECT l_orderkey, l_linenumber, CASE WHEN q % 4 > 0 THEN q % 11 END::INTEGER AS score, CASE WHEN q % 4 > 0 THEN q % 2 = 0 END AS keep FROM (SELECT l_orderkey, l_linenumber, max(l_quantity)::INTEGER AS q FROM lineitem GROUP BY ALL)")


def _zipped(spark, d):
    nth = Window.partitionBy("conv_id").orderBy("turn")
    side = lambda role: table(spark, d, "conversations").filter(F.col("role") == role).withColumn("n", F.row_number().over(nth))
    return side("user").alias("u").join(side("assistant").alias("a"), ["conv_id", "n"]).select("conv_id", "n", F.col("u.turn").alias("asked"), F.col("a.turn").alias("told"))


_add("zip_by_position", _zipped, """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INTEGER AS n FROM conversations)
  SELECT u.conv_id, u.n, u.turn AS asked, a.turn AS told FROM c u JOIN c a ON u.conv_id = a.conv_id AND u.n = a.n AND u.role = 'user' AND a.role = 'assistant'""")
_BLOCK = lambda: F.concat(F.col("turn") + 1, F.lit(". "), "role", F.lit("\n   "), F.replace(text.text_of(F.col("text")), F.lit("\n"), F.lit("\n   ")))
_add("summaries_text", lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", _BLOCK().alias("b")))), lambda x: x["b"]), "\n\n").alias("body")), """SELECT conv_id, string_agg((turn + 1) || '. ' || role || chr(10) || '   ' || replace(coalesce(text, ''), chr(10), chr(10) || '   '), chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id""")
_add("eval_cases_json", lambda spark, d: table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list("n_name")).alias("cases"))).alias("json")), "SELECT n_regionkey, to_json({'cases': list(n_name ORDER BY n_name)}) AS json FROM nation GROUP BY n_regionkey")
_add("contact_subpages", lambda spark, d: table(spark, d, "pages").select("page_id", F.posexplode(F.slice(html.links(F.col("html")), 1, 3)).alias("n", "link")), """SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS n, link FROM (SELECT page_id, link, min(i) AS i
  FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']*)["'']', 1) AS l FROM pages)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 3""")
_PATHS = ("/contact", "/contact-us", "/about")
_add("probe_pages", lambda spark, d: table(spark, d, "pages").select("page_id", F.explode(F.array(*[F.concat(urls.root_url(F.col("url")), F.lit(p)) for p in _PATHS])).alias("probe")), f"SELECT page_id, 'https://' || regexp_replace(regexp_replace(lower(url), '^https?://(www[0-9]*[.])?', ''), '[/?#:].*$', '') || p AS probe FROM pages, (SELECT unnest({list(_PATHS)}) AS p)")


_add("accept_with_feedback", lambda spark, d: resolve.accepted(fixtures.records(spark, d)))


# --- topics, summaries and company profiles -------------------------------------------------------------------------------

_TOPIC = "CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN concat(' Engineer,', p_name, ' Company / ', p_type) WHEN 1 THEN concat(p_type, '  vendors HR') WHEN 2 THEN 'CEO  Manager' ELSE '' END"
_WHO = ", ".join(f"'{w}'" for w in (*labels.JOB_WORDS, *labels.COMPANY_WORDS))
_add("people_topic", _over("part", lambda: ["p_partkey", labels.people_topic(F.expr(_TOPIC)).alias("topic")]), f"""SELECT p_partkey, CASE WHEN k <> '' THEN k WHEN low <> '' THEN low ELSE 'industry' END AS topic
  FROM (SELECT p_partkey, low, array_to_string(list_filter(string_split_regex(low, '[\\s,/]+'), lambda w: w <> '' AND w NOT IN ({_WHO})), ' ') AS k FROM (SELECT p_partkey, lower(trim(regexp_replace({_TOPIC}, '\\s+', ' ', 'g'))) AS low FROM part))""")
_SPOKEN = "trim(concat_ws(' ', description, company_name))"


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + ")"


def _summaries(r):
    parts = [F.col("description"), F.col("company_name")]
    wanted = {"papers": ("document_research", [], "general", ""), "wells": ("entity_discovery", ["Wireline"], "general", ""), "digital": ("entity_discovery", [], "software_company", "Oil and gas"), "other": ("market_research", [], "general", "")}
    return r.select("seq", *[extract.preferred_summary(parts, *task).alias(name) for name, task in wanted.items()])


_add("preferred_summary", _records(_summaries), f"""SELECT seq, CASE WHEN {_has(extract.OF_PAPERS)} THEN left(t, 500) ELSE '' END AS papers, CASE WHEN {_has((*extract.OF_WELLS, "logging"))} THEN left(t, 500) ELSE '' END AS wells,
  CASE WHEN {_has(extract.OF_DIGITAL)} THEN left(t, 500) ELSE '' END AS digital, left(t, 500) AS other FROM (SELECT seq, {_SPOKEN} AS t FROM {R})""")
_SEEN = "concat(p_name, CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN ' | LinkedIn' WHEN 1 THEN ' - linkedin Egypt' ELSE '' END)"
_AT = "concat(CASE CAST(p_partkey % 2 AS INTEGER) WHEN 0 THEN 'https://www.linkedin.com/company/c' ELSE 'https://www.linkedin.com/in/c' END, CAST(p_partkey AS STRING), '/')"
_add("company_of_profile", _over("part", lambda: ["p_partkey", *extract.company_of_profile(F.expr(_SEEN), F.expr(_AT), F.col("p_type"))]), "SELECT p_partkey, p_name AS company_name, CASE WHEN p_partkey % 2 = 0 THEN 'https://linkedin.com/company/c' || p_partkey ELSE '' END AS linkedin_url, p_type AS description, 'linkedin.com' AS domain FROM part")
