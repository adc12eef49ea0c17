"""Queries over papers, searches for people, terms in two languages and issues of requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seine.functions import labels, ontology, papers, text
from seine.operators import extract
from seine.plans import critic, languages, people
from seine.registered.requests import _choose, _list, _pick
from seine.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- papers ------------------------------------------------------------------------------------------------------------

_BYLINES = (
    "written by Ann Smith, Bob Jones", "* Lee, Kim; *Park, Jin; Doe, Jane", "J. Smith", "Anna B. Clark1, Carl D. Evans2 and Fred G. Hill", "by Zoe Young and Max Old", "Using Data, Research Model; Smith, John", "",
    "Smith, John; Brown, Charlie P.", "Ada Lovelace1, Alan Turing", "abstract Results Show, Method Study",
)
_HEADED = lambda: F.concat(_choose(_BYLINES, F.col("doc_id")), F.lit(" -- "), F.coalesce("text", F.lit("")))
_HEAD_SQL = f"({_pick(_BYLINES, 'doc_id')} || ' -- ' || coalesce(text, ''))[1:{papers.HEAD}]"


def _authors_sql() -> str:
    said = []
    for n, (pattern, off) in enumerate(papers.AUTHORS):
        x = f"regexp_extract(h, '{pattern}', 1)"
        x = f"trim(regexp_replace({x}, '{off}', '', 'g'))" if off else x
        said.append(f"rtrim({x}, ',')" if n == 1 else x)
    stop = _list(papers.NO_AUTHORS)
    good = f"list_filter([{', '.join(said)}], lambda s: length(s) >= 5 AND NOT list_has_any(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: w <> '')[1:3], {stop}))"
    return f"SELECT doc_id, coalesce(list_reduce(list_prepend('', {good}), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), '')[1:{papers.MOST}] AS authors FROM (SELECT doc_id, {_HEAD_SQL} AS h FROM documents)"


_add("paper_authors", lambda spark, d: table(spark, d, "documents").select("doc_id", papers.authors(_HEADED()).alias("authors")), _authors_sql())
_TITLES = ("Flow in wells", "Journal of wells", "Water pump guide", "OnePetro", "A study of services", "Latest Research Papers")
_ADDRESSES = ("https://x.org/1", "https://x.org/for-authors", "https://x.org/journal/2", "https://sciencegate.app/3", "")
_PAGE = f"doc_id, lower({_pick(_TITLES, 'doc_id')}) AS t, {_pick(_ADDRESSES, 'doc_id')} AS r, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS a"
_has = lambda c, pieces: "(" + " OR ".join(f"contains({c}, '{p}')" for p in pieces) + ")"


def _no_papers(spark, d):
    title, address = _choose(_TITLES, F.col("doc_id")), _choose(_ADDRESSES, F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", papers.no_paper(title, F.col("text"), address).alias("passed_over"), papers.no_paper_for_report(title, address).alias("left_out"))


_add("no_papers", _no_papers, f"SELECT doc_id, {_has('t', papers.TITLES)} OR {_has('a', papers.BODIES)} OR {_has('r', papers.PLACES)} OR (length(a) < 80 AND {_has('t', papers.SHORT)}) AS passed_over, {_has('t', papers.REPORT_TITLES)} OR {_has('r', papers.REPORT_REFERENCES)} AS left_out FROM (SELECT {_PAGE} FROM documents)")


def _contexts(spark, d):
    """Of each source the first twenty papers as one block; chosen before they are put together."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    first = docs.select("doc_id", "source").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 20")
    ranked = docs.drop("source").join(first, "doc_id")
    line = papers.context_line(F.col("n"), F.concat(F.lit("Paper "), "doc_id"), F.when(F.col("doc_id") % 2 == 0, "Ann Lee"), F.lit(""), F.col("lang"), F.col("text"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n")
    return ranked.groupBy("source").agg(F.sha2(block, 256).alias("block_sha256"), F.length(block).alias("length"))


_add("papers_context", _contexts, r"""SELECT source, sha256(b) AS block_sha256, length(b)::INTEGER AS length FROM (SELECT source, string_agg(l, chr(10) ORDER BY n) AS b FROM (
  SELECT source, n, n || '. Paper ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '   Authors: Ann Lee' ELSE '' END || CASE WHEN lang <> '' THEN chr(10) || '   Source: ' || lang ELSE '' END
    || CASE WHEN c = '' THEN '' ELSE chr(10) || '   Abstract: ' || CASE WHEN length(c) <= 700 THEN c ELSE rtrim(c[1:697]) || '...' END END || chr(10) AS l
  FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20) GROUP BY source)""")
_add(
    "review_packets", lambda spark, d: table(spark, d, "benchmark").select("item_id", papers.packet(F.col("item_id") + 1, F.concat(F.lit("Item "), "item_id"), F.lit("Ann Lee"), F.when(F.col("item_id") % 3 == 0, "2020"), F.lit(""), F.col("text")).alias("packet")),
    "SELECT item_id, '## ' || (item_id + 1) || '. Item ' || item_id || chr(10) || '- Authors: Ann Lee' || CASE WHEN item_id % 3 = 0 THEN chr(10) || '- Year: 2020' ELSE '' END || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || '### Abstract / Context' || chr(10) || text END || chr(10) AS packet FROM benchmark",
)
_add(
    "summary_chain", lambda spark, d: table(spark, d, "documents").select("doc_id", papers.summary(F.when(F.col("doc_id") % 4 == 0, "  own "), F.when(F.col("doc_id") % 4 == 1, " "), F.when(F.col("doc_id") % 3 == 0, "snippet"), F.col("source")).alias("summary")),
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'own' END, CASE WHEN doc_id % 3 = 0 THEN 'snippet' END, nullif(trim(source), ''), '') AS summary FROM documents",
)

# --- people ------------------------------------------------------------------------------------------------------------

_LEVELS = ("engineer", "HR", "Senior Manager", "chef", "executive", "sales")
_LANDS = ("egypt", "Norway", "atlantis", "United States")


def _searches(spark, d):
    n = F.col("c_custkey")
    tasks = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("field "), (n % 7).cast("string")).alias("topic"), F.array(_choose(_LEVELS, n), _choose(_LEVELS, n + 1)).alias("levels"),
        F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_choose(_LANDS, n))).alias("countries"), (n % 60).alias("max_results"),
    )
    return people.queries(tasks, "c_custkey", F.col("max_results") % 2 == 0)


def _searches_sql() -> str:
    title = "CASE " + " ".join(f"WHEN contains(l, '{k}') OR contains('{k}', l) THEN {_list(v)}" for k, v in people.TITLES.items()) + " ELSE [] END"
    label = "CASE " + " ".join(f"WHEN contains(lower(l), '{k}') THEN '{v}'" for k, v in labels.LEVELS.items()) + " ELSE l END"
    land = "CASE " + " ".join(f"WHEN lower(g) = '{k}' THEN {_list(v[:2])}" for k, v in people.PLACES.items()) + " ELSE [upper(g[1]) || lower(g[2:])] END"
    return f"""WITH c AS (SELECT c_custkey, 'field ' || c_custkey % 7 AS topic, [{_pick(_LEVELS, 'c_custkey')}, {_pick(_LEVELS, '(c_custkey + 1)')}] AS levels, c_custkey % 60 AS n, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_pick(_LANDS, 'c_custkey')} END AS g FROM customer),
  a AS (SELECT *, CASE WHEN g IS NULL THEN [''] ELSE {land} END AS geo, flatten(list_transform(list_transform(levels, lambda x: lower(x)), lambda l: {title})) AS found FROM c),
  b AS (SELECT *, (CASE WHEN len(found) = 0 THEN {_list(people.USUAL)} ELSE list_filter(found, lambda x, i: list_position(found, x) = i) END)[1:greatest(3, n // 8)] AS titles FROM a),
  q AS (SELECT c_custkey, flatten(list_transform(titles, lambda t: list_transform(geo, lambda p: ['exa', t || ' working at ' || topic || ' company' || CASE WHEN p = '' THEN '' ELSE ' in ' || p END])))
      || flatten(list_transform(levels, lambda l: list_transform(geo, lambda p: ['exa', {label} || ' professional with experience in ' || topic || CASE WHEN p = '' THEN '' ELSE ' in ' || p END])))
      || CASE WHEN n % 2 = 0 THEN flatten(list_transform(titles[1:8], lambda t: list_transform(geo, lambda p: ['serpapi', 'site:linkedin.com/in "' || t || '" "' || topic || '"' || CASE WHEN p = '' THEN '' ELSE ' "' || p || '"' END]))) ELSE [] END
      || list_transform(titles[1:4], lambda t: ['ddg', 'site:linkedin.com/in "' || t || '" "' || topic || '"' || CASE WHEN geo[1] = '' THEN '' ELSE ' "' || geo[1] || '"' END]) AS every FROM b)
  SELECT c_custkey, x[1] AS provider, i::INTEGER AS priority, x[2] AS query FROM (SELECT c_custkey, unnest(every) AS x, unnest(range(1, len(every) + 1)) AS i FROM q)"""


_add("people_queries", _searches, _searches_sql())

# --- languages -----------------------------------------------------------------------------------------------------------

_TERMS = ("Oil and Gas", "مصر", "energy", "GCC", "usa", "paper", "بحث", "Houston", "unheard of", "  ", "Companies", "السعودية")
_CITIES = {"houston": "usa"}


def _bilingual(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.array(_choose(_TERMS, n), _choose(_TERMS, n + 5)).alias("terms"))
    found = languages.variants(rows, "o_orderkey", "terms", languages.groups(spark, _CITIES))
    return found.select("o_orderkey", F.posexplode("variants").alias("n", "variant"))


def _bilingual_sql() -> str:
    from seine.functions.text import FROM_ARABIC, TO_ARABIC

    rows = languages.default_groups(_CITIES)
    norm = lambda c: f"lower(translate(trim(regexp_replace(regexp_replace({c}, '[ؐ-ًؚ-ٰٟۖ-ۭ]', '', 'g'), '\\s+', ' ', 'g')), '{FROM_ARABIC}', '{TO_ARABIC}'))"
    return f"""WITH g AS (SELECT unnest([{', '.join(str(r[0]) for r in rows)}]) AS kind, unnest([{', '.join(str(r[1]) for r in rows)}]) AS number, unnest({_list(r[2] for r in rows)}) AS cue, unnest([{', '.join(str(r[3]) for r in rows)}]) AS place, unnest({_list(r[4] for r in rows)}) AS term),
  k AS (SELECT DISTINCT {norm('cue')} AS cue, kind, number, place, term FROM g), f AS (SELECT * FROM k QUALIFY number = min(number) OVER (PARTITION BY cue, kind)),
  t AS (SELECT o_orderkey, m, CASE m WHEN 0 THEN {_pick(_TERMS, 'o_orderkey')} ELSE {_pick(_TERMS, '(o_orderkey + 5)')} END AS term FROM orders, (SELECT unnest([0, 1]) AS m)),
  v AS (SELECT o_orderkey, m, -1 AS kind, 0 AS place, trim(term) AS variant FROM t UNION ALL SELECT o_orderkey, m, kind, place, f.term FROM t JOIN f ON f.cue = {norm('t.term')}),
  o AS (SELECT *, {norm('variant')} AS key FROM v WHERE variant <> ''),
  u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_orderkey, key ORDER BY m, kind, place, variant) = 1)
  SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY m, kind, place, variant) - 1)::INTEGER AS n, variant FROM u"""


_add("bilingual_terms", _bilingual, _bilingual_sql())
_add(
    "query_languages", lambda spark, d: table(spark, d, "documents").select("doc_id", F.array_join(languages.query_languages(text.languages(F.substring("text", 1, 200)), F.array(_choose(_LANDS, F.col("doc_id")))), ",").alias("languages")),
    f"SELECT doc_id, CASE WHEN lower({_pick(_LANDS, 'doc_id')}) = 'egypt' THEN 'en,ar' ELSE 'en' END AS languages FROM documents",
)

# --- issues of requests ----------------------------------------------------------------------------------------------------

_INDUSTRIES, _THINGS, _INTENTS = ("wells", "", " ", "water"), ("company", "paper", "person"), ("general", "reseller", "partner", "general", "general")


def _issues(spark, d):
    n = F.col("doc_id")
    none = F.array().cast("array<string>")
    tasks = table(spark, d, "documents").select(
        "doc_id", _choose(_INDUSTRIES, n).alias("industry"), F.when(n % 7 == 0, none).otherwise(F.array(_choose(_THINGS, n))).alias("entity_types"), F.when(n % 2 == 0, F.array(F.col("lang"))).alias("include"),
        none.alias("exclude"), F.when(n % 3 == 0, F.array(F.lit("usa"))).otherwise(none).alias("exclude_presence"), (n % 5 < 3).alias("strict"), _choose(_INTENTS, n).alias("intent"),
    )
    return critic.task_issues(tasks, "doc_id")


_add(
    "task_issues", _issues,
    f"""WITH t AS (SELECT doc_id, trim({_pick(_INDUSTRIES, 'doc_id')}) AS industry, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_pick(_THINGS, 'doc_id')} END AS thing, doc_id % 2 = 0 OR doc_id % 3 = 0 AS placed, doc_id % 5 < 3 AS strict, {_pick(_INTENTS, 'doc_id')} AS intent FROM documents),
  i AS (SELECT doc_id, 0 AS k, 'error' AS severity, 'missing_industry' AS code FROM t WHERE industry = '' UNION ALL SELECT doc_id, 1, 'warning', 'missing_entity' FROM t WHERE thing = ''
    UNION ALL SELECT doc_id, 2, 'warning', 'strict_without_geo' FROM t WHERE strict AND NOT placed UNION ALL SELECT doc_id, 3, 'info', 'commercial_non_company' FROM t WHERE intent <> 'general' AND thing NOT IN ('company', ''))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS n, severity, code FROM i""",
)

# --- kinds of pages and papers, with words planted ---------------------------------------------------------------------------

_HEADS = ("Top 10 vendors", "Press release", "Our blog", "Home of wells", "Newsroom", "How to drill", "Directory")
_KIND = f"lower(url || ' ' || {_pick(_HEADS, 'page_id')})"
_add(
    "page_types_planted", lambda spark, d: table(spark, d, "pages").select("page_id", extract.page_type(F.col("url"), _choose(_HEADS, F.col("page_id")), F.when(F.col("page_id") % 3 > 0, F.col("html"))).alias("page_type")),
    f"SELECT page_id, CASE WHEN regexp_matches({_KIND}, '{extract.DIRECTORY}') THEN 'directory' WHEN regexp_matches({_KIND}, '{extract.MEDIA}') THEN 'media' WHEN regexp_matches({_KIND}, '{extract.BLOG}') THEN 'blog' WHEN page_id % 3 = 0 OR trim(coalesce(html, '')) = '' THEN 'unknown' ELSE 'company' END AS page_type FROM pages",
)
_SUBJECTS = ("a survey of wells", "an algorithm", "laboratory notes", "field trials", "a software library", "nothing else")
_SAID = f"lower({_pick(_SUBJECTS, 'doc_id')} || ' ' || coalesce(text, ''))"
_add(
    "paper_focus_planted", lambda spark, d: table(spark, d, "documents").select("doc_id", extract.focus(_choose(_SUBJECTS, F.col("doc_id")), F.coalesce("text", F.lit(""))).alias("focus")),
    f"SELECT doc_id, CASE WHEN regexp_matches({_SAID}, '\\b(review|survey|overview)\\b') THEN 'review' WHEN regexp_matches({_SAID}, '\\b(method|algorithm|framework|model)') THEN 'method' WHEN regexp_matches({_SAID}, '\\b(experiment|laboratory|measurement)') THEN 'experiment' WHEN regexp_matches({_SAID}, '\\b(case study|field)\\b') THEN 'case study' WHEN regexp_matches({_SAID}, '\\b(software|tool|library)\\b') THEN 'software' ELSE 'general' END AS focus FROM documents",
)

# --- labels of texts ---------------------------------------------------------------------------------------------------------

_WORDS = [w for t in (ontology.ENTITIES, ontology.CATEGORIES, ontology.INTENTS, ontology.INDUSTRIES, ontology.SOLUTIONS, ontology.DOMAINS) for words in t.values() for w in words]
_ABOUT = lambda: F.concat(_choose(_WORDS, F.col("doc_id") * 7), F.lit(" and "), _choose(_WORDS, F.col("doc_id") * 11 + 3), F.lit(" / "), F.substring(F.coalesce("text", F.lit("")), 1, 60))
_ABOUT_SQL = f"""trim(regexp_replace(translate(lower(trim({_pick(_WORDS, '(doc_id * 7)')} || ' and ' || {_pick(_WORDS, '(doc_id * 11 + 3)')} || ' / ' || coalesce(text, '')[1:60])), chr(1600) || chr(8207) || chr(8206), ''), '\\s+', ' ', 'g'))"""


def _found_sql(labels: dict) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len(list_filter({_list(map(ontology.label, (k, *v)))}, lambda w: contains(t, w))) > 0 THEN '{k}' END" for k, v in labels.items()) + "], lambda x: x IS NOT NULL), ',')"


def _voted_sql(labels: dict) -> str:
    votes = ", ".join(f"{{'n': -len(list_filter({_list(map(ontology.label, v))}, lambda w: contains(t, w))), 'name': '{k}'}}" for k, v in labels.items() if v and k != "general")
    return f"CASE WHEN list_min([{votes}]).n < 0 THEN list_min([{votes}]).name ELSE 'general' END"


def _labelled(spark, d):
    said = table(spark, d, "documents").select("doc_id", _ABOUT().alias("t"))
    joined = lambda c: F.array_join(c, ",")
    return said.select(
        "doc_id", joined(ontology.entity_types(F.col("t"))).alias("entities"), ontology.voted(F.col("t"), ontology.CATEGORIES).alias("category"), ontology.voted(F.col("t"), ontology.INTENTS).alias("intent"),
        joined(ontology.found(F.col("t"), ontology.INDUSTRIES)).alias("industries"), joined(ontology.found(F.col("t"), ontology.SOLUTIONS)).alias("solutions"), joined(ontology.found(F.col("t"), ontology.DOMAINS)).alias("domains"),
    )


_add(
    "ontology_labels", _labelled,
    f"""SELECT doc_id, coalesce(nullif({_found_sql(ontology.ENTITIES)}, ''), 'company') AS entities, {_voted_sql(ontology.CATEGORIES)} AS category, {_voted_sql(ontology.INTENTS)} AS intent, {_found_sql(ontology.INDUSTRIES)} AS industries,
  {_found_sql(ontology.SOLUTIONS)} AS solutions, {_found_sql(ontology.DOMAINS)} AS domains FROM (SELECT doc_id, {_ABOUT_SQL} AS t FROM documents)""",
)
