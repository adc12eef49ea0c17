"""Queries over requests and topics that are put together by the documents' numbers, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import gazetteer
from seine.plans import expansion, parser
from seine.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda values: "[" + ", ".join(map(_q, values)) + "]"
_pick = lambda values, by: f"{_list(values)}[{by} % {len(values)} + 1]"
_choose = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

#: Topics with category, domain and solution keywords, things asked for, and the industry around the number asked for.
_TOPICS = (
    ("wireline logging", "general", "wireline", "", "company", "%s wireline logging"), ("water treatment software", "software_company", "", "", "company,product", "%s water treatment"),
    ("coiled tubing inspection", "service_company", "coiled tubing,inspection", "", "company", "%s coiled tubing"), ("solar farm", "general", "", "", "company", "%s solar farm"),
    ("iot monitoring", "software_company", "", "monitoring,iot", "company", "%s"), ("drilling optimization", "software_company", "drilling optimization", "optimization", "company", "drilling %s drilling"),
    ("oil & gas analytics", "software_company", "", "analytics", "company", "%s oil and gas"),
)
_IN, _OUT, _ABSENT = ("Norway", "Egypt", "Qatar", "Brazil", "Japan"), ("France", "Spain", "Peru"), ("Kuwait", "Oman")
_FORMATS = ("csv", "Excel", "pdf", "JSON", "a file")
_READ = ("csv", "xlsx", "pdf", "json", "xlsx")
_ENDS = ("", " We need a distributor", " Resellers are welcome")


def _requests(spark, d):
    n = F.col("doc_id")
    parts = F.format_string(
        "Find %s %s companies in %s, excluding %s, without offices in %s. Export to %s.%s", (n % 80 + 10).cast("string"), _choose([t[0] for t in _TOPICS], n),
        _choose(_IN, n), _choose(_OUT, n), _choose(_ABSENT, n), _choose(_FORMATS, n), _choose(_ENDS, n),
    )
    return table(spark, d, "documents").select("doc_id", parts.alias("request"))


def _parsed(spark, d):
    found = parser.parse(_requests(spark, d), "request", gazetteer.Gazetteer(spark)).select("doc_id", "task.*")
    said = lambda c: F.array_join(c, ",").alias(c.split(".")[-1])
    return found.select(
        "doc_id", "task_type", said("entity_types"), "category", said("domain_keywords"), said("solution_keywords"), "industry", "intent", said("attributes"), "format", "max_results",
        said("geography.include"), said("geography.exclude"), said("geography.exclude_presence"), "geography.strict",
    )


_add(
    "parse_requests", _parsed,
    f"""SELECT doc_id, 'entity_discovery' AS task_type, {_pick([t[4] for t in _TOPICS], 'doc_id')} AS entity_types, {_pick([t[1] for t in _TOPICS], 'doc_id')} AS category, {_pick([t[2] for t in _TOPICS], 'doc_id')} AS domain_keywords,
  {_pick([t[3] for t in _TOPICS], 'doc_id')} AS solution_keywords, replace({_pick([t[5] for t in _TOPICS], 'doc_id')}, '%s', (doc_id % 80 + 10)::VARCHAR) AS industry, {_pick(('general', 'agent_or_distributor', 'reseller'), 'doc_id')} AS intent,
  {_pick(('hq_country,presence_countries', 'hq_country,presence_countries', 'hq_country,pdf,presence_countries', 'hq_country,presence_countries', 'hq_country,presence_countries'), 'doc_id')} AS attributes,
  {_pick(_READ, 'doc_id')} AS format, (doc_id % 80 + 10)::INTEGER AS max_results, lower({_pick(_IN, 'doc_id')}) AS include, lower({_pick(_OUT, 'doc_id')}) AS exclude, lower({_pick(_ABSENT, 'doc_id')}) AS exclude_presence, true AS strict
  FROM documents""",
)

# --- expansion ---------------------------------------------------------------------------------------------------------

_SUBJECTS = ("Digital oil gas", "oilfield service drilling", "solar wind", "healthcare software", "fintech payment", "pipeline maintenance", "engineer training", "bakery", "gas lift ESP")
_LANDS = ("egypt", "USA", "uae", "norway")
_POSITIONS = ("HR Manager", "Director", "petroleum engineer", "clerk", "executive")


def _topics(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", _choose(_SUBJECTS, n).alias("topic"), F.when(n % 3 == 0, "person").otherwise("company").alias("entity"), F.when(n % 5 == 0, "people_search").otherwise("entity_discovery").alias("task_type"),
        F.array(_choose(_LANDS, n), _choose(_LANDS, n + 1)).alias("geography"), F.array(_choose(_POSITIONS, n), _choose(_POSITIONS, n + 2)).alias("positions"),
    )


def _graph_sql() -> str:
    rows = expansion.default_graph()
    return f"SELECT unnest({_list(r[0] for r in rows)}) AS kind, unnest({_list(r[1] for r in rows)}) AS bucket, unnest({_list(r[2] for r in rows)}) AS cue, unnest([{', '.join(str(r[3]) for r in rows)}]) AS place, unnest({_list(r[4] for r in rows)}) AS term"


_CAP = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {n}" for b, n in expansion.CAPS.items()) + " END"
_add(
    "expand_topics", lambda spark, d: expansion.expanded(_topics(spark, d), expansion.graph_of(spark), "doc_id").select("doc_id", "bucket", F.col("n").cast("int").alias("n"), "term"),
    f"""WITH g AS MATERIALIZED ({_graph_sql()}),
  t AS (SELECT doc_id, lower({_pick(_SUBJECTS, 'doc_id')}) AS topic, doc_id % 3 = 0 OR doc_id % 5 = 0 AS people, [lower({_pick(_LANDS, 'doc_id')}), lower({_pick(_LANDS, '(doc_id + 1)')})] AS lands, [lower({_pick(_POSITIONS, 'doc_id')}), lower({_pick(_POSITIONS, '(doc_id + 2)')})] AS ranks FROM documents),
  m AS (SELECT doc_id, bucket, kind, 0 AS nth, place, term FROM t JOIN g ON contains(topic, cue) AND (kind IN ('topic', 'industry') OR kind = 'titles' AND people)
    UNION SELECT doc_id, bucket, kind, i, place, term FROM t, (SELECT unnest([0, 1]) AS i) JOIN g ON kind = 'geography' AND lands[i + 1] = cue
    UNION SELECT doc_id, bucket, kind, i, place, term FROM t, (SELECT unnest([0, 1]) AS i) JOIN g ON kind = 'position' AND people AND contains(ranks[i + 1], cue)),
  f AS (SELECT * FROM m QUALIFY kind <> 'industry' OR place // 100 = min(place // 100) FILTER (kind = 'industry') OVER (PARTITION BY doc_id)),
  o AS (SELECT doc_id, bucket, term, nth, place FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, bucket, lower(term) ORDER BY nth, place, term) = 1)
  SELECT doc_id, bucket, (row_number() OVER (PARTITION BY doc_id, bucket ORDER BY nth, place, term) - 1)::INTEGER AS n, term FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, bucket ORDER BY nth, place, term) <= {_CAP}""",
)


def _worded(spark, d):
    """Queries of the terms that a topic's synonyms give, as strings."""
    topics = _topics(spark, d)
    terms = expansion.expanded(topics, expansion.graph_of(spark), "doc_id").filter("bucket = 'synonyms'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("t"))
    joined = topics.join(terms, "doc_id")
    return joined.select("doc_id", F.posexplode(expansion.worded(F.col("topic"), F.transform("t", lambda x: x["term"]), F.col("geography"), F.col("entity"))).alias("n", "query"))


_add(
    "expand_queries_of_terms", _worded,
    f"""WITH e AS (SELECT doc_id, n, term FROM ({ORACLES['expand_topics']}) WHERE bucket = 'synonyms'),
  w AS (SELECT *, {_pick(_SUBJECTS, 'doc_id')} AS topic, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'company ' END AS thing, {_pick(_LANDS, 'doc_id')} AS land, count(*) OVER (PARTITION BY doc_id) AS c FROM e)
  SELECT doc_id, n, term || ' ' || thing || land AS query FROM w UNION ALL SELECT doc_id, (c + n)::INTEGER, topic || ' ' || term || ' ' || land FROM w WHERE n < 3""",
)
