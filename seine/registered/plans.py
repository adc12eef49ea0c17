"""Queries over prompts, plans, places, papers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seine.functions import geo, text
from seine.operators import filters
from seine.plans import budget, prompts
from seine.session import shared_folder, table
from seine.sources import fixtures
from seine.streaming import dedup, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_PROMPT = """CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN 'Find 40 software companies in Norway, exclude Egypt' WHEN 1 THEN 'papers about wireline logging in 2023 as csv' WHEN 2 THEN 'List agents and distributors of saas in the UAE or Qatar outside the USA'
  WHEN 3 THEN 'Managers at contractors in Houston. Managers at contractors in Houston.' ELSE 'competitors of Delta as json' END"""


def _prompts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_PROMPT).alias("prompt"))


_add(
    "parse_prompts", lambda spark, d: prompts.parse(_prompts(spark, d), "prompt").select("doc_id", "task_type", "category", "intent", "format", "max_results", F.array_join("include_countries", ",").alias("includes"), F.array_join("exclude_countries", ",").alias("excludes")),
    """SELECT doc_id, v[1] AS task_type, v[2] AS category, v[3] AS intent, v[4] AS format, v[5]::INTEGER AS max_results, v[6] AS includes, v[7] AS excludes FROM (SELECT doc_id, CASE doc_id % 5
      WHEN 0 THEN ['entity_discovery', 'software_company', 'general', 'xlsx', '40', 'norway', 'egypt'] WHEN 1 THEN ['document_research', 'general', 'general', 'csv', '25', '', '']
      WHEN 2 THEN ['entity_discovery', 'software_company', 'agent_or_distributor', 'xlsx', '25', 'qatar,uae', 'usa'] WHEN 3 THEN ['people_search', 'service_company', 'general', 'xlsx', '25', 'usa', '']
      ELSE ['similar_entity_expansion', 'general', 'general', 'json', '25', '', ''] END AS v FROM documents)""",
)
_TASK = """doc_id, CASE doc_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'deep' END AS mode, CAST(5 + doc_id * 7 % 90 AS INTEGER) AS max_results, CASE WHEN doc_id % 4 = 0 THEN 'reseller' ELSE 'general' END AS intent,
  CASE WHEN doc_id % 2 = 0 THEN 'software_company' ELSE 'general' END AS category, CASE WHEN doc_id % 7 = 0 THEN 'people_search' ELSE 'entity_discovery' END AS task_type, CAST(doc_id % 6 AS INTEGER) AS n_keywords, CASE WHEN doc_id % 7 = 0 THEN 'person' ELSE 'company' END AS entity"""


def _tasks(spark, d):
    return spark.sql(f"SELECT {_TASK} FROM {{documents}}", documents=table(spark, d, "documents"))


_add("plan_caps", lambda spark, d: budget.plan(_tasks(spark, d)).select("doc_id", "effective_mode", "max_candidates", "q_ddg", "q_exa", "q_tavily", "q_serpapi"), f"""
WITH t AS (SELECT {_TASK} FROM documents), a AS (SELECT *, intent = 'reseller' AS ch, category = 'software_company' AS sw, task_type = 'people_search' AS pp FROM t),
m1 AS (SELECT *, CASE WHEN mode = 'balanced' AND max_results > 60 THEN 'deep' WHEN mode = 'fast' AND max_results > 30 THEN 'balanced' ELSE mode END AS m FROM a),
m2 AS (SELECT * REPLACE (CASE WHEN m = 'fast' AND (ch OR sw AND n_keywords >= 3) THEN 'balanced' ELSE m END AS m) FROM m1),
e AS (SELECT *, CASE WHEN m = 'balanced' AND max_results >= 50 AND ch AND sw AND n_keywords >= 3 THEN 'deep' ELSE m END AS effective_mode, (sw AND n_keywords >= 2)::INT AS r, (sw AND n_keywords >= 4)::INT AS rr, ch::INT AS c FROM m2)
SELECT doc_id, effective_mode, (CASE WHEN pp THEN greatest(200, max_results * 5) WHEN effective_mode = 'fast' THEN greatest(30, max_results * 3) WHEN effective_mode = 'deep' THEN greatest(200, max_results * 4) ELSE greatest(100, max_results * 3) END + r * 20 + rr * 25 + c * 25)::INTEGER AS max_candidates,
  ((CASE WHEN pp THEN CASE effective_mode WHEN 'deep' THEN 6 ELSE 4 END ELSE CASE effective_mode WHEN 'fast' THEN 4 WHEN 'deep' THEN 12 ELSE 7 END END) + r + c)::INTEGER AS q_ddg,
  ((CASE WHEN pp THEN CASE effective_mode WHEN 'fast' THEN 10 WHEN 'deep' THEN 20 ELSE 15 END ELSE CASE effective_mode WHEN 'fast' THEN 2 WHEN 'deep' THEN 8 ELSE 5 END END) + r + rr + 2 * c)::INTEGER AS q_exa,
  (CASE WHEN pp OR effective_mode = 'fast' THEN 0 ELSE CASE effective_mode WHEN 'deep' THEN 6 ELSE 4 END + rr + c END)::INTEGER AS q_tavily,
  (CASE WHEN pp THEN CASE effective_mode WHEN 'fast' THEN 4 WHEN 'deep' THEN 8 ELSE 5 END WHEN effective_mode = 'deep' THEN 4 ELSE 0 END)::INTEGER AS q_serpapi FROM e""")
_add("provider_order", lambda spark, d: budget.provider_order(_tasks(spark, d).select("doc_id", "mode", "entity", "category")).select("doc_id", "provider", "priority", "place"), f"""
WITH t AS (SELECT {_TASK} FROM documents), p AS (SELECT doc_id, unnest(['ddg', 'exa', 'tavily', 'serpapi']) AS provider, unnest([CASE WHEN mode = 'fast' THEN 90 ELSE 70 END,
  least(100, CASE WHEN entity IN ('paper', 'person') THEN 95 ELSE 85 END + CASE WHEN category = 'software_company' THEN 5 ELSE 0 END), CASE WHEN mode = 'fast' THEN 45 ELSE 80 END, CASE WHEN entity = 'person' THEN 88 ELSE 60 END])::INTEGER AS priority FROM t)
SELECT doc_id, provider, priority, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, provider)::INTEGER AS place FROM p""")
_add("expand_queries", lambda spark, d: budget.queries(_tasks(spark, d).select("doc_id", "category"), F.array(F.lit("drilling"), F.lit("Drilling"), F.lit("ai")), F.lit("company"), F.array(F.lit("egypt"), F.lit("norway")), 3).select("doc_id", "n", "query"), "SELECT doc_id, unnest([0, 1, 2])::INTEGER AS n, unnest(['drilling company egypt', 'drilling company norway', 'ai company egypt']) AS query FROM documents")

# --- places -----------------------------------------------------------------------------------------------------------

_add("geo_region_expand", lambda spark, d: table(spark, d, "region").select("r_regionkey", F.array_join(geo.expand_region(F.col("r_name")), ",").alias("members")), "SELECT r_regionkey, CASE lower(r_name) " + " ".join(f"WHEN '{n}' THEN '{','.join(m)}'" for n, m in geo.REGIONS.items()) + " ELSE '' END AS members FROM region")
_add("geo_country_lookup", lambda spark, d: geo.normal_country(table(spark, d, "nation").select("n_nationkey", F.expr("CASE n_nationkey % 4 WHEN 0 THEN ' Cairo' WHEN 1 THEN 'U.S.A' WHEN 2 THEN 'Riyadh' ELSE n_name END").alias("said")), "said", geo.spelling_table(spark)).select("n_nationkey", "country"), "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'egypt' WHEN 1 THEN 'usa' WHEN 2 THEN 'saudi arabia' ELSE lower(n_name) END AS country FROM nation")
_GEO = "list_sort(list_filter([" + ", ".join("CASE WHEN regexp_matches(t, '(^|[^\\pL\\pN])(?:" + "|".join(n.replace(".", "[.]") for n in names) + ")($|[^\\pL\\pN])') THEN '" + country + "' END" for country, names in geo.SPELLINGS.items()) + "], lambda c: c IS NOT NULL))"
_TOLD = "(SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"
_add("geo_in_documents", lambda spark, d: table(spark, d, "documents").select("doc_id", F.array_join(geo.countries_in(F.col("text")), ",").alias("found")), f"SELECT doc_id, array_to_string({_GEO}, ',') AS found FROM {_TOLD}")
_add("geo_find_countries", lambda spark, d: table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", F.expr("CASE doc_id % 4 WHEN 0 THEN 'offices in Cairo and Oslo' WHEN 1 THEN 'cairobased romeo, from Dubai' END")).alias("t")).select("doc_id", F.array_join(geo.countries_in(F.col("t")), ",").alias("found"), geo.first_country(F.col("t")).alias("first")), f"""SELECT doc_id, array_to_string(g, ',') AS found, coalesce(g[1], '') AS first
  FROM (SELECT doc_id, {_GEO} AS g FROM (SELECT doc_id, lower(concat_ws(' ', text, CASE doc_id % 4 WHEN 0 THEN 'offices in Cairo and Oslo' WHEN 1 THEN 'cairobased romeo, from Dubai' END)) AS t FROM documents))""")

# --- papers -----------------------------------------------------------------------------------------------------------

_FOCUS = (("method", r"\b(method|algorithm|model)"), ("review", r"\b(review|survey)"), ("case", r"\b(case|field)\b"))


def _review(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("t"))
    focus = F.when(F.lit(False), "")
    for label, pattern in _FOCUS:
        focus = focus.when(F.lower("t").rlike(pattern), label)
    good = F.filter(text.sentences(F.col("t")), text.meaningful)
    return docs.select("doc_id", focus.otherwise("general").alias("focus"), F.size(good).alias("n_good"), F.coalesce(F.get(good, F.lit(0)), F.lit("")).alias("best"), text.hits(F.lower("t"), list(filters.ACADEMIC)).alias("academic"))


_add("paper_review", _review)
_add("topic_synthesis", lambda spark, d: table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")), "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents JOIN labels USING (doc_id) GROUP BY lang")

# --- streams ----------------------------------------------------------------------------------------------------------


def _events(spark, d):
    """The events as a stream of files."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/seine-stream-{uuid.uuid4().hex}"


def _streamed(build, columns, keys=None):
    """The stream's rows; with keys, the last row of each, windows that are still open included."""

    def query(spark, d):
        rows = dedup.run_once(build(_events(spark, d)), _folder(spark), "update" if keys else "append")
        return (dedup.latest(rows, keys) if keys else rows).select(*columns)

    return query


_add("stream_dedup_ttl", _streamed(lambda s: dedup.first_within(s.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days"), ["user_id", "event_type"]), "SELECT DISTINCT user_id, event_type FROM events")
_add("stream_budget", _streamed(lambda s: dedup.budget_left(s, "ts", "event_type", 100), ["start", "event_type", "n", "remaining"], ["start", "event_type"]), "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, greatest(0, 100 - count(*))::BIGINT AS remaining FROM events GROUP BY ALL")


# --- streams that remember, in three micro-batches -----------------------------------------------------------------------

_THIRDS = ("2024-01-11", "2024-01-21")


def _thirds(frame):
    """The parts of a frame with a column ts up to, between and from two days on."""
    first, second = (F.lit(t).cast("timestamp") for t in _THIRDS)
    return [frame.filter(F.col("ts") < first), frame.filter((F.col("ts") >= first) & (F.col("ts") < second)), frame.filter(F.col("ts") >= second)]


def _remembered(build, columns):
    def query(spark, d):
        parts = _thirds(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
        return spark.read.parquet(state.run_in_batches(parts, _folder(spark), build)).selectExpr(*columns)

    return query


_add("stream_cache", _remembered(lambda s: state.cache(s, ["user_id", "event_type"], "ts", "event_id", 2 * 86_400), ["number as event_id", "hit", "written_by"]), """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
  w AS (SELECT user_id, event_type, min(us) AS us FROM e GROUP BY ALL
    UNION ALL SELECT w.user_id, w.event_type, min(e.us) FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.us > w.us + 172800000000 GROUP BY w.user_id, w.event_type, w.us),
  n AS (SELECT w.*, e.event_id AS written_by FROM w JOIN e USING (user_id, event_type, us))
  SELECT e.event_id, e.us > n.us AS hit, n.written_by FROM e ASOF JOIN n ON e.user_id = n.user_id AND e.event_type = n.event_type AND e.us >= n.us""")
_add("stream_running_budget", _remembered(lambda s: state.budget(s, ["user_id"], "event_type", "ts", "event_id", 12, 4, 86_400), ["number as event_id", "allowed", "left as remaining"]), """WITH g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER u > 86400000000)::INT AS gap FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS run FROM g),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, event_type ORDER BY ts, event_id) <= 4 AS fits FROM s),
  a AS (SELECT *, sum(fits::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS asked FROM p)
  SELECT event_id, fits AND asked <= 12 AS allowed, greatest(0, 12 - asked)::BIGINT AS remaining FROM a""")


def _stream_index(spark, d):
    """Names of documents, a third of them at a time, into the growing index."""
    named, folder = fixtures.named(spark, d), _folder(spark)
    most = table(spark, d, "documents").agg(F.max("doc_id")).first()[0] or 0
    ends = (most // 3, 2 * most // 3)
    parts = [named.filter(F.col("seq") <= ends[0]), named.filter((F.col("seq") > ends[0]) & (F.col("seq") <= ends[1])), named.filter(F.col("seq") > ends[1])]
    state.run_in_batches(parts, folder, lambda s: s, state.growing_index(folder))
    return spark.read.parquet(f"{folder}/decided").select("seq", "accepted", "duplicate_of")


_add("stream_index", _stream_index)


def _stream_snapshots(spark, d):
    """Who clicked in each third of the month, as snapshots."""
    folder = _folder(spark)
    parts = _thirds(table(spark, d, "events").filter("event_type = 'click'").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"))
    state.run_in_batches(parts, folder, lambda s: s, state.snapshots(folder, "user_id", "long"))
    return spark.read.parquet(f"{folder}/changes").select(F.col("batch").cast("int").alias("batch"), "user_id", "status")


_add("stream_snapshots", _stream_snapshots, f"""WITH k AS (SELECT DISTINCT user_id, (ts >= timestamp '{_THIRDS[0]}')::INT + (ts >= timestamp '{_THIRDS[1]}')::INT AS batch FROM events WHERE event_type = 'click'),
  b AS (SELECT batch, user_id FROM k UNION SELECT batch + 1, user_id FROM k WHERE batch < 2)
  SELECT b.batch, b.user_id, CASE WHEN old.user_id IS NULL THEN 'added' WHEN new.user_id IS NULL THEN 'removed' ELSE 'kept' END AS status
  FROM b LEFT JOIN k new ON new.batch = b.batch AND new.user_id = b.user_id LEFT JOIN k old ON old.batch = b.batch - 1 AND old.user_id = b.user_id""")
