"""Queries that write and read again: a cache filled in three rounds, purged; cases saved and loaded; pages of Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seine.operators import sinks
from seine.session import shared_folder, table
from seine.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_DAY, _NOW = 86_400, 1_706_140_800  # 2024-01-25


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/seine-{name}-{uuid.uuid4().hex}"


def _filled(spark, d) -> store.Cache:
    """Events up to the 25th, put in the order of their numbers' remainders by three, so that later rounds bring older values."""
    cache = store.Cache(spark, _folder(spark, "cache"), 7 * _DAY)
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.format_string("%015d", "event_id").alias("value"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))
    for k in range(3):
        cache.put(rows.filter((F.col("event_id") % 3 == k) & (F.col("created_at") <= _NOW)))
    return cache


def _read(spark, d):
    """Values for every customer and namespace that still count."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")).crossJoin(F.broadcast(table(spark, d, "region").select(F.element_at(F.array(*map(F.lit, _KINDS)), F.col("r_regionkey").cast("int") + 1).alias("namespace"))))  # five regions
    return _filled(spark, d).get(asked, _NOW).select("namespace", "key", "value")


_KINDS = ("click", "view", "error", "purchase", "signup")
_LAST = f"SELECT event_type AS namespace, user_id::VARCHAR AS key, arg_max(lpad(event_id::VARCHAR, 15, '0'), ROW(floor(epoch(ts)), event_id)) AS value, max(floor(epoch(ts))) AS born FROM events WHERE floor(epoch(ts)) <= {_NOW} GROUP BY ALL"
_add("cache_store", _read, f"""SELECT a.namespace, a.key, c.value FROM (SELECT c_custkey::VARCHAR AS key, {list(_KINDS)}[r_regionkey + 1] AS namespace FROM customer, region) a
  LEFT JOIN (SELECT * FROM ({_LAST}) WHERE born >= {_NOW} - {7 * _DAY}) c ON a.namespace = c.namespace AND a.key = c.key""")


def _purged(spark, d):
    cache = _filled(spark, d)
    n = cache.purge(_NOW)
    return cache.table.read().groupBy("namespace").agg(F.count("*").alias("kept")).withColumn("purged_in_all", F.lit(n).cast("long"))


_add("cache_store_purge", _purged, f"SELECT namespace, count(*) FILTER (born >= {_NOW} - {7 * _DAY}) AS kept, (SELECT count(*) FROM ({_LAST}) WHERE born < {_NOW} - {7 * _DAY}) AS purged_in_all FROM ({_LAST}) GROUP BY namespace HAVING kept > 0")


def _cases(spark, d):
    """Benchmark items saved as cases and loaded again."""
    path = _folder(spark, "cases")
    store.save_cases(table(spark, d, "benchmark").select(F.col("item_id").alias("case"), F.col("text").alias("prompt"), F.array(F.lit("a"), F.col("item_id").cast("string")).alias("expected")), path, "case")
    return store.load_cases(spark, path, "case long, prompt string, expected array<string>").select("case", "prompt", F.array_join("expected", ",").alias("expected"))


_add("eval_cases_saved", _cases, """SELECT item_id AS "case", text AS prompt, 'a,' || item_id AS expected FROM benchmark""")
_TEXT = "'# Title ' || doc_id || chr(10) || '- item <b>' || chr(10) || chr(10) || '## Part & more' || chr(10) || 'plain ' || source"
_add(
    "markdown_page", lambda spark, d: table(spark, d, "documents").select("doc_id", sinks.html_of(F.concat(F.lit("# Title "), "doc_id", F.lit("\n- item <b>\n\n## Part & more\nplain "), "source"), "T").alias("html")),
    "SELECT doc_id, '<html><head><title>T</title></head><body>' || chr(10) || '<h1>Title ' || doc_id || '</h1>' || chr(10) || '<li>item &lt;b&gt;</li>' || chr(10) || '<h2>Part &amp; more</h2>' || chr(10) || '<p>plain ' || source || '</p>' || chr(10) || '</body></html>' AS html FROM documents",
)
